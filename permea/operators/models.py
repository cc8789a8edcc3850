"""Candidates, fold-local imputation and out-of-fold prediction
(M1-M3, M6, M11, V5, J5).

Forests of extremely randomised trees are grown by ``growth``, boosted trees by ``boost``, random
forests of tables that fit in a task by ``whole``; the other kinds are Spark ML estimators.  A fitted model is (medians fitted on the training rows) +
feature vector + Spark ML model, whichever way its trees were grown.  Predictions are added as columns by ``transform``, so the
out-of-fold predictions of several candidates end up on the same rows and
blending or comparing them needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost, growth, ridge, whole
from .impute import apply_medians, columns_with_nulls, fit_fold_medians, fit_medians, fit_scaler, fit_set_medians

RANDOM_STATE = 42


@dataclass(frozen=True)
class Profile:
    """Model sizes.  ``FULL`` follows the reference (400 trees, unlimited
    depth -> Spark's maximum 30); ``FAST`` is for tests and per-query checks."""
    n_trees: int = 400
    max_depth: int = 30
    max_bins: int = 128
    gbt_iter: int = 400
    gbt_depth: int = 3
    gbt_step: float = 0.06
    min_leaf: int = 1
    seed: int = RANDOM_STATE
    # histogram memory per task for one tree level: larger -> fewer passes
    # over the data per level (measured 8.9 s -> 6.8 s per fit at sf0.1)
    max_memory_mb: int = 1024


FULL = Profile()
FAST = Profile(n_trees=12, max_depth=8, max_bins=64, gbt_iter=15, gbt_depth=3, gbt_step=0.2)


@dataclass(frozen=True)
class Spec:
    """One candidate: kind in {et, rf, gbt, ridge, clf} and its settings.

    ``trees``, ``iters``, ``rate`` and ``depth`` are the candidate's own sizes (0: the
    profile's); a smaller profile reduces trees and iterations in proportion.
    """
    kind: str
    max_features: float = 0.7
    min_leaf: int = 1
    reg: float = 20.0
    loss: str = "squared"
    scale: bool = False
    indicators: bool = False
    onehot: tuple = ()          # P31: string columns one-hot encoded inside the fit
    select_k: int = 0           # P32: keep the top-k features by binned MI (fit rows only)
    subset: tuple = ()          # P33: name prefixes of the features used
    trees: int = 0
    iters: int = 0
    rate: float = 0.0
    depth: int = 0
    leaves: int = 0             # M2: leaf cap of a boosted tree, grown best gain first
    l2: float = 0.0
    alpha: float = 0.9          # huber's cut-off quantile, or the level of the quantile loss
    balanced: bool = False      # M11: class weights from the rows of the fit

    @property
    def plain(self) -> bool:
        """Whether the candidate reads the fold's common feature vector."""
        return not (self.onehot or self.select_k or self.indicators or self.subset)

    @property
    def boosted(self) -> bool:
        """Whether ``boost`` fits it (absolute loss stays with Spark ML)."""
        return self.kind == "gbt" and self.loss != "absolute"

    @property
    def scaled(self) -> bool:
        return self.scale or self.kind == "ridge"


# ---- fixed values: the reference's candidate list (names are ours for ET) ----
CANDIDATES = {
    "ET.5": Spec("et", 0.5, trees=400), "ET.7": Spec("et", 0.7, trees=400),
    "ET1": Spec("et", 1.0, trees=400),
    "HGB": Spec("gbt", min_leaf=10, iters=400, rate=0.06, leaves=41, l2=0.5),
    "RF": Spec("rf", 0.5, trees=400),
}
STAGE1_SPEC = Spec("et", 0.6)
QUANTILE_SPECS = tuple(Spec("gbt", loss="quantile", alpha=q, iters=200, rate=0.06, depth=3) for q in (0.1, 0.9))
RISK_SPEC = Spec("clf", 0.7, min_leaf=3, trees=700, balanced=True)


def colname(name: str) -> str:
    """Candidate name -> safe column suffix (``ET.5`` -> ``ET_5``)."""
    import re
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def _reduced(own: int, now: int, full: int) -> int:
    return max(1, round(own * now / full)) if own else now


#: Kinds whose trees are extremely randomised ones, grown by ``growth``.
GROWN = ("et", "clf")


def grown_fit(spec: Spec, profile: Profile, label: int, train: growth.Rows, columns: list[int], fill: list[float],
              weights: tuple[float, float] | None = None) -> growth.Fit:
    """The forest of a candidate: its sizes, as the profile reduces them."""
    return growth.Fit(label, train, tuple(columns), tuple(float(f) for f in fill), _reduced(spec.trees, profile.n_trees, FULL.n_trees),
                      spec.max_features, max(spec.min_leaf, profile.min_leaf), spec.depth or profile.max_depth, profile.seed, weights,
                      bins=spec.kind == "rf")


def boosted_fit(spec: Spec, profile: Profile, label: int, train: growth.Rows, columns: list[int], fill: list[float]) -> boost.Boost:
    """The boosted model of a candidate: its sizes, as the profile reduces them."""
    return boost.Boost(label, train, tuple(columns), tuple(float(f) for f in fill), _reduced(spec.iters, profile.gbt_iter, FULL.gbt_iter),
                       spec.rate or profile.gbt_step, spec.loss, spec.alpha, spec.depth or (0 if spec.leaves else profile.gbt_depth),
                       spec.leaves, spec.min_leaf, spec.l2)


def make_estimator(spec: Spec, profile: Profile, label: str = "label",
                   features: str = "_x", prediction: str = "_pred",
                   rows: tuple[int, float] | None = None):
    """The Spark ML estimator of a candidate that is not grown here.  ``rows`` (number and
    standard deviation of the label) is needed for ridge."""
    p = profile
    trees = _reduced(spec.trees, p.n_trees, FULL.n_trees)
    if spec.kind == "rf":
        return RandomForestRegressor(
            featuresCol=features, labelCol=label, predictionCol=prediction,
            numTrees=trees, maxDepth=spec.depth or p.max_depth, maxBins=p.max_bins,
            minInstancesPerNode=max(spec.min_leaf, p.min_leaf),
            featureSubsetStrategy=str(float(spec.max_features)),
            bootstrap=True, subsamplingRate=1.0, seed=p.seed,
            maxMemoryInMB=p.max_memory_mb)
    if spec.kind == "gbt":
        return GBTRegressor(featuresCol=features, labelCol=label, predictionCol=prediction,
                            maxIter=_reduced(spec.iters, p.gbt_iter, FULL.gbt_iter),
                            maxDepth=spec.depth or p.gbt_depth, stepSize=spec.rate or p.gbt_step,
                            maxBins=p.max_bins, minInstancesPerNode=max(spec.min_leaf, 1),
                            lossType=spec.loss, seed=p.seed, maxMemoryInMB=p.max_memory_mb)
    if spec.kind == "ridge":
        # SSE + reg * |w|^2.  Spark minimises SSE / 2n + (regParam / sd) * |w|^2 / 2 in
        # the label's own units, as it divides the label by its deviation first.
        n, sd = rows
        return LinearRegression(featuresCol=features, labelCol=label, predictionCol=prediction,
                                regParam=spec.reg / max(n, 1) * (sd or 1.0), elasticNetParam=0.0,
                                standardization=False, solver="normal")
    raise ValueError(spec.kind)


def label_rows(df: DataFrame, label: str) -> tuple[int, float]:
    row = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return row.n, row.sd or 0.0


def feature_vector(medians: dict, names: list[str], scaler: dict | None = None, single: bool = False) -> Column:
    """The model's input: NULLs filled with medians, ``missing_<c>`` flags, scaled
    when a scaler is given, in single precision for grown trees (they are grown on
    such values).  The columns themselves stay as they are."""
    cols = []
    for name in names:
        source = name.removeprefix("missing_")
        if name in medians:
            v = F.coalesce(F.col(name).cast("double"), F.lit(float(medians[name])))
        else:
            v = F.col(source).isNull().cast("double")
        if scaler and scaler.get(name, (None,))[0] is not None:
            m, sd = scaler[name]
            v = (v - F.lit(m)) / F.lit(sd if sd and sd > 0 else 1.0)
        cols.append(v)
    values = F.array(*cols)
    return array_to_vector(values.cast("array<float>").cast("array<double>") if single else values)


@dataclass
class Fitted:
    """Imputer medians + column order + Spark ML model."""
    spec: Spec
    features: list[str]
    medians: dict
    kept: list[str]
    model: object
    scaler: dict | None = None
    extra: dict = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        """``df`` with the feature vector ``_x``."""
        vector = feature_vector(self.medians, self.kept, self.scaler, self.spec.kind in GROWN)
        if not self.spec.onehot:
            return df.withColumn("_x", vector)
        x, ohe_cols = _apply_onehot(df.withColumn("_numeric", vector), self.spec.onehot, self.extra["onehot"])
        return VectorAssembler(inputCols=["_numeric", *ohe_cols], outputCol="_x").transform(x)

    def transform(self, df: DataFrame, out: str, prob: bool = False) -> DataFrame:
        """Add prediction column ``out`` (class-1 probability when ``prob``)."""
        cols = df.columns
        res = self.model.transform(self.prepare(df))
        return res.select(*[F.col(c) for c in cols], _output("_pred", prob).alias(out))


def _output(prediction: str, prob: bool) -> Column:
    # class-1 probability; a training set with one class has a 1-long
    # probability vector, which means probability 0 for class 1
    if prob:
        return F.coalesce(F.try_element_at(vector_to_array(f"{prediction}_prob"), F.lit(2)), F.lit(0.0))
    return F.col(prediction)


MISSING_TOKEN = "__missing__"


def _fill_tokens(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TOKEN))
                           for c in cols})


def _apply_onehot(df: DataFrame, cols, model) -> tuple[DataFrame, list[str]]:
    out = model.transform(_fill_tokens(df, cols))
    return out, [f"_ohe_{c}" for c in cols]


def _selected(features: list[str], spec: Spec) -> list[str]:
    return [f for f in features if f.startswith(spec.subset)] if spec.subset else list(features)


def fit(df: DataFrame, features: list[str], label: str, spec: Spec, profile: Profile,
        medians: dict | None = None) -> Fitted:
    """Fit medians on ``df`` (the training rows only; or take those already
    fitted on the same rows) and then the model.

    With ``spec.onehot`` the listed string columns are indexed and one-hot
    encoded on the training rows (unseen values -> all zeros, like
    ``handle_unknown='ignore'``); with ``spec.select_k`` only the top-k
    features by binned mutual information with the label are kept; with
    ``spec.indicators`` the columns that miss values here get a flag each.
    """
    use = _selected(features, spec)
    med = {c: medians[c] for c in use} if medians else fit_medians(df, use)
    kept = [c for c in use if med[c] is not None]
    extra: dict = {}
    if spec.indicators:
        extra["indicators"] = columns_with_nulls(df, kept)
        kept += [f"missing_{c}" for c in extra["indicators"]]
    if spec.select_k:
        from .select import mutual_info_topk
        x, names = apply_medians(df, med, extra.get("indicators", []))
        top = mutual_info_topk(x, names, label, k=spec.select_k).select("feature").collect()
        chosen = {r.feature for r in top}
        kept = [c for c in kept if c in chosen]
    scaler = None
    if spec.scaled:
        x, _ = apply_medians(df, med, extra.get("indicators", []))
        scaler = fit_scaler(x, kept)
    if spec.onehot:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import OneHotEncoder, StringIndexer
        cols = list(spec.onehot)
        idx = StringIndexer(inputCols=cols, outputCols=[f"_idx_{c}" for c in cols],
                            handleInvalid="keep")
        ohe = OneHotEncoder(inputCols=[f"_idx_{c}" for c in cols],
                            outputCols=[f"_ohe_{c}" for c in cols], dropLast=True)
        extra["onehot"] = Pipeline(stages=[idx, ohe]).fit(_fill_tokens(df, cols))
    fitted = Fitted(spec, features, med, kept, None, scaler, extra)
    if spec.kind in GROWN:
        columns = [_raw_column(c) for c in kept] + _onehot_columns(spec.onehot, extra.get("onehot"))
        weights = class_weights({r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}) if spec.balanced else None
        packed = growth.pack(df, {str(i): c for i, c in enumerate(columns)}, {"label": F.col(label)}, {}, [])
        fill = [med.get(c, 0.0) for c in kept] + [0.0] * (len(columns) - len(kept))
        fitted.model = growth.forest(packed, grown_fit(spec, profile, 0, growth.Rows(()), list(range(len(columns))), fill, weights),
                                     len(columns), classes=spec.kind == "clf")
        return fitted
    if spec.kind == "rf" and spec.plain and whole.fits_in(df.count(), len(kept)):
        columns = {c: F.col(c) for c in kept}
        edges = boost.bin_edges(df, columns, profile.max_bins)
        packed = growth.pack(df, columns, {"label": F.col(label)}, {}, [], edges=edges)
        fill = [int(np.searchsorted(e, med[c])) for c, e in zip(kept, edges, strict=True)]
        own = grown_fit(spec, profile, 0, growth.Rows(()), list(range(len(kept))), fill)
        fitted.model = growth.forest(packed, own, len(kept), edges=edges)
        return fitted
    if spec.boosted:
        return _fit_boosted(df, label, [fitted], profile)[0]
    rows = label_rows(df, label) if spec.kind == "ridge" else None
    fitted.model = make_estimator(spec, profile, label=label, rows=rows).fit(fitted.prepare(df))
    return fitted


def fit_forests(df: DataFrame, wanted: dict[str, tuple[Spec, Column, Column, list[str]]], profile: Profile) -> dict[str, Fitted]:
    """Several forests of one table, grown together: name -> (candidate, label, condition on the
    rows, features).  Their medians come from one set of passes, each over its own rows."""
    names = list(wanted)
    columns = list(dict.fromkeys(c for n in names for c in wanted[n][3]))
    medians = fit_set_medians(df, columns, [wanted[n][2] for n in names])
    place = {c: i for i, c in enumerate(columns)}
    packed = growth.pack(df, {c: F.col(c) for c in columns}, {n: wanted[n][1] for n in names},
                         {n: F.coalesce(wanted[n][2], F.lit(False)).cast("int") for n in names}, [])
    fits, kept = [], []
    for i, n in enumerate(names):
        spec, _, _, features = wanted[n]
        kept.append([c for c in features if medians[i][c] is not None])
        fits.append(grown_fit(spec, profile, i, growth.Rows(((i, True, 1),)), [place[c] for c in kept[i]], [medians[i][c] for c in kept[i]]))
    out = {}
    for group in growth.groups_of(fits, packed.count()):
        for i, trees in zip(group, growth.grow(packed, [fits[i] for i in group]), strict=True):
            spec, _, _, features = wanted[names[i]]
            model = growth.spark_model(df.sparkSession, trees, len(kept[i]))
            out[names[i]] = Fitted(spec, features, {c: medians[i][c] for c in features}, kept[i], model)
    return out


def fit_boosted(df: DataFrame, features: list[str], label: str, specs: list[Spec], profile: Profile) -> list[Fitted]:
    """Several boosted candidates of the same rows (the two quantile models of an interval), in lockstep."""
    medians = fit_medians(df, features)
    kept = [c for c in features if medians[c] is not None]
    return _fit_boosted(df, label, [Fitted(s, features, medians, kept, None) for s in specs], profile)


def _fit_boosted(df: DataFrame, label: str, blank: list[Fitted], profile: Profile) -> list[Fitted]:
    first = blank[0]
    columns = [_raw_column(c) for c in first.kept] + _onehot_columns(first.spec.onehot, first.extra.get("onehot"))
    named = {str(i): c for i, c in enumerate(columns)}
    edges = boost.bin_edges(df, named, profile.max_bins)
    packed = growth.pack(df, named, {"label": F.col(label)}, {}, [], edges=edges)
    fill = [first.medians.get(c, 0.0) for c in first.kept] + [0.0] * (len(columns) - len(first.kept))
    booster = boost.Booster(packed, [boosted_fit(f.spec, profile, 0, growth.Rows(()), list(range(len(columns))), fill) for f in blank], edges)
    booster.fit()
    for k, f in enumerate(blank):
        trees = booster.as_trees(k)
        f.model = growth.spark_model(df.sparkSession, trees, len(columns), [1.0] * len(trees))
    return blank


def _raw_column(name: str) -> Column:
    return F.col(name.removeprefix("missing_")).isNull().cast("double") if name.startswith("missing_") else F.col(name).cast("double")


def _onehot_columns(cols: tuple, model) -> list[Column]:
    """The one-hot columns of a fitted encoder, in its order."""
    if not cols:
        return []
    labels = model.stages[0].labelsArray
    return [(F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TOKEN)) == F.lit(v)).cast("double")
            for c, own in zip(cols, labels, strict=True) for v in own]


def class_weights(counts: dict[int, int]) -> tuple[float, float]:
    """N / (2 * n_class) of classes 0 and 1, as ``class_weight='balanced'``."""
    n, k = sum(counts.values()), len(counts)
    return tuple(n / (k * counts[c]) if counts.get(c) else 1.0 for c in (0, 1))


@dataclass
class FoldInput:
    """What all candidates of a fold share: medians (and scaler) fitted on the
    training rows, and the training rows' vectors, written once."""
    medians: dict
    kept: list[str]
    scaler: dict | None
    train: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], columns: list[str], scale: bool, medians: dict) -> FoldInput:
        from ..session import materialize
        kept = [c for c in features if medians[c] is not None]
        scaler = fit_scaler(apply_medians(train, medians)[0], kept) if scale else None
        self = cls(medians, kept, scaler, train)
        self.train = materialize(self.vectors(train).select(*columns, *self.outputs), "fold-vectors")
        return self

    @property
    def outputs(self) -> list[str]:
        return ["_shared_x"] + (["_shared_xs"] if self.scaler else [])

    def vectors(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_shared_x", feature_vector(self.medians, self.kept))
        return out.withColumn("_shared_xs", feature_vector(self.medians, self.kept, self.scaler)) if self.scaler else out


def oof(df: DataFrame, fold: str, k: int, features: list[str], label: str,
        specs: dict[str, Spec], profile: Profile, prefix: str = "oof_",
        transforms: dict | None = None, prob: bool = False,
        parallelism: int = 4, persist: bool = True, chunk: int = 12, keep: list[str] | None = None) -> DataFrame:
    """V5: out-of-fold predictions of every candidate as ``<prefix><colname(name)>``, beside the columns
    of ``df`` or those named by ``keep`` (what is not kept is not written again with the predictions).

    The medians of all folds are fitted in one set of passes.  Forests of extremely
    randomised trees (any features, any transform, all folds) grow together over one packed
    table, and so do boosted trees and ridges.  For the others, each fold's vectors are written once and every candidate (and
    transform) trains on them and predicts the fold.  Each row is predicted exactly once, by
    models that never saw its fold.  ``transforms`` maps a candidate to a (forward, inverse)
    pair applied around the fit (P21/P23).
    """
    from ..session import materialize
    transforms = transforms or {}
    medians = fit_fold_medians(df, features, fold, k)
    batches = [{n: s for n, s in specs.items() if s.kind in GROWN}]
    batches.append({n: s for n, s in specs.items() if s.boosted})
    if any(s.kind == "rf" and s.plain for s in specs.values()) and whole.fits_in(df.count(), len(features)):
        batches.append({n: s for n, s in specs.items() if s.kind == "rf" and s.plain})
    batches += [{n: s for n, s in specs.items() if s.kind == "ridge" and s.reg == reg}
                for reg in sorted({s.reg for s in specs.values() if s.kind == "ridge"})]
    rest = {n: s for n, s in specs.items() if not any(n in b for b in batches)}
    batches = [b for b in batches if b]
    kept = df.columns if keep is None else list(keep)
    kept = kept + [prefix + colname(n) for b in batches for n in b]
    for i, batch in enumerate(batches, 1):
        last = i == len(batches) and not rest
        df = _batch_oof(df, fold, k, features, label, batch, profile, prefix, transforms, medians, [c for c in df.columns if c in kept] if last else df.columns)
    if not rest:
        return df  # a selection of a written table
    scale = any(s.plain and s.scaled for s in rest.values())
    inputs = run_parallel(lambda i: FoldInput.fit(df.where(F.col(fold) != i), features, [label], scale, medians[i]),
                          list(range(k)), parallelism)

    def fit_one(i: int, name: str):
        spec, lab, shared = rest[name], label, inputs[i]
        train = shared.train if spec.plain else df.where(F.col(fold) != i)
        if name in transforms:
            train, lab = train.withColumn("_t_label", transforms[name][0](F.col(label))), "_t_label"
        if not spec.plain:
            return fit(train, features, lab, spec, profile, medians=shared.medians)
        est = make_estimator(spec, profile, lab, "_shared_xs" if spec.scaled else "_shared_x", f"_p_{colname(name)}",
                             label_rows(train, lab) if spec.kind == "ridge" else None)
        return est.fit(train)

    fitted = run_parallel(lambda a: fit_one(*a), [(i, n) for i in range(k) for n in rest], parallelism)
    parts = []
    for i in range(k):
        test = inputs[i].vectors(df.where(F.col(fold) == i))
        for j, name in enumerate(rest, 1):
            out, model = prefix + colname(name), fitted[(i, name)]
            if rest[name].plain:
                cols, own = test.columns, f"_p_{colname(name)}"
                test = model.transform(test).select(*[F.col(c) for c in cols], _output(own, prob).alias(out))
            else:
                test = model.transform(test, out, prob=prob)
            if name in transforms:
                test = test.withColumn(out, transforms[name][1](F.col(out)))
            if persist and j % chunk == 0 and j < len(rest):
                # stacked model transforms deepen the plan; writing every few
                # candidates keeps plan analysis small on the driver
                test = materialize(test, "oof-part")
        parts.append(test.drop("_shared_x", "_shared_xs"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    out = out.select(*[c for c in out.columns if c in kept or c in [prefix + colname(n) for n in rest]])
    if persist:
        # one short lineage for every consumer of the predictions
        out = materialize(out, "oof")
    return out


def _batch_oof(df: DataFrame, fold: str, k: int, features: list[str], label: str, specs: dict[str, Spec], profile: Profile,
               prefix: str, transforms: dict, medians: list[dict], keep: list[str]) -> DataFrame:
    """``df`` with the out-of-fold predictions of forests, boosted trees or ridges: every fold of every candidate is a fit."""
    jobs = [Job(n, s, transforms[n][0](F.col(label)) if n in transforms else F.col(label), ((fold, False, i),), ((fold, True, i),))
            for n, s in specs.items() for i in range(k)]
    out = held_out(df, features, jobs, {fold: F.col(fold)}, profile, {((fold, False, i),): m for i, m in enumerate(medians)}, keep)
    return out.select(*keep, *[
        (transforms[n][1](F.col(f"`{n}`")) if n in transforms else F.col(f"`{n}`")).alias(prefix + colname(n)) for n in specs])


@dataclass(frozen=True)
class Job:
    """One fit and the rows it predicts.  Rows are told by group numbers:
    ``(group, equal, number)`` all hold.  Jobs of one name (its folds) share a column."""
    name: str
    spec: Spec
    label: Column
    train: tuple[tuple[str, bool, int], ...]
    test: tuple[tuple[str, bool, int], ...]


def _condition(groups: dict[str, Column], tests: tuple) -> Column:
    out = F.lit(True)
    for g, equal, number in tests:
        same = groups[g].cast("int").eqNullSafe(F.lit(number))
        out = out & (same if equal else ~same)
    return out


def held_out(df: DataFrame, features: list[str], jobs: list[Job], groups: dict[str, Column], profile: Profile,
             medians: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with one column per job name: the predictions (in the label's scale) of its
    held-out rows.  All jobs (forests, boosted trees, or ridges of one penalty) read one packed table; what they need to know of their
    training rows (medians, which columns miss values, which one-hot values occur, class
    counts) is found for all of them in one job each."""
    keep = df.columns if keep is None else keep
    sets = list(dict.fromkeys(j.train for j in jobs))
    rows_of = {t: _condition(groups, t) for t in sets}
    if medians is None:
        medians = dict(zip(sets, fit_set_medians(df, features, list(rows_of.values())), strict=True))
    flags = any(j.spec.indicators for j in jobs)
    slots = list(dict.fromkeys(c for j in jobs for c in j.spec.onehot))
    columns = {c: F.col(c) for c in features} | ({f"missing_{c}": F.col(c).isNull() for c in features} if flags else {})
    missing: dict[tuple, set] = {}
    if flags:
        got = df.agg(*[a for i, t in enumerate(sets) for a in (
            F.count_if(rows_of[t]).alias(f"n{i}"), *[F.count_if(rows_of[t] & F.col(c).isNotNull()).alias(f"{i}:{c}") for c in features])]).first()
        missing = {t: {c for c in features if 0 < got[f"{i}:{c}"] < got[f"n{i}"]} for i, t in enumerate(sets)}
    held: dict[tuple, set] = {t: set() for t in sets}  # the one-hot columns whose value occurs
    for c in slots:
        token = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TOKEN))
        for r in df.groupBy(token.alias("v")).agg(F.array(*[F.max(rows_of[t]) for t in sets]).alias("sets")).orderBy("v").collect():
            columns[f"{c}={r.v}"] = token == F.lit(r.v)
            for t, there in zip(sets, r.sets, strict=True):
                if there:
                    held[t].add(f"{c}={r.v}")
    place = {c: i for i, c in enumerate(columns)}
    most = max((j.spec.select_k for j in jobs), default=0)
    if most:
        chosen = list(dict.fromkeys((j.train, str(j.label)) for j in jobs if j.spec.select_k))
        label_col = {str(j.label): j.label for j in jobs}
        ranked = run_parallel(lambda a: _mi_ranking(df.where(rows_of[a[0]]).withColumn("_mi_label", label_col[a[1]]), features, "_mi_label", most),
                              chosen)
    labels = {str(j.label): j.label for j in jobs}
    balanced = list(dict.fromkeys((j.train, str(j.label)) for j in jobs if j.spec.balanced))
    weights = {}
    if balanced:
        got = df.agg(*[F.count_if(rows_of[t] & (labels[y] == v)).alias(f"{i}:{v}") for i, (t, y) in enumerate(balanced) for v in (0, 1)]).first()
        weights = {a: class_weights({v: got[f"{i}:{v}"] for v in (0, 1) if got[f"{i}:{v}"]}) for i, a in enumerate(balanced)}
    number = {g: i for i, g in enumerate(groups)}
    rows = lambda tests: growth.Rows(tuple((number[g], equal, n) for g, equal, n in tests))
    boosted = all(j.spec.boosted for j in jobs)
    fits = []
    for j in jobs:
        med, spec = medians[j.train], j.spec
        kept = [c for c in _selected(features, spec) if med[c] is not None]
        if spec.indicators:
            kept += [f"missing_{c}" for c in kept if c in missing[j.train]]
        if spec.select_k:
            kept = [c for c in kept if c in ranked[(j.train, str(j.label))][:spec.select_k]]
        kept += [c for c in columns if c in held[j.train] and c.split("=")[0] in spec.onehot]
        own = (spec, profile, list(labels).index(str(j.label)), rows(j.train), [place[c] for c in kept], [med.get(c, 0.0) for c in kept])
        fits.append((j.name, boosted_fit(*own) if boosted else
                     grown_fit(*own, weights.get((j.train, str(j.label))) if spec.balanced else None), rows(j.test)))
    if jobs[0].spec.kind == "rf":
        edges = boost.bin_edges(df, columns, profile.max_bins)
        binned = [(name, replace(f, fill=tuple(int(np.searchsorted(edges[c], v)) for c, v in zip(f.features, f.fill, strict=True))), test)
                  for name, f, test in fits]
        return whole.held_out(growth.pack(df, columns, labels, groups, keep, edges=edges), binned)
    if boosted:
        edges = boost.bin_edges(df, columns, profile.max_bins)
        booster = boost.Booster(growth.pack(df, columns, labels, groups, keep, edges=edges), [f for _, f, _ in fits], edges)
        booster.fit()
        return booster.held_out([n for n, _, _ in fits], [t for _, _, t in fits])
    if all(j.spec.kind == "ridge" for j in jobs):
        packed = growth.pack(df, columns, labels, groups, keep, np.float64)
        return ridge.ridge_held_out(packed, fits, jobs[0].spec.reg)
    packed = growth.pack(df, columns, labels, groups, keep)
    return growth.predict_held_out(packed, fits)


def _mi_ranking(train: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    from .select import mutual_info_topk
    return [r.feature for r in mutual_info_topk(train, features, label, k=k).select("feature").collect()]


def run_parallel(fn, items: list, parallelism: int = 4) -> dict:
    """Run independent fits as concurrent Spark jobs from driver threads.

    Small fits leave most cores idle; submitting them together lets the
    scheduler interleave their stages.  Results are keyed by item.
    """
    from concurrent.futures import ThreadPoolExecutor
    if parallelism <= 1 or len(items) <= 1:
        return {it: fn(it) for it in items}
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        futures = {it: ex.submit(fn, it) for it in items}
        return {it: f.result() for it, f in futures.items()}


def prediction_sum(cols: list[Column], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * c for c, w in zip(cols, weights)])
