"""Training job (E1): per target, candidate selection by out-of-fold R2, a
two-model blend, recipe-grouped score, repeated holdouts, final fit and
residual-quantile intervals; then the stage-1 recipe -> characterisation
models (M1-M8, V1-V5, A4, A5).

Data flow: the cleaned recipe table is turned into the feature matrix once
and written to the shared checkpoint folder; every fit reads that table with
the target filter pushed into the Parquet scan.  Only metric rows (a handful
per target) are collected to the driver, to choose the blend.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as TR
from ..operators import blend as BL
from ..operators import features as FE
from ..operators import metrics as ME
from ..operators import models as MD
from ..operators import splits as SP
from ..operators.clean import DOMAIN_FILTERS
from ..session import materialize
from ..sources.fixture import TARGETS


#: A characterisation with fewer values gets no model.
MIN_STAGE1_ROWS = 40


@dataclass
class TargetModel:
    """Final model of one target: a weighted blend, in transformed space."""
    target: str
    names: list[str]
    weights: list[float]
    fitted: list
    q_lo: float | None = None
    q_hi: float | None = None
    lo: object = None   # M4: the models of the 10 % and 90 % quantile
    hi: object = None

    @property
    def model_name(self) -> str:
        return self.names[0] if len(self.names) == 1 else "+".join(self.names)

    def predict_z(self, df: DataFrame, out: str) -> DataFrame:
        """Add the blended transformed-space prediction as column ``out``."""
        cols = []
        for i, m in enumerate(self.fitted):
            c = f"_{out}_{i}"
            df = m.transform(df, c)
            cols.append(c)
        z = MD.prediction_sum([F.col(c) for c in cols], self.weights)
        return df.withColumn(out, z).drop(*cols)


@dataclass
class TrainResult:
    categories: list[str]
    feature_names: list[str]
    models: dict[str, TargetModel] = field(default_factory=dict)
    stage1: dict[str, object] = field(default_factory=dict)
    stage1_feature_names: list[str] = field(default_factory=list)
    report: list[dict] = field(default_factory=list)
    stage1_report: list[dict] = field(default_factory=list)
    holdout_predictions: dict[str, DataFrame] = field(default_factory=dict)
    oof: dict[str, DataFrame] = field(default_factory=dict)
    features: DataFrame | None = None          # the written feature table


def feature_table(clean: DataFrame, categories: list[str] | None = None,
                  recipe_only: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """Feature matrix + ids + targets, written once to the checkpoint folder."""
    cats = categories or FE.membrane_categories(clean)
    keep = (SP.row_cols(clean) + ["synth_key", "membrane"] + list(TARGETS.values()) + list(FE.STAGE1_SOURCE.values())
            + ["smiles_part1", "smiles_part2", "smiles_part3", "smiles_part4", "smiles_part5"])
    keep = list(dict.fromkeys(keep))
    f = FE.build_features(clean, cats, keep=keep, recipe_only=recipe_only)
    names = FE.recipe_feature_names(cats) if recipe_only else FE.feature_names(cats)
    return materialize(f, "features"), cats, names


def target_rows(target: str):
    """The condition of P5 and P6 on a target's rows."""
    col = F.col(TARGETS[target])
    lo, hi = DOMAIN_FILTERS.get(target, (None, None))
    out = col.isNotNull()
    if lo is not None:
        out = out & (col >= lo)
    if hi is not None:
        out = out & (col <= hi)
    return out


def target_frame(feats: DataFrame, target: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows of one target (P5, P6) with its transformed label (P21) and
    row folds (V1) and recipe-grouped folds (V2)."""
    col = TARGETS[target]
    d = feats.where(target_rows(target)).withColumns({"y": F.col(col), "z": TR.fwd_transform(target, col)})
    d = SP.with_fold(d, k, SP.row_key(SP.row_cols(d)), seed, "fold")
    return SP.with_fold(d, k, F.col("synth_key"), seed, "gfold")


def _metrics_rows(df: DataFrame, y: str, preds: dict[str, str]) -> dict[str, float]:
    """R2 of several prediction columns in one aggregate pass."""
    n = F.count(F.lit(1))
    var = F.var_pop(y)
    aggs = [F.when(var > 0, 1.0 - F.sum((F.col(c) - F.col(y)) ** 2) / (var * n)).alias(k)
            for k, c in preds.items()]
    row = df.agg(*aggs).first()
    return {k: row[k] for k in preds}


def select_blend(oof: DataFrame, candidates: list[str]) -> tuple[list[str], float, float, dict]:
    """M5: top two candidates by OOF R2 (transformed space), then the weight
    in 0.50..1.00 that strictly improves on the best alone."""
    r2 = _metrics_rows(oof, "z", {n: "oof_" + MD.colname(n) for n in candidates})
    ranked = sorted(candidates, key=lambda n: (-(r2[n] if r2[n] is not None else -1e300), n))
    if len(ranked) == 1:
        return ranked, 1.0, r2[ranked[0]], r2
    t1, t2 = ranked[:2]
    grid = BL.weight_grid(oof, [], "z", "oof_" + MD.colname(t1), "oof_" + MD.colname(t2),
                          BL.WEIGHTS_050_100).collect()
    best_w, best_r = 1.0, r2[t1]
    for row in sorted(grid, key=lambda r: r.w):
        if row.r2 is not None and best_r is not None and row.r2 > best_r:
            best_w, best_r = float(row.w), float(row.r2)
    return [t1, t2], best_w, best_r, r2


def train_target(feats: DataFrame, target: str, names: list[str], profile: MD.Profile,
                 candidates: dict | None = None, grouped: bool = True, holdouts: int = 5,
                 intervals: bool = True, result: TrainResult | None = None) -> TargetModel:
    cands = candidates or MD.CANDIDATES
    d = target_frame(feats, target)
    row_id = SP.row_cols(d)
    if len(cands) == 1 and not intervals and not grouped and not holdouts:
        # serving bundle only: one candidate, no evaluation, one fit
        name = next(iter(cands))
        final = TargetModel(target, [name], [1.0], [MD.fit(d, names, "z", cands[name], profile)])
        if result is not None:
            result.models[target] = final
            result.report.append({"target": target, "model": name})
        return final
    oof = MD.oof(d, "fold", 5, names, "z", cands, profile)
    oof = materialize(oof.select(*row_id, "synth_key", "y", "z", "fold", "gfold",
                                 *["oof_" + MD.colname(n) for n in cands]), f"oof-{target}")
    chosen, w, cv_r2, cand_r2 = select_blend(oof, list(cands))
    weights = [w] if w >= 0.999 else [w, 1.0 - w]
    chosen = chosen[:len(weights)]
    blend = MD.prediction_sum([F.col("oof_" + MD.colname(n)) for n in chosen], weights)
    oof = oof.withColumn("oof_blend", blend)
    rec = {"target": target, "CV_R2": cv_r2, "candidates": cand_r2,
           "model": chosen[0] if len(chosen) == 1 else "+".join(chosen)}
    counts = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("synth_key").alias("g")).first()
    rec["n"], rec["n_groups"] = counts.n, counts.g
    specs = {n: cands[n] for n in chosen}
    if grouped:
        k = max(1, min(5, counts.g))
        g = SP.with_fold(d, k, F.col("synth_key"), 42, "gfold")
        pg = MD.oof(g, "gfold", k, names, "z", specs, profile, prefix="g_")
        pg = pg.withColumn("g_blend", MD.prediction_sum(
            [F.col("g_" + MD.colname(n)) for n in chosen], weights))
        rec["GroupKFold_R2"] = _metrics_rows(pg, "z", {"r": "g_blend"})["r"]
    if holdouts:
        parts = []
        for seed in range(holdouts):
            h = SP.with_holdout(d, SP.row_key(row_id), seed, 0.2)
            tr, te = h.where(~F.col("is_test")), h.where(F.col("is_test"))
            tm = TargetModel(target, chosen, weights,
                             [MD.fit(tr, names, "z", specs[n], profile) for n in chosen])
            p = tm.predict_z(te, "zp").withColumn("y_pred", TR.inv_transform(target, "zp"))
            parts.append(p.select(*row_id, "membrane", F.lit(seed).alias("split_seed"),
                                  "y", "y_pred"))
        pool = parts[0]
        for p in parts[1:]:
            pool = pool.unionByName(p)
        pool = materialize(pool, f"holdout-{target}")
        per_seed = ME.regression_metrics(pool, ["split_seed"], "y", "y_pred")
        agg = per_seed.agg(F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("r2_sd"),
                           F.avg("rmse").alias("rmse")).first()
        mae = pool.agg(F.avg(F.abs(F.col("y_pred") - F.col("y")))).first()[0]
        rec.update({"Test_R2": agg.r2, "Test_R2_std": agg.r2_sd, "RMSE": agg.rmse, "MAE": mae})
        if result is not None:
            result.holdout_predictions[target] = pool
    final = TargetModel(target, chosen, weights,
                        [MD.fit(d, names, "z", specs[n], profile) for n in chosen])
    if intervals:
        q = BL.residual_quantiles(oof, [], "z", "oof_blend").first()
        final.q_lo, final.q_hi = q.q_lo, q.q_hi
        final.lo, final.hi = MD.fit_boosted(d, names, "z", list(MD.QUANTILE_SPECS), profile)
    if result is not None:
        result.report.append(rec)
        result.oof[target] = oof
        result.models[target] = final
    return final


def train_stage1(clean: DataFrame, categories: list[str], profile: MD.Profile,
                 result: TrainResult, min_rows: int = MIN_STAGE1_ROWS, evaluate: bool = True,
                 feats: DataFrame | None = None) -> None:
    """M8: recipe-only features -> each characterisation with >= 40 values;
    R2 of out-of-fold predictions on the original scale when ``evaluate``.

    The recipe-only columns are a subset of the full matrix with the same
    values (same rows, same batch medians), so a written full feature table
    is reused when given instead of building and writing a second one.
    """
    rnames = FE.recipe_feature_names(categories)
    if feats is not None and all(c in feats.columns for c in rnames):
        rf = feats
    else:
        rf, _, rnames = feature_table(clean, categories, recipe_only=True)
    result.stage1_feature_names = rnames
    # one pass for the five non-null counts
    counts = rf.agg(*[F.count(src).alias(char) for char, src in FE.STAGE1_SOURCE.items()]).first()

    def one(char):
        src, tf = FE.STAGE1_SOURCE[char], FE.STAGE1_CHARS[char]
        d = rf.where(F.col(src).isNotNull())
        d = SP.with_fold(d.withColumn("zc", TR.stage1_fwd(char, src, tf)), 5, SP.row_key(SP.row_cols(d)), 42)
        r2 = None
        if evaluate:
            o = MD.oof(d, "fold", 5, rnames, "zc", {"S1": MD.STAGE1_SPEC}, profile)
            o = o.withColumn("pred", TR.stage1_inv(char, "oof_S1", tf))
            r2 = _metrics_rows(o, src, {"r": "pred"})["r"]
        return MD.fit(d, rnames, "zc", MD.STAGE1_SPEC, profile), r2

    chars = [c for c in FE.STAGE1_SOURCE if counts[c] >= min_rows]
    done = MD.run_parallel(one, chars, parallelism=2 if evaluate else 5)
    for char in chars:
        result.stage1[char] = done[char][0]
        result.stage1_report.append({"char": char, "n": counts[char], "R2": done[char][1],
                                     "transform": FE.STAGE1_CHARS[char] or "none"})


def train_all(clean: DataFrame, profile: MD.Profile = MD.FAST, targets: list[str] | None = None,
              candidates: dict | None = None, grouped: bool = True, holdouts: int = 5,
              stage1: bool = True) -> TrainResult:
    """The whole training job; returns models and report rows."""
    feats, cats, names = feature_table(clean)
    res = TrainResult(categories=cats, feature_names=names, features=feats)
    for t in (targets or list(TARGETS)):
        train_target(feats, t, names, profile, candidates, grouped, holdouts, True, res)
    if stage1:
        train_stage1(clean, cats, profile, res, feats=feats)
    return res


def quick_models(clean: DataFrame, profile: MD.Profile = MD.FAST, spec_name: str = "ET.5",
                 targets: list[str] | None = None, stage1: bool = True,
                 intervals: bool = False) -> TrainResult:
    """Final models without selection (one candidate per target): the serving
    bundle at a fraction of the cost of ``train_all``.  With ``intervals``
    the residual quantiles come from that candidate's out-of-fold run."""
    feats, cats, names = feature_table(clean)
    res = TrainResult(categories=cats, feature_names=names, features=feats)
    spec = {spec_name: MD.CANDIDATES[spec_name]}
    tlist = targets or list(TARGETS)

    if not intervals and spec[spec_name].kind == "et" and spec[spec_name].plain:
        return _serving_forests(res, feats, names, spec_name, tlist, cats if stage1 else None, profile)

    def one(t):
        r = TrainResult(categories=cats, feature_names=names)
        train_target(feats, t, names, profile, spec, grouped=False, holdouts=0,
                     intervals=intervals, result=r)
        return r
    jobs = [("target", t) for t in tlist] + ([("stage1", None)] if stage1 else [])

    def run(job):
        kind, t = job
        if kind == "target":
            return one(t)
        train_stage1(clean, cats, profile, res, evaluate=intervals, feats=feats)
        return None
    done = MD.run_parallel(run, jobs, parallelism=len(jobs))
    for t in tlist:               # keep the target order stable
        r = done[("target", t)]
        res.models[t] = r.models[t]
        res.report += r.report
    return res


def _serving_forests(res: TrainResult, feats: DataFrame, names: list[str], spec_name: str, targets: list[str],
                     cats: list[str] | None, profile: MD.Profile) -> TrainResult:
    """The forests of all targets (and, with ``cats``, of stage 1) grown together over one table."""
    wanted = {t: (MD.CANDIDATES[spec_name], TR.fwd_transform(t, TARGETS[t]), target_rows(t), names) for t in targets}
    if cats is not None:
        rnames = FE.recipe_feature_names(cats)
        counts = feats.agg(*[F.count(src).alias(char) for char, src in FE.STAGE1_SOURCE.items()]).first()
        res.stage1_feature_names = rnames
        chars = [c for c in FE.STAGE1_SOURCE if counts[c] >= MIN_STAGE1_ROWS]
        for c in chars:
            src = FE.STAGE1_SOURCE[c]
            wanted[f"stage1:{c}"] = (MD.STAGE1_SPEC, TR.stage1_fwd(c, src, FE.STAGE1_CHARS[c]), F.col(src).isNotNull(), rnames)
            res.stage1_report.append({"char": c, "n": counts[c], "R2": None, "transform": FE.STAGE1_CHARS[c] or "none"})
    fitted = MD.fit_forests(feats, wanted, profile)
    for t in targets:
        res.models[t] = TargetModel(t, [spec_name], [1.0], [fitted[t]])
        res.report.append({"target": t, "model": spec_name})
    for name, m in fitted.items():
        if name.startswith("stage1:"):
            res.stage1[name.removeprefix("stage1:")] = m
    return res
