"""Trees and boosted models grown whole in a task against the passes over Spark, and random forests against a slow version."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from permea.operators import boost as B
from permea.operators import growth as G
from permea.operators import models as MD
from permea.operators import whole as W
from permea.plans import audit as AU
from permea.plans import catalog
from permea.plans import training as TRN

N, NAMES = 260, list("abcdef")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 6)).astype(np.float32).astype(float)
    x[:, 3], x[:, 4] = rng.integers(0, 3, N), 1.0
    x[rng.random(N) < 0.2, 0] = np.nan
    y = x[:, 1] * 2 + np.nan_to_num(x[:, 0]) + rng.normal(size=N) * 0.1
    y[7] = np.nan
    fold = rng.integers(0, 3, N)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], None if np.isnan(y[i]) else float(y[i]), int(fold[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double, y double, fold int")
    labels = {"y": F.col("y"), "up": (F.col("y") > 0).cast("double")}
    return df, x, y, fold, G.pack(df, {c: F.col(c) for c in NAMES}, labels, {"fold": F.col("fold")}, ["id", "y"])


FITS = [G.Fit(label, G.Rows(((0, False, k),)), (0, 1, 2, 3, 4, 5), (0.25,) * 6, 5, 0.7, leaf, depth, 42, weights)
        for label, weights, leaf, depth in ((0, None, 1, 30), (0, None, 3, 4), (1, (0.7, 1.6), 2, 30)) for k in range(2)]


def same_tree(a, b):
    for c in ("feature", "left", "rows"):
        assert list(getattr(a, c)) == list(getattr(b, c)), c
    for c in ("cut", "value", "weight", "gain"):
        assert list(getattr(a, c)) == pytest.approx(list(getattr(b, c)), abs=1e-9), c


@pytest.mark.parametrize("together", [1 << 12, 40])
def test_trees_equal_those_of_the_passes(data, monkeypatch, together):
    monkeypatch.setattr(W, "TOGETHER", together)
    *_, table = data
    held = W.Table.read(table, np.float32)
    for fit, trees in zip(FITS, G.grow(table, FITS), strict=True):
        for t in trees:
            same_tree(W.grow_tree(fit, t.number, *held.training(fit)), t)


def test_held_out_by_passes_a_few_trees_at_a_time(data, monkeypatch):
    """A forest of more than ``NODES`` nodes is grown and added up in parts; the sums are those of whole trees."""
    *_, table = data
    jobs = [(f"m{i // 2}", f, G.Rows(((0, True, i % 2),))) for i, f in enumerate(FITS)]
    once = {r.id: r for r in G.predict_held_out(table, jobs).collect()}
    assert len(once) == N
    monkeypatch.setattr(W, "BYTES", 0)
    monkeypatch.setattr(G, "NODES", 1100)  # two trees of full depth
    assert [p.trees for p in G.pieces_of(FITS[0], N)] == [2, 2, 1] and [p.first for p in G.pieces_of(FITS[0], N)] == [0, 2, 4]
    most = []
    grow = G.grow
    monkeypatch.setattr(G, "grow", lambda t, fits: most.append(sum(f.trees * G._nodes_of(f, N) for f in fits)) or grow(t, fits))
    again = {r.id: r for r in G.predict_held_out(table, jobs).collect()}
    assert max(most) <= 1100
    for i, r in once.items():
        assert tuple(again[i]) == tuple(r)[:2] + tuple(v if v is None else pytest.approx(v, abs=1e-12) for v in tuple(r)[2:])
    model = G.forest(table, FITS[0], 6)
    assert model.getNumTrees == 5 and [t.numNodes for t in model.trees] == [len(t.feature) for t in grow(table, FITS[:1])[0]]


def test_written_forests_predict_the_same(spark, data):
    _, x, _, _, table = data
    xs = np.where(np.isnan(x), 0.25, x).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(xs)], "id int, v array<double>").withColumn("_x", array_to_vector("v"))
    want = G.predict(xs, [(t.arrays(), np.array(t.value)) for t in G.grow(table, FITS[:1])[0]])
    model = G.forest(table, FITS[0], 6)
    assert model._model is None  # not loaded before it is used
    assert [r._pred for r in model.transform(df).orderBy("id").collect()] == pytest.approx(list(want), abs=1e-12)


@pytest.mark.parametrize("options", [dict(max_leaves=7, min_leaf=5, l2=0.5), dict(loss="huber", alpha=0.9, max_depth=2, min_leaf=4),
                                     dict(loss="quantile", alpha=0.1, max_depth=2)])
def test_boosted_equal_the_passes(data, monkeypatch, options):
    df, *_ = data
    columns = {c: F.col(c) for c in NAMES}
    edges = B.bin_edges(df, columns, 16)
    table = G.pack(df, columns, {"y": F.col("y")}, {"fold": F.col("fold")}, ["id"], edges=edges)
    fits = [B.Boost(0, G.Rows(((0, False, k),)), (0, 1, 2, 3, 4, 5), (0.25,) * 6, 3 + k, 0.3, **options) for k in range(2)]
    a = B.Booster(table, fits, edges)
    a.fit()
    monkeypatch.setattr(W, "BYTES", 0)
    monkeypatch.setattr(B, "WRITTEN", 2)
    b = B.Booster(table, fits, edges)
    b.fit()
    assert a.start == pytest.approx(b.start, abs=1e-12)
    for own, other in zip(a.trees, b.trees, strict=True):
        for s, t in zip(own, other, strict=True):
            same_tree(s, t)


def slow_forest(fit, x, y, edges):
    """The values of every node of one random tree, node by node and cut by cut."""
    rows = np.repeat(np.arange(len(y)), np.random.default_rng((fit.seed, 0)).poisson(1.0, len(y)))
    nodes = [rows]
    out = []
    for i, own in enumerate(nodes):
        out.append(y[own].mean())
        if len(own) < 2 * fit.min_leaf or y[own].std() < 1e-12:
            continue
        drawn = sorted(np.argsort(G.node_hash(fit.seed, 0, i, x.shape[1]))[:int(np.ceil(fit.max_features * x.shape[1]))])
        error = lambda r: ((y[r] - y[r].mean()) ** 2).sum()
        found = []
        for f in drawn:
            for b in range(len(edges[f])):
                left = x[own, f] <= b
                if min(left.sum(), (~left).sum()) >= fit.min_leaf:
                    found.append((error(own[left]) + error(own[~left]), f, b, own[left], own[~left]))
        if found and min(found)[0] < error(own) - 1e-9:
            least = min(e for e, *_ in found)
            nodes += next(c for c in found if c[0] <= least + 1e-9)[3:]
    return out


@pytest.mark.parametrize("rows", [150, 700])  # 700: the root is added up by bins
def test_random_trees_equal_the_slow_version(rows):
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(rows, 5))
    edges = [np.quantile(raw[:, i], np.linspace(0, 1, 12)[1:-1]) for i in range(5)]
    x = np.column_stack([np.searchsorted(e, raw[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)
    y = raw[:, 0] + np.abs(raw[:, 1]) + rng.normal(size=rows) * 0.3
    for leaf in (1, 4):
        fit = G.Fit(0, G.Rows(()), (0, 1, 2, 3, 4), (0.0,) * 5, 1, 0.5, leaf, bins=True)
        tree = W.grow_tree(fit, 0, x, y, None)
        assert list(tree.value) == pytest.approx(slow_forest(fit, x, y, edges), abs=1e-9)


def test_random_forest_held_out_and_kept(data):
    df, x, y, fold, _ = data
    d = df.where("y IS NOT NULL")
    sizes = replace(MD.FAST, n_trees=30)
    o = MD.oof(d, "fold", 3, NAMES, "y", {"RF": MD.Spec("rf", 0.7)}, sizes)
    got = o.select("y", "oof_RF").toPandas()
    assert len(got) == N - 1 and got.notna().all().all() and np.corrcoef(got.y, got.oof_RF)[0, 1] > 0.9
    m = MD.fit(d, NAMES, "y", MD.Spec("rf", 0.7), sizes)
    p = m.transform(d, "p").select("y", "p").toPandas()
    assert m.model.getNumTrees == 30 and np.corrcoef(p.y, p.p)[0, 1] > 0.95


def test_an_empty_table(data):
    df, *_ = data
    o = MD.oof(df.where("id < 0"), "fold", 2, NAMES, "y", {"ET": MD.Spec("et", 0.5)}, MD.FAST)
    assert o.count() == 0 and "oof_ET" in o.columns


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["e4_audit_single_stage", "m12_interpolation_benchmark", "m12_leaderboard", "m13_cascade", "m1_forest_oof",
                                  "m2_boosted_oof", "m6_ensemble_blend"])
def test_comparisons_have_the_whole_sizes(spark, monkeypatch, name):
    """The queries that compare candidates ask for models of the reference's sizes, not for a part of them."""
    def asked(*args, **kwargs):
        raise Asked(next(a for a in args if isinstance(a, MD.Profile)))

    monkeypatch.setattr(catalog, "cleaned", lambda *a: None)
    monkeypatch.setattr(catalog, "_target_data", lambda *a: (None, None, []))
    monkeypatch.setattr(TRN, "feature_table", lambda *a: (None, [], []))
    monkeypatch.setattr(TRN, "target_frame", lambda *a: None)
    for module, function in ((MD, "oof"), (TRN, "train_target"), (AU, "leaderboard"), (AU, "interpolation_benchmark"), (AU, "audit_single_stage"),
                             (AU, "cascade")):
        monkeypatch.setattr(module, function, asked)
    monkeypatch.setattr(catalog, "_AUDITS", {})
    with pytest.raises(Asked) as e:
        catalog.QUERIES[name](spark, "nowhere")
    assert e.value.args[0] == MD.FULL
    if name == "m13_cascade":
        monkeypatch.setattr(catalog, "_audit", lambda *a: None)
        with pytest.raises(Asked) as e:
            catalog.QUERIES[name](spark, "nowhere")
        assert e.value.args[0] == MD.FULL
    spec = {"et": MD.CANDIDATES["ET.5"], "rf": MD.CANDIDATES["RF"]}
    assert all(MD.grown_fit(s, MD.FULL, 0, G.Rows(()), [0], [0.0]).trees == 400 for s in spec.values())
