"""Batched extremely randomised trees against a slow version on 200 rows, and batched ridge."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from permea.operators import growth as G
from permea.operators import ridge as R

N, NAMES, FILL = 200, list("abcdef"), float(np.float32(0.1))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(N, 6)).astype(np.float32).astype(float)
    x[:, 3] = rng.integers(0, 3, N)
    x[:, 4] = 1.0
    x[rng.random(N) < 0.2, 0] = np.nan
    y = x[:, 1] * 2 + np.nan_to_num(x[:, 0]) + rng.normal(size=N) * 0.1
    fold = rng.integers(0, 3, N)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i]), int(fold[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double, y double, fold int")
    table = G.pack(df, {c: F.col(c) for c in NAMES}, {"y": F.col("y"), "up": (F.col("y") > 0).cast("double")},
                   {"fold": F.col("fold")}, ["id", "y"])
    return x, y, fold, table


FITS = [G.Fit(label, G.Rows(((0, False, k),)), (0, 1, 2, 3, 4, 5), (FILL,) * 6, 4, 0.7, leaf, 30, 42, weights)
        for label, weights, leaf in ((0, None, 1), (0, None, 3), (1, (0.7, 1.6), 2)) for k in range(3)]


def slow_tree(fit, number, x, y, fold):
    xs = np.where(np.isnan(x), FILL, x)
    label = y if fit.label == 0 else (y > 0).astype(float)
    weight = np.ones(N) if fit.weights is None else np.where(label > 0.5, fit.weights[1], fit.weights[0])
    nodes = [{"rows": np.flatnonzero(fold != fit.train.tests[0][2])}]
    for i, node in enumerate(nodes):  # children are appended on the way
        r = node["rows"]
        node.update(value=np.average(label[r], weights=weight[r]), feature=-1)
        if len(r) < 2 * fit.min_leaf or len(r) < 2 or label[r].std() < 1e-12:
            continue
        hashes, seen, found = G.node_hash(fit.seed, number, i, 6), 0, []
        for f in sorted(range(6), key=lambda f: int(hashes[f]) >> 1):
            low, high = xs[r, f].min(), xs[r, f].max()
            if high <= low:
                continue
            seen += 1
            if seen > fit.drawn:
                break
            share = (int(G._mix(hashes[[f]])[0]) >> 11) * 2.0 ** -53
            cut = float(np.float32(low + share * (high - low)))
            cut = low if cut >= high else cut
            sides = r[xs[r, f] <= cut], r[xs[r, f] > cut]
            if min(map(len, sides)) >= fit.min_leaf:
                error = sum((weight[s] * (label[s] - np.average(label[s], weights=weight[s])) ** 2).sum() for s in sides)
                found.append((error, f, cut, sides))
        if found:
            least = min(e for e, *_ in found)
            _, f, cut, sides = min((c for c in found if c[0] <= least + 1e-9), key=lambda c: c[1])
            node.update(feature=f, cut=cut, left=len(nodes))
            nodes += [{"rows": s} for s in sides]
    return nodes


@pytest.mark.parametrize("cells", [1 << 22, 180])
def test_trees_equal_the_slow_version(data, monkeypatch, cells):
    monkeypatch.setattr(G, "CELLS", cells)  # 180: thirty nodes a pass
    x, y, fold, table = data
    fits = FITS if cells > 180 else [replace(f, trees=1) for f in (FITS[3], FITS[8])]
    for fit, trees in zip(fits, G.grow(table, fits), strict=True):
        for tree in trees:
            want = slow_tree(fit, tree.number, x, y, fold)
            assert [n["feature"] for n in want] == tree.feature
            assert [len(n["rows"]) for n in want] == tree.rows
            assert [n["value"] for n in want] == pytest.approx(tree.value, abs=1e-9)
            inner = [n for n in want if n["feature"] >= 0]
            assert [n["cut"] for n in inner] == pytest.approx([c for c, f in zip(tree.cut, tree.feature, strict=True) if f >= 0], abs=0)


def test_cuts_lie_between_values(data):
    x, *_, table = data
    trees = G.grow(table, FITS[:1])[0]
    cuts = [(f, c) for t in trees for f, c in zip(t.feature, t.cut, strict=True) if f in (1, 2, 5)]
    assert len(cuts) > 50 and sum(c in x[:, f] for f, c in cuts) < len(cuts) / 10


def test_held_out_predictions_and_groups_of_fits(data, monkeypatch):
    x, y, fold, table = data
    jobs = [(f"m{i // 3}", f, G.Rows(((0, True, i % 3),))) for i, f in enumerate(FITS)]
    once = {r.id: r for r in G.predict_held_out(table, jobs).collect()}
    monkeypatch.setattr(G, "NODES", 3000)  # a few fits at a time
    again = {r.id: r for r in G.predict_held_out(table, jobs).collect()}
    assert len(once) == N and all(tuple(again[i]) == pytest.approx(tuple(once[i]), abs=1e-12) for i in once)
    assert np.corrcoef(y, [once[i].m0 for i in range(N)])[0, 1] > 0.9


def test_spark_models_predict_the_same(spark, data):
    x, y, fold, table = data
    forests = G.grow(table, FITS)
    xs = np.where(np.isnan(x), FILL, x).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(xs)], "id int, v array<double>").withColumn("_x", array_to_vector("v"))
    for k, classes in ((0, False), (8, True)):
        want = G.predict(xs, [(t.arrays(), np.array(t.value)) for t in forests[k]])
        model = G.spark_model(spark, forests[k], 6, classes=classes)
        p = vector_to_array("_pred_prob")[1] if classes else F.col("_pred")
        got = [r.p for r in model.transform(df).select("id", p.alias("p")).orderBy("id").collect()]
        assert got == pytest.approx(list(want), abs=1e-12)
        assert model.getNumTrees == 4 and model.numFeatures == 6


def test_ridges_equal_closed_form(spark, data):
    x, y, fold, _ = data
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i]), int(fold[i])) for i in range(N)],
                               "id long, a double, b double, c double, d double, e double, f double, y double, fold int")
    table = G.pack(df, {c: F.col(c) for c in NAMES}, {"y": F.col("y")}, {"fold": F.col("fold")}, ["id"], np.float64)
    jobs = [("p", G.Fit(0, G.Rows(((0, False, k),)), (0, 1, 2, 3, 4, 5), (0.5,) * 6, 1), G.Rows(((0, True, k),))) for k in range(3)]
    got = {r.id: r.p for r in R.ridge_held_out(table, jobs, 20.0).collect()}
    xs = np.where(np.isnan(x), 0.5, x)
    for k in range(3):
        tr, te = fold != k, np.flatnonzero(fold == k)
        sd = xs[tr].std(0)
        z = (xs - xs[tr].mean(0)) / np.where(sd > 0, sd, 1)
        w = np.linalg.solve(z[tr].T @ z[tr] + 20 * np.eye(6), z[tr].T @ (y[tr] - y[tr].mean()))
        assert [got[i] for i in te] == pytest.approx(list(z[te] @ w + y[tr].mean()), abs=1e-9)


@pytest.mark.parametrize("rows", [40, 3000])
def test_nodes_are_added_up_by_themselves(rows):
    """Rows led on by nodes, their extremes and their sums below cuts, against row by row; nodes of few and of many rows."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(rows, 5)).astype(np.float32), rng.normal(size=rows)
    nodes = (np.array([0, 1, -1, -1, 2, -1, -1], np.int32), np.array([0, .3, 0, 0, -.2, 0, 0], np.float32), np.array([1, 3, -1, -1, 5, -1, -1], np.int32))
    nodes[0][2], nodes[2][2], nodes[0][4], nodes[2][4] = 2, 5, -1, -1
    slots = np.array([-1, -1, -1, 2, -1, 0, 1])  # node 4 is not open
    at, slot = G._placed(x, np.ascontiguousarray(x.T), nodes, slots, G._living(nodes[2], slots))
    ends = G.walk(x, *nodes)
    assert sorted(zip(at.tolist(), slot.tolist())) == [(i, int(slots[e])) for i, e in enumerate(ends) if slots[e] >= 0]
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    assert len(starts) == 3
    cuts = rng.normal(size=(3, 5)).astype(np.float32)
    low, high = G._extremes(x, at, starts)
    sums = G._left_sums(x, at, starts, cuts, np.stack([np.ones(len(at)), y[at]]))
    for i, s in enumerate(slot[starts]):
        own = np.flatnonzero(slots[ends] == s)
        assert (low[i] == x[own].min(axis=0)).all() and (high[i] == x[own].max(axis=0)).all()
        below = x[own] <= cuts[i]
        assert (sums[0, i] == below.sum(axis=0)).all() and sums[1, i] == pytest.approx((below * y[own][:, None]).sum(axis=0), abs=1e-9)
