"""Batched boosting against a slow version: one fit, one node, one row at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permea.operators import boost as B
from permea.operators import growth as G

N = 240
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, 4))
    x[:, 2] = rng.integers(0, 3, N)
    x[rng.random(N) < 0.2, 0] = np.nan
    y = 2 * x[:, 1] + np.nan_to_num(x[:, 0]) ** 2 + rng.standard_t(2, N)
    fold = rng.integers(0, 3, N)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i]), int(fold[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double, fold int")
    columns = {c: F.col(c) for c in NAMES}
    edges = B.bin_edges(df, columns, 16)
    table = G.pack(df, columns, {"y": F.col("y")}, {"fold": F.col("fold")}, ["id"], edges=edges)
    return x, y, fold, edges, table


def slow(fit, x, y, edges):
    """(start, trees as nested tuples, predictions of all rows)"""
    x = np.where(np.isnan(x), fit.fill, x)
    train = np.flatnonzero(slow.fold != fit.train.tests[0][2])
    start = {"squared": np.mean, "huber": np.median}.get(fit.loss, lambda v: np.quantile(v, fit.alpha))(y[train])
    pred = np.full(len(y), start)
    for _ in range(fit.rounds):
        r = y - pred
        cut = np.quantile(np.abs(r[train]), fit.alpha)
        grad = r if fit.loss == "squared" else np.clip(r, -cut, cut) if fit.loss == "huber" else np.where(r >= 0, fit.alpha, fit.alpha - 1)
        leaves = [(train, np.arange(len(y)), 0)]
        done = []
        while leaves and (not fit.max_leaves or len(leaves) + len(done) < fit.max_leaves):
            best = None
            for at, (own, every, depth) in enumerate(leaves):
                if fit.max_depth and depth >= fit.max_depth:
                    continue
                gain_of = lambda v: v.sum() ** 2 / (len(v) + fit.l2)
                for f in range(4):
                    for e in edges[f]:
                        left = x[own, f] <= e
                        if min(left.sum(), (~left).sum()) < max(fit.min_leaf, 1):
                            continue
                        gain = gain_of(grad[own[left]]) + gain_of(grad[own[~left]]) - gain_of(grad[own])
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, at, f, e)
            if best is None:
                break
            _, at, f, e = best
            own, every, depth = leaves.pop(at)
            for side in (lambda rows: rows[x[rows, f] <= e], lambda rows: rows[x[rows, f] > e]):  # noqa: B023
                leaves.append((side(own), side(every), depth + 1))
        for own, every, _ in leaves + done:
            if fit.loss == "squared":
                value = grad[own].sum() / (len(own) + fit.l2)
            elif fit.loss == "quantile":
                value = np.quantile(r[own], fit.alpha)
            else:
                mid = np.median(r[own])
                value = mid + np.clip(r[own] - mid, -cut, cut).mean()
            pred[every] += fit.rate * value
    return pred


def fit_of(k, **options):
    return B.Boost(0, G.Rows(((0, False, k),)), (0, 1, 2, 3), (0.1, 0.0, 0.0, 0.0), 3, 0.3, **options)


KINDS = {
    "squared": dict(max_depth=2, min_leaf=4),
    "leafwise": dict(max_leaves=7, min_leaf=5, l2=0.5),
    "huber": dict(loss="huber", alpha=0.9, max_depth=2, min_leaf=4),
    "low": dict(loss="quantile", alpha=0.1, max_depth=2),
    "high": dict(loss="quantile", alpha=0.9, max_depth=1),
}


def test_all_losses_equal_the_slow_version(data, monkeypatch):
    monkeypatch.setattr(B, "WRITTEN", 2)  # the written predictions are read, too
    x, y, fold, edges, table = data
    slow.fold = fold
    fits = [fit_of(k, **options) for options in KINDS.values() for k in range(3)]
    names = [n for n in KINDS for _ in range(3)]
    booster = B.Booster(table, fits, edges)
    booster.fit()
    got = {r.id: r for r in booster.held_out(names, [G.Rows(((0, True, k),)) for _ in KINDS for k in range(3)]).collect()}
    for name, fit, k in zip(names, fits, [0, 1, 2] * len(KINDS), strict=True):
        want = slow(fit, x, y, edges)
        for i in np.flatnonzero(fold == k):
            assert got[i][name] == pytest.approx(want[i], abs=1e-9), (name, k)
    for name, trees, fit in zip(names, booster.trees, fits, strict=True):
        assert len(trees) == fit.rounds
        assert all(t.feature.count(-1) <= (fit.max_leaves or 2 ** fit.max_depth) for t in trees), name


def test_spark_model_is_the_same_sum(spark, data):
    from pyspark.ml.functions import array_to_vector
    x, y, fold, edges, table = data
    booster = B.Booster(table, [fit_of(0, **KINDS["leafwise"])], edges)
    booster.fit()
    trees = booster.as_trees(0)
    model = G.spark_model(spark, trees, 4, [1.0] * len(trees))
    filled = np.where(np.isnan(x), (0.1, 0, 0, 0), x)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(filled)], "id int, v array<double>")
    got = {r.id: r._pred for r in model.transform(df.withColumn("_x", array_to_vector("v"))).collect()}
    slow.fold = fold
    want = slow(fit_of(0, **KINDS["leafwise"]), x, y, edges)
    assert [got[i] for i in range(N)] == pytest.approx(list(want), abs=1e-9)


def test_quantile_models_cover_what_they_say(spark):
    """Held out, about 80 % of the rows lie between the 10 % and the 90 % model."""
    rng = np.random.default_rng(11)
    a = rng.uniform(-2, 2, 3000)
    y = a + (0.3 + np.abs(a)) * rng.normal(size=3000)
    df = spark.createDataFrame([(float(v), float(w), i % 3) for i, (v, w) in enumerate(zip(a, y, strict=True))], "a double, y double, fold int")
    columns = {"a": F.col("a")}
    edges = B.bin_edges(df, columns, 32)
    table = G.pack(df, columns, {"y": F.col("y")}, {"fold": F.col("fold")}, ["y"], edges=edges)
    fits = [B.Boost(0, G.Rows(((0, False, 0),)), (0,), (0.0,), 25, 0.2, "quantile", q, 3) for q in (0.1, 0.9)]
    booster = B.Booster(table, fits, edges)
    booster.fit()
    out = booster.held_out(["lo", "hi"], [G.Rows(((0, True, 0),))] * 2).where("lo IS NOT NULL").agg(
        F.avg((F.col("y").between(F.col("lo"), F.col("hi"))).cast("double"))).first()[0]
    assert 0.74 < out < 0.86
