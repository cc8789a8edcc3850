"""Exact quantiles are the numpy ones, whatever the number of parts of a narrowing step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permea.operators import quantiles
from permea.operators.quantiles import exact_quantiles, exact_quantiles_without


@pytest.mark.parametrize("parts", [20, 512])
@pytest.mark.parametrize("prob", [0.1, 0.5, 0.9])
def test_matches_numpy(spark, parts, prob, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", parts)
    rng = np.random.default_rng(1)
    data = {"u": rng.normal(size=3001), "few": rng.integers(0, 4, 3001).astype(float), "one": np.full(3001, 2.5),
            "heavy": np.where(rng.random(3001) < 0.6, 1.0, rng.normal(size=3001)), "even": rng.exponential(size=3001)}
    rows = [tuple(float(data[c][i]) if not (c == "even" and i == 7) else None for c in data) for i in range(3001)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).withColumn("none", F.lit(None).cast("double"))
    got = exact_quantiles(df, {c: F.col(c) for c in [*data, "none"]}, prob)
    data["even"] = np.delete(data["even"], 7)
    assert got["none"] is None
    for c, v in data.items():
        assert got[c] == pytest.approx(float(np.quantile(v, prob)), abs=1e-12), c


def test_median_rule_does_not_change_with_size(spark):
    from permea.operators.impute import fit_medians
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "a double")
    assert fit_medians(df, ["a"]) == {"a": 3.0}
    assert fit_medians(df, ["a"], method="sketch") == {"a": 2.0}


def test_folds_left_out_in_one_set_of_passes(spark, monkeypatch):
    """Heavy ties, infinite and very small values, a column without values in a set, rows without a fold."""
    rng = np.random.default_rng(2)
    n = 4000
    fold = rng.integers(0, 4, n)
    cols = {"tied": np.where(rng.random(n) < 0.5, 3.0, rng.normal(size=n)), "wide": rng.choice([1e-300, -1e300, 0.0, -0.0, 5.0], n),
            "ends": np.where(rng.random(n) < 0.3, np.inf, -np.inf), "some": np.where(fold == 2, rng.normal(size=n), np.nan)}
    rows = [(None if i % 97 == 0 else int(fold[i]), *(float(v[i]) for v in cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, tied double, wide double, ends double, some double").repartition(7)
    passes = []
    counts = quantiles._counts
    monkeypatch.setattr(quantiles, "_counts", lambda *a: passes.append(1) or counts(*a))
    sets = [None, 0, 1, 2, 3]
    got = exact_quantiles_without(df, {c: F.col(c) for c in cols}, F.col("fold"), sets, 0.37)
    assert len(passes) <= 9
    for out, result in zip(sets, got, strict=True):
        keep = np.array([out is None or i % 97 == 0 or fold[i] != out for i in range(n)])
        for c, v in cols.items():
            own = v[keep][~np.isnan(v[keep])]
            if c == "ends":  # between two infinities numpy has no value
                assert result[c] in (np.inf, -np.inf) or np.isnan(result[c])
            else:
                want = None if not len(own) else float(np.quantile(own, 0.37))
                assert result[c] == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-300))


def test_no_task_gathers_the_values(spark):
    """A value of half of all rows needs no window and no sort: the plans have none."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.rand(3)).alias("x"))
    assert exact_quantiles(df, {"x": F.col("x")}, 0.75)["x"] == 1.0
    assert not hasattr(quantiles, "Window")


@pytest.mark.parametrize("parts", [1, 7, 512])
def test_sorted_runs_count_as_single_keys(parts):
    """The parts of sorted keys, many or none of them in the range, are those of the keys one by one."""
    rng = np.random.default_rng(5)
    groups = np.array([3, 4, 9])
    low, high = np.full(10, np.iinfo(np.int64).min), np.full(10, np.iinfo(np.int64).max)
    low[4], high[4] = quantiles.keys_of(np.array([-0.5, 0.5]))
    low[9], high[9] = quantiles.keys_of(np.array([7.0, 8.0]))  # holds nothing
    one, runs = quantiles.Parts(groups, low, high, parts), quantiles.Parts(groups, low, high, parts)
    for _ in range(3):
        for i in range(3):
            keys = quantiles.keys_of(np.append(rng.normal(size=400), [0.5, -0.5, 0.0, -0.0, np.inf, -1e300, 0.25, 0.25]))
            one.add(np.full(len(keys), i), keys)
            runs.add_sorted(i, np.sort(keys))
        runs.add_sorted(1, keys[:0])
    assert one.batch().equals(runs.batch()) and one.n.sum() == runs.n.sum() > 0
