"""Feature ranking: binned mutual information (P32) and correlation importance.

Mutual information unpivots the feature columns with ``explode`` (a narrow operator) and
aggregates per feature, correlations add up moments in the tasks; shuffles carry partial sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import sized
from .impute import apply_medians, fit_medians


def _unpivot(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    items = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names]
    return df.select(*keep, F.explode(F.array(*items)).alias("_u")).select(*keep, "_u.*")


def _bin(x, lo, hi, bins: int):
    width = hi - lo
    return F.when(hi > lo, F.least(F.floor((x - lo) / width * bins), F.lit(bins - 1))) \
        .otherwise(F.lit(0))


def mutual_info_topk(df: DataFrame, names: list[str], y: str, k: int = 20,
                     bins: int = 10) -> DataFrame:
    """Top-``k`` features by mutual information with ``y`` on equal-width bins.

    Median-imputed first (as in the reference's pipeline).  The reference uses
    a nearest-neighbour MI estimator; the binned estimator is the scalable
    counterpart: counts per (feature, x-bin, y-bin) are a partial aggregate.
    """
    med = fit_medians(df, names)
    filled, kept = apply_medians(df, med)
    ystats = filled.agg(F.min(y).alias("_ylo"), F.max(y).alias("_yhi"))
    yb = filled.crossJoin(F.broadcast(ystats)) \
        .withColumn("ybin", _bin(F.col(y), F.col("_ylo"), F.col("_yhi"), bins))
    u = _unpivot(yb, kept, ["ybin"])
    xs = u.groupBy("feature").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    u = u.join(F.broadcast(xs), "feature").withColumn(
        "xbin", _bin(F.col("x"), F.col("_lo"), F.col("_hi"), bins))
    # at most features x bins^2 rows: materialise once behind the size check,
    # since the marginals and the final sum all read it
    nxy = sized(
        u.groupBy("feature", "xbin", "ybin").agg(F.count(F.lit(1)).alias("nxy")))
    nx = nxy.groupBy("feature", "xbin").agg(F.sum("nxy").alias("nx"))
    ny = nxy.groupBy("feature", "ybin").agg(F.sum("nxy").alias("ny"))
    n = nxy.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = nxy.join(nx, ["feature", "xbin"]).join(ny, ["feature", "ybin"]).join(n, "feature")
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    mi = j.groupBy("feature").agg(F.sum(term).alias("mi"))
    from .rank import top_n
    ranked = top_n(mi, k, [F.desc(F.round("mi", 9)), F.asc("feature")])
    return ranked


def correlation_importance(df: DataFrame, names: list[str], labels: dict[str, Column], label: str = "target") -> DataFrame:
    """(``label``, feature, importance): |corr| of every feature with every label over the rows that have
    both; none where either is (nearly) constant, NaN or infinite.

    One pass in which a task adds up the moments of all pairs at once (rows are neither copied per
    label nor aggregated column by column); a task gives one row per pair, merged by Spark."""
    n_x, n_y = len(names), len(labels)
    data = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)],
                     *[c.cast("double").alias(f"y{i}") for i, c in enumerate(labels.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = _moments(*_columns(batch, "x", n_x), *_columns(batch, "y", n_y))
                total = found if total is None else _merge(total, found)
        if total is not None:
            at = np.arange(n_x * n_y)
            yield pa.RecordBatch.from_arrays([pa.array(at // n_y, pa.int32()), pa.array(at % n_y, pa.int32()),
                                              *[pa.array(m.ravel()) for m in total]], ["f", "t", *_MOMENTS])

    schema = "f int, t int, " + ", ".join(f"{m} double" for m in _MOMENTS)
    tasks = sized(data.mapInArrow(run, schema), "moments").where("n > 0")
    # Means as differences from one task's, so that a constant's are equal to the last bit.
    ref = tasks.groupBy("f", "t").agg(F.min("mx").alias("rx"), F.min("my").alias("ry"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    near = tasks.join(F.broadcast(ref), ["f", "t"]).withColumns({"mx": F.col("mx") - F.col("rx"), "my": F.col("my") - F.col("ry")})
    share = F.col("n") / F.col("all_n")
    mid = near.groupBy("f", "t").agg(F.sum(share * F.col("mx")).alias("cx"), F.sum(share * F.col("my")).alias("cy"))
    dx, dy = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")
    sums = near.join(F.broadcast(mid), ["f", "t"]).groupBy("f", "t").agg(
        F.max("all_n").alias("n"), F.max("all_bad").alias("bad"), F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"),
        F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"), F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"))
    sx, sy = F.sqrt(F.col("sxx") / F.col("n")), F.sqrt(F.col("syy") / F.col("n"))
    corr = F.when((F.col("bad") == 0) & (sx > 1e-12) & (sy > 1e-12), F.abs(F.try_divide(F.col("sxy") / F.col("n"), sx * sy)))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(i) + 1)
    return sums.select(pick(list(labels), "t").alias(label), pick(names, "f").alias("feature"), corr.alias("importance")) \
        .where(F.col("importance").isNotNull() & ~F.isnan("importance"))


#: Rows, means and sums of squared and mixed deviations of a pair, and how many of its rows are not finite.
_MOMENTS = ("n", "mx", "my", "sxx", "syy", "sxy", "bad")


def _columns(batch: pa.RecordBatch, kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns' values (0 where NULL) and whether each is not NULL."""
    cols = [batch.column(f"{kind}{i}") for i in range(n)]
    return (np.column_stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in cols]),
            np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in cols]))


def _moments(x: np.ndarray, has_x: np.ndarray, y: np.ndarray, has_y: np.ndarray) -> list[np.ndarray]:
    """The moments of every (feature, label) over the rows of a batch that have both."""
    def near(v: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        finite = np.isfinite(v)
        base = np.where(has.any(axis=0), v[has.argmax(axis=0), np.arange(v.shape[1])], 0.0)
        base = np.where(np.isfinite(base), base, 0.0)
        return np.where(has & finite, v - base, 0.0), base, (has & ~finite).astype(float)

    (x, x0, bad_x), (y, y0, bad_y) = near(x, has_x), near(y, has_y)
    wx, wy = has_x.astype(float), has_y.astype(float)
    n = wx.T @ wy
    m = np.maximum(n, 1.0)
    ax, ay = (x.T @ wy) / m, (wx.T @ y) / m
    return [n, x0[:, None] + ax, y0 + ay, np.maximum((x * x).T @ wy - n * ax * ax, 0.0),
            np.maximum(wx.T @ (y * y) - n * ay * ay, 0.0), x.T @ y - n * ax * ay, bad_x.T @ wy + wx.T @ bad_y]


def _merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * share
    # The first rows of a pair bring its means.
    mean = lambda i, d: np.where(a[0] == 0, b[i], np.where(b[0] == 0, a[i], a[i] + share * d))
    return [n, mean(1, dx), mean(2, dy), a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy,
            a[5] + b[5] + w * dx * dy, a[6] + b[6]]
