"""Exact integer k-means with the equal-average equal-variance nearest-centroid search.

For a vector x of d integers let S be the sum of its components and v = sqrt(d * sum(x^2) - S^2),
d times its deviation.  For every centroid c
d * |x - c|^2 >= (S_x - S_c)^2 + (v_x - v_c)^2.
Centroids stand sorted by S (their mean).  A vector starts at its own place in
that order and looks outward, each time at the nearer side: once the first term
alone exceeds the best distance so far nothing further out can win and the search ends;
where both terms exceed it the centroid is passed over; all others are measured exactly
in 64-bit integers.  Only bounds strictly over the best (with room for rounding) reject,
so equal distances go to the smaller number.

A round is one pass over the written integer vectors.  Each task holds the k centroids and
gives k sums and counts; only k rows of them reach the driver, and k centroids go out again.

Defined cases: a vector that is NULL, has another number of components, or a NULL or
non-finite one, takes no part; a NULL id is kept but starts no centroid while others can;
repeated ids are separate rows, ordered by their components where one must start;
fewer than k vectors give as many centroids; an empty table gives an empty result; extra
columns are ignored.  Scaled components are held within +-2^27, beyond which
distances of 64 components would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permea.session import materialize

LIMIT = 1 << 27
#: Vectors that one step of the search handles together.
ROWS = 8192


class CentroidSearch:
    """Nearest of ``centers`` (k x d integers); ``measured`` counts the exact distances."""

    def __init__(self, centers: np.ndarray):
        d = centers.shape[1]
        sums = centers.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.centers = centers[self.order]
        self.sums = sums[self.order].astype(np.float64)
        self.spread = _spread(self.centers)
        self.d, self.measured = d, 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of every row."""
        n, k = len(rows), len(self.centers)
        sums, spread = rows.sum(axis=1).astype(np.float64), _spread(rows)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k)
        right = np.searchsorted(self.sums, sums)  # next on the right, left + 1 is the next on the left
        left = right - 1
        live = np.arange(n)
        while len(live):
            lo, hi = left[live], right[live]
            gap_lo = np.where(lo >= 0, np.abs(sums[live] - self.sums[np.maximum(lo, 0)]), np.inf)
            gap_hi = np.where(hi < k, np.abs(sums[live] - self.sums[np.minimum(hi, k - 1)]), np.inf)
            take_lo = gap_lo <= gap_hi
            gap = np.where(take_lo, gap_lo, gap_hi)
            # (1 - 1e-9) covers the rounding of the bounds.
            bar = best[live].astype(np.float64) * self.d * (1 + 1e-9) + 1
            on = gap * gap <= bar
            live, take_lo, gap, bar = live[on], take_lo[on], gap[on], bar[on]
            at = np.where(take_lo, lo[on], hi[on])
            left[live] -= take_lo
            right[live] += ~take_lo
            apart = spread[live] - self.spread[at]
            near = gap * gap + apart * apart <= bar
            who, at = live[near], at[near]
            diff = rows[who] - self.centers[at]
            dist = np.einsum("ij,ij->i", diff, diff)
            self.measured += len(who)
            wins = (dist < best[who]) | ((dist == best[who]) & (self.order[at] < number[who]))
            best[who[wins]], number[who[wins]] = dist[wins], self.order[at][wins]
            live = live[(left[live] >= 0) | (right[live] < k)]
        return number, best


def _spread(rows: np.ndarray) -> np.ndarray:
    """d times the deviation of every row, from the centred components (no cancellation)."""
    x = rows.astype(np.float64)
    x -= x.mean(axis=1, keepdims=True)
    return np.sqrt(rows.shape[1] * np.einsum("ij,ij->i", x, x))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def integer_vectors(vectors: DataFrame, scale: int, d: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors of d finite components as integers floor(scale * x)."""
    x = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    x = x.filter(F.expr(f"size(v) = {d} AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"))
    held = lambda c: F.floor(F.least(F.greatest(F.lit(float(scale)) * c, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    return x.select("vec_id", F.transform("v", held).alias("v"))


def _assign(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    d = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CentroidSearch(centers)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                number, dist = search.nearest(_matrix(part, d))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(dist, pa.int64())],
                                                 ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long")


def _moved(rows: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors; empty ones stay."""
    k, d = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CentroidSearch(centers)
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(start, ROWS), d)
                number, _ = search.nearest(x)
                np.add.at(sums, number, x)
                counts += np.bincount(number, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, d), pa.int32()), pa.array(np.tile(np.arange(d), len(used)), pa.int32()),
             pa.array(sums[used].ravel(), pa.int64()), pa.array(np.repeat(counts[used], d), pa.int64())],
            ["cluster", "dim", "total", "n"])

    got = (rows.mapInArrow(run, "cluster int, dim int, total long, n long").groupBy("cluster", "dim")
           .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())  # k * d rows
    new = centers.copy()
    for r in got:
        new[r.cluster, r.dim] = r.total // r.n
    return new


def kmeans(rows: DataFrame, k: int, rounds: int, start: Column) -> tuple[DataFrame, np.ndarray]:
    """Assignments (vec_id, cluster, distance) and final centroids of the integer vectors of
    :func:`integer_vectors`; the first centroids are the k rows smallest by ``start``."""
    rows = materialize(rows, "centroid-vectors")
    first = rows.orderBy(start.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long"), np.zeros((0, 0), np.int64)
    centers = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        centers = _moved(rows, centers)
    return materialize(_assign(rows, centers), "centroid-assigned"), centers


def op12_mean_order_clusters(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    rows = integer_vectors(table(spark, sf_dir, "embeddings"), 1024, 64)
    start = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found, centers = kmeans(rows, 8, 10, start)
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centers.tolist())],
        "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.crossJoin(F.broadcast(found.agg(F.sum("distance").alias("inertia")))).join(F.broadcast(digests), "cluster")
    return found.join(F.broadcast(sums), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
