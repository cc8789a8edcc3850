"""Exact top-k by inner product with Fagin's threshold algorithm.

Each block of rows keeps, for every dimension, its rows sorted by that
component.  A query reads the lists from the top where its own component is
positive and from the bottom where it is negative, all lists to the same depth;
rows met for the first time are scored in full.  No unseen row can score more
than the bound, the inner product of the query with the components at the
current depth, so the query stops as soon as the bound is below its kth best
score (an equal bound goes on, for the smaller ids win ties).  A block's best
rows of every query are merged by a second, small ranking.

The stated queries are dealt in blocks to every block of rows.  Defined cases:
vectors that are NULL or empty, or hold a NULL or non-finite component, take no part; a
query is ranked among the vectors of its own length; an id that is NULL is never a query and never a
result; rows that repeat an id are not candidates of a query with that id;
fewer than k candidates give all of them.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permea.session import materialize

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
FIRST_DEPTH = 8


class SortedLists:
    """The sorted lists of one block: ids ascending, ``rows`` (n x dims) integers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        self.lists = np.argsort(self.rows, axis=0, kind="stable").T.copy()  # ascending, by dimension
        self.values = np.take_along_axis(self.rows.T, self.lists, axis=1)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, best first, ties to the smaller id."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        weights, up = query[dims], query[dims] > 0
        seen = np.zeros(n, bool)
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        depth, step = 0, FIRST_DEPTH
        if not len(dims):  # every score is 0: the smallest ids
            at = np.flatnonzero(self.ids != own)[:k]
            return self.ids[at], np.zeros(len(at))
        forward, back = dims[up], dims[~up]
        while depth < n:
            end = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.lists[forward, n - end:n - depth].ravel()] = True
            met[self.lists[back, depth:end].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[self.ids[new] != own]
            if len(new):
                scores = self.rows[new] @ query
                at, scores = np.concatenate([best_at, new]), np.concatenate([best, scores])
                if len(at) > k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    keep = scores >= kth
                    at, scores = at[keep], scores[keep]
                order = np.lexsort((at, -scores))[:k]  # rows stand in the order of their ids
                best_at, best = at[order], scores[order]
            depth, step = end, step * 2
            edge = np.where(up, self.values[dims, n - end], self.values[dims, end - 1])
            if len(best) == k and weights @ edge < best[-1]:
                break
        return self.ids[best_at], best


def _finite(vec: str) -> F.Column:
    return F.expr(f"{vec} is not null and size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) "
                  f"and abs(x) < double('infinity'))")


def threshold_topk(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product
    (components floor(scale * x)) for each row for which ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = materialize(rows.filter(F.col("vec_id").isNotNull() & _finite("v")).select(
        "vec_id", "q", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"),
        F.size("v").alias("dims")), "topk-rows")
    sizes = materialize(rows.groupBy("dims").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("m")).filter("m > 0")
                        .select("dims", F.ceil(F.col("n") / ROWS_PER_BLOCK).cast("int").alias("n_blocks"),
                                F.ceil(F.col("m") / QUERIES_PER_BLOCK).cast("int").alias("q_blocks")), "topk-sizes")
    rows = rows.join(sizes, "dims")
    # A block is sent as it is; each query goes to every block of rows of its length.
    blocks = rows.select("dims", F.pmod(F.xxhash64("vec_id", "v"), F.col("n_blocks")).cast("int").alias("block"), "vec_id", "v",
                         F.lit(-1).alias("group"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("copy"))
    asked = rows.filter("q").select(
        "dims", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "vec_id", "v",
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("q_blocks")).cast("int").alias("group"))
    dealt = asked.withColumn("copy", F.col("group")).unionByName(blocks)

    def search(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        vecs = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        asking = group.column("group").to_numpy() >= 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not asking.all():
            lists = SortedLists(ids[~asking], vecs[~asking])
            for q, v in zip(ids[asking], vecs[asking].astype(np.float64), strict=True):
                found, scores = lists.search(v, q, k)
                out.append((np.full(len(found), q), found, scores.astype(np.int64)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    found = dealt.groupBy("dims", "block", "copy").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def op10_threshold_topk(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    return threshold_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
