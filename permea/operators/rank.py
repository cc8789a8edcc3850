"""Best row per group (A1, A2) and ordered top-N (O1-O3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, keys: list[str], score: str, tiebreak: list,
                   payload: list[str] | None = None, count_name: str | None = None) -> DataFrame:
    """Highest ``score`` per group; ties go to the smallest ``tiebreak`` tuple.

    ``min_by`` over ``struct(-score, tiebreak...)`` is a two-phase aggregate
    (partial per map task, final per key): no sort of the group, no window, and
    a hot key is reduced before the shuffle.  A NULL score ranks last.
    """
    payload = payload or [c for c in df.columns if c not in keys]
    neg = F.coalesce(-F.col(score), F.lit(float("inf")))
    order = F.struct(neg.alias("_neg_score"),
                     *[(F.col(t) if isinstance(t, str) else t) for t in tiebreak])
    aggs = [F.min_by(F.struct(*[F.col(c) for c in payload]), order).alias("_best")]
    if count_name:
        aggs.append(F.count(F.lit(1)).alias(count_name))
    out = df.groupBy(*keys).agg(*aggs)
    extra = [count_name] if count_name else []
    return out.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload], *extra)


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """O1: ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task
    keeps its own top n, only n rows per task reach the final merge."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, group: list[str], n: int, order: list[Column],
                    rank_name: str = "rank") -> DataFrame:
    """O3: the first ``n`` rows per group, ranked 1..n.

    The rank filter plans as a group limit before and after the shuffle: every
    task keeps its own first ``n`` rows of a group, so one huge group sends n rows
    per task.  ``order`` must be a total order for the result to be deterministic.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= n)
