"""Contiguous balanced shards from global byte prefix sums (DataFrame functions only).

Rows are put in one global order (id, then checksum, size and a row number),
range partitioned; each partition's total goes into a small table whose
running sum gives every partition its global start, so a row's place in the
whole corpus is its partition's start plus a running sum inside the partition.
The corpus is cut at equal byte targets: a row belongs to the shard in which
the middle of its bytes falls.

Defined cases: NULL text has no bytes (size 1, checksum of the empty string,
0); a NULL id comes first in the order; repeated rows are separate rows;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permea.session import materialize

ORDER = ["doc_id", "text_crc32", "size", "row"]


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, start (bytes before the row)."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    # The written table fixes which row is in which partition.
    dealt = materialize(rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "shard-dealt")

    # One row per partition: its size is the number of partitions.
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
                          F.sum("bytes").over(whole).alias("total"))

    inside = Window.partitionBy("part").orderBy(*ORDER)
    placed = (dealt.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("nth", F.row_number().over(inside))
              .join(F.broadcast(bases), "part")
              .withColumn("start", F.col("base") + F.col("run") - F.col("size"))
              .withColumn("place", F.col("base_n") + F.col("nth") - 1)
              .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(
                  f"({n_shards} * (2 * start + size)) div (2 * total)")).cast("int")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most n_shards rows
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), "start"))


def op4_prefix_shards(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
