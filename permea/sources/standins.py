"""Stand-in predictions and risk scores (FIXTURES.md section 3).

They let the metric, blend, interval and ranking operators be checked
against SQL without a trained model: each is a fixed function of the row's
order keys applied to the measured targets of the deduplicated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import DOMAIN_FILTERS
from .fixture import TARGETS

ROW_ID = ["batch", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def target_long(clean: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (row, target) with a measured value inside the domain."""
    items = [F.struct(F.lit(k).alias("target"), F.col(c).alias("y")) for k, c in TARGETS.items()]
    keep = ROW_ID + ["synth_key"] + (extra or [])
    out = clean.select(*keep, F.explode(F.array(*items)).alias("t")) \
        .select(*keep, "t.target", "t.y").where(F.col("y").isNotNull())
    for key, (lo, hi) in DOMAIN_FILTERS.items():
        if hi is not None:
            out = out.where((F.col("target") != key) | (F.col("y") <= hi))
        if lo is not None:
            out = out.where((F.col("target") != key) | (F.col("y") >= lo))
    return out


def standin_predictions(clean: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Two stand-in candidates per row: ``pred_a`` and ``pred_b``."""
    t = target_long(clean, extra)
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    noise_a = ((ok + 3 * pk) % 11 - 5).cast("double") * 0.1
    noise_b = ((ok + 3 * pk + 5) % 11 - 5).cast("double") * 0.15
    return t.withColumns({"pred_a": F.col("y") + noise_a, "pred_b": F.col("y") + noise_b})


def standin_long(clean: DataFrame) -> DataFrame:
    """Stand-in predictions in long form (target, candidate, y, y_pred)."""
    w = standin_predictions(clean)
    c = F.explode(F.array(F.struct(F.lit("A").alias("candidate"), F.col("pred_a").alias("y_pred")),
                          F.struct(F.lit("B").alias("candidate"), F.col("pred_b").alias("y_pred"))))
    return w.select(*ROW_ID, "synth_key", "target", "y", c.alias("c")) \
        .select(*ROW_ID, "synth_key", "target", "y", "c.candidate", "c.y_pred")


def risk_scores(clean: DataFrame) -> DataFrame:
    """Failure label (Mg rejection < 80) and a stand-in risk score."""
    mg = F.col("mg_rej")
    return clean.where(mg.isNotNull()).select(
        *ROW_ID, "synth_key", "mg_rej",
        (mg < 80).cast("int").alias("fail"),
        F.round(1.0 - mg / 100.0 + 0.01 * (F.col("l_suppkey") % 10).cast("double"), 4).alias("score"))
