"""Evaluation metrics as grouped aggregates.

Every metric is a single ``agg`` (partial aggregation per task, merged per
group), so scoring millions of predictions costs one narrow pass plus a
shuffle of one row per group and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_corr


def regression_metrics(df: DataFrame, group: list[str], y: str = "y", p: str = "y_pred",
                       tail_below: float = 90.0) -> DataFrame:
    """A4: n, R2, RMSE, MAE, bias and tail MAE (y < ``tail_below``) per group.

    R2 is ``1 - SSE / (n * var_pop(y))`` (sklearn's definition), not
    ``regr_r2`` which is the squared correlation.  Zero variance -> NULL.
    """
    err = F.col(p) - F.col(y)
    n = F.count(F.lit(1))
    sse = F.sum(err * err)
    var = F.var_pop(y)
    tail = F.col(y) < tail_below
    return df.groupBy(*group).agg(
        n.alias("n"),
        F.when(var > 0, 1.0 - sse / (var * n)).alias("r2"),
        F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("bias"),
        F.avg(F.when(tail, F.abs(err))).alias("tail_mae"))


def mean_sd(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Mean, population sd, min and max of metrics over repeats."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*group).agg(*aggs)


def score_buckets(df: DataFrame, score: str, label: str, group: list[str] | None = None,
                  decimals: int = 4) -> DataFrame:
    """Pre-aggregate to one row per (group, rounded score): n_pos, n_neg."""
    group = group or []
    return (df.withColumn("_s", F.round(F.col(score), decimals))
              .groupBy(*group, "_s")
              .agg(F.count_if(F.col(label) == 1).alias("n_pos"),
                   F.count_if(F.col(label) == 0).alias("n_neg")))


def auc_ap(df: DataFrame, score: str = "score", label: str = "fail",
           group: list[str] | None = None, decimals: int = 4) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum).

    The cumulative windows run on the bucket table (at most 10^decimals rows
    per group per unit of score range), never on raw rows.  AP is the
    step-wise sum used by sklearn, not Spark's trapezoidal ``areaUnderPR``.
    One class only -> NULL.
    """
    group = group or []
    b = score_buckets(df, score, label, group, decimals)
    asc = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    desc = Window.partitionBy(*group).orderBy(F.desc("_s")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = (b.withColumn("neg_below", F.coalesce(F.sum("n_neg").over(asc), F.lit(0)))
          .withColumn("tp", F.sum("n_pos").over(desc))
          .withColumn("fp", F.sum("n_neg").over(desc)))
    agg = b.groupBy(*group).agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"),
        F.sum(F.col("n_pos") * F.col("neg_below") + 0.5 * F.col("n_pos") * F.col("n_neg"))
         .alias("_auc_num"),
        F.sum(F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap_num"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(*group, "n_pos", "n_neg",
                      F.when(ok, F.col("_auc_num") / (F.col("n_pos") * F.col("n_neg")))
                       .alias("roc_auc"),
                      F.when(F.col("n_pos") > 0, F.col("_ap_num") / F.col("n_pos"))
                       .alias("average_precision"))


def alert_metrics(df: DataFrame, prob: str = "score", label: str = "fail",
                  alert_at: float = 0.2, group: list[str] | None = None) -> DataFrame:
    """Recall, precision, number alerted, failure rate at ``prob >= alert_at``."""
    alert = F.col(prob) >= alert_at
    pos = F.col(label) == 1
    n_pos = F.count_if(pos)
    n_alert = F.count_if(alert)
    tp = F.count_if(alert & pos)
    return df.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"), n_pos.alias("n_failure"),
        (n_pos / F.count(F.lit(1))).alias("failure_rate"),
        F.when(n_pos > 0, tp / n_pos).alias("recall_at_alert"),
        F.when(n_alert > 0, tp / n_alert).alias("precision_at_alert"),
        n_alert.alias("n_alerted"))


def target_summary(df: DataFrame, y: str, group: list[str] | None = None) -> DataFrame:
    """Mean, population sd, min, max and counts below 80 / 85 / 90."""
    c = F.col(y)
    return df.where(c.isNotNull()).groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"),
        F.min(c).alias("min"), F.max(c).alias("max"),
        F.count_if(c < 80).alias("n_lt80"), F.count_if(c < 85).alias("n_lt85"),
        F.count_if(c < 90).alias("n_lt90"))


def histogram(df: DataFrame, y: str, bins: int = 30, group: list[str] | None = None) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed).

    min/max come from one aggregate row joined back by group (one row per
    group: a tiny broadcast); binning is ``width_bucket``.
    """
    group = group or []
    d = df.where(F.col(y).isNotNull())
    mm = d.groupBy(*group).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    j = d.join(F.broadcast(mm), group, "inner") if group else d.crossJoin(F.broadcast(mm))
    wb = F.when(F.col("_hi") > F.col("_lo"),
                F.least(F.expr(f"width_bucket({y}, _lo, _hi, {bins})"), F.lit(bins)) - 1) \
        .otherwise(F.lit(0))
    return (j.withColumn("bin", wb.cast("int"))
             .groupBy(*group, "bin")
             .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("lo"),
                  F.first("_hi").alias("hi")))


def fold_failure_counts(df: DataFrame, y: str, fold: str = "fold", threshold: float = 80.0,
                        min_fail: int = 14, min_ok: int = 20) -> DataFrame:
    """Per training fold (all rows outside the fold), failures vs not,
    and whether the cascade falls back to the single regressor."""
    per = df.groupBy(fold).agg(F.count_if(F.col(y) < threshold).alias("_f"),
                               F.count(F.lit(1)).alias("_n"))
    tot = per.agg(F.sum("_f").alias("_tf"), F.sum("_n").alias("_tn"))
    j = per.crossJoin(F.broadcast(tot))
    n_fail = F.col("_tf") - F.col("_f")
    n_ok = (F.col("_tn") - F.col("_n")) - n_fail
    return j.select(F.col(fold), n_fail.alias("train_failures"), n_ok.alias("train_non_failures"),
                    ((n_fail < min_fail) | (n_ok < min_ok)).alias("fallback"))


def shap_summary(phi: DataFrame, top_k: int = 20, feature: str = "feature", value: str = "phi",
                 x: str = "x") -> DataFrame:
    """Mean |phi|, mean phi, corr(x, phi) (NULL if either sd <= 1e-12), top-k."""
    s = phi.groupBy(feature).agg(
        F.avg(F.abs(value)).alias("mean_abs_shap"), F.avg(value).alias("mean_shap"),
        safe_corr(x, value).alias("direction_corr"))
    return s.orderBy(F.desc(F.round("mean_abs_shap", 9)), feature).limit(top_k)


def rank_methods(df: DataFrame, group: list[str], r2: str = "r2", mae: str = "mae",
                 name: str = "rank") -> DataFrame:
    """O2: order methods by (-R2, MAE) within each group (a few rows per group)."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.round(r2, 9)), F.round(mae, 9))
    return df.withColumn(name, F.dense_rank().over(w))
