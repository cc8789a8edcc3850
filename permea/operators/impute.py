"""Median imputation (P29) and standardisation (P30), fitted on a training set.

Fitting is one aggregate pass over all columns at once; the fitted values are
a handful of scalars per column, so applying them is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, exact_quantiles_of, exact_quantiles_without


def fit_medians(df: DataFrame, cols: list[str], method: str = "exact",
                accuracy: int = 100000) -> dict[str, float | None]:
    """Median of every column (None if the column is all NULL).

    ``method="exact"`` (default) is the numpy median at every size, by range
    narrowing (``exact_quantiles``); ``method="sketch"`` is
    ``percentile_approx`` at every size (rank error <= 1/accuracy).
    """
    if method == "exact":
        return exact_quantiles(df, {c: F.col(c) for c in cols})
    row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).cast("double").alias(c)
                   for c in cols]).first()
    return {c: row[c] for c in cols}


def fit_set_medians(df: DataFrame, cols: list[str], sets: list) -> list[dict[str, float | None]]:
    """For each condition the medians over its rows, in one set of passes."""
    return exact_quantiles_of(df, {c: F.col(c) for c in cols}, sets)


def fit_fold_medians(df: DataFrame, cols: list[str], fold: str, k: int) -> list[dict[str, float | None]]:
    """For each fold the medians over the rows of the other folds, in one set of passes."""
    return exact_quantiles_without(df, {c: F.col(c) for c in cols}, F.col(fold), list(range(k)))


def medians_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form (feature, median, n_missing, dropped), one row per feature."""
    medians = fit_medians(df, cols)
    n = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return df.sparkSession.createDataFrame(
        [(c, medians[c], n[c], medians[c] is None) for c in cols],
        "feature string, median double, n_missing long, dropped boolean")


def apply_medians(df: DataFrame, medians: dict[str, float | None],
                  indicators: list[str] = (), drop: bool = True) -> tuple[DataFrame, list[str]]:
    """Fill NULLs with the fitted medians; all-NULL columns are dropped.

    Returns the frame and the kept feature names plus the ``missing_<c>``
    columns of ``indicators`` (the columns that had NULLs when fitted).
    """
    kept = [c for c, m in medians.items() if m is not None]
    fills = {c: F.coalesce(F.col(c), F.lit(float(medians[c]))) for c in kept}
    names = list(kept)
    if indicators:
        ind = {f"missing_{c}": F.col(c).isNull().cast("double") for c in indicators}
        df = df.withColumns(ind)
        names += list(ind)
    out = df.withColumns(fills)
    if drop:
        out = out.drop(*[c for c, m in medians.items() if m is None])
    return out, names


def columns_with_nulls(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns that miss at least one value but not all."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if 0 < row[c] < row["_n"]]


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd per column (the reference scales by sd_pop)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"a__{c}"), F.stddev_pop(c).alias(f"s__{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"a__{c}"], row[f"s__{c}"]) for c in cols}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / sd; a zero-variance column is only centred."""
    out = {}
    for c, (m, s) in stats.items():
        if m is None:
            continue
        scale = s if s and s > 0 else 1.0
        out[c] = (F.col(c) - F.lit(m)) / F.lit(scale)
    return df.withColumns(out)


def scaler_table(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"a__{c}"), F.stddev_pop(c).alias(f"s__{c}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"a__{c}").alias("mean"),
                     F.col(f"s__{c}").alias("sd_pop")) for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
