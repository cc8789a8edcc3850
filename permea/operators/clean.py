"""Ingest cleaning: coerce (P1), recipe key (P2), dedup (P3), membrane (P4),
target presence (P5), domain filter (P6) and row/recipe counts (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.expr import to_number
from ..sources.fixture import (CHAR_COLS, DENS_COLS, MEMBRANE_COL, OP_COLS,
                               ORDER_COLS, SMILES_COLS, TARGET_COLS, TARGETS, TIME_COLS)

NUMERIC_COLS = DENS_COLS + TIME_COLS + CHAR_COLS + OP_COLS + TARGET_COLS
KEY_COLS = SMILES_COLS + DENS_COLS + TIME_COLS
#: File order of the file loader.
FILE_ORDER = ["source_file", "source_block", "source_row"]
DEDUP_COLS = ["synth_key"] + OP_COLS + TARGET_COLS

# ---- fixed values (model domain of the reference: rows beyond are excluded) ----
DOMAIN_FILTERS = {"Flux_Mg": (None, 40.0), "Flux_Li": (None, 30.0)}


def coerce_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns -> double; bad text cells -> NULL (never an error)."""
    cols = [c for c in (cols or NUMERIC_COLS) if c in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: (F.col(c).cast("double") if isinstance(types[c], NumericType) else to_number(c))
        for c in cols})


def with_synth_key(df: DataFrame, name: str = "synth_key") -> DataFrame:
    """Recipe identity from the 15 raw slot columns, NULL spelled ``nan``.

    ``concat_ws`` alone skips NULLs and would merge different recipes, hence the
    coalesce on every part.  Must run on raw values, before ``coerce_numeric``.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in KEY_COLS]
    return df.withColumn(name, F.concat_ws("|", *parts))


def source_order(df: DataFrame) -> list[str]:
    """The columns that give a table's file and row order."""
    for cols in (ORDER_COLS, FILE_ORDER):
        if set(cols) <= set(df.columns):
            return cols
    raise ValueError(f"no order columns: give order_cols, or a table with {ORDER_COLS} or {FILE_ORDER}")


def with_recipe_columns(df: DataFrame) -> DataFrame:
    """Every recipe column; those that the input lacks are NULL."""
    strings = [MEMBRANE_COL] + SMILES_COLS
    missing = [c for c in strings + NUMERIC_COLS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string" if c in strings else "double") for c in missing}) \
        if missing else df


def dedup_first(df: DataFrame, keys: list[str] | None = None,
                order_cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Keep the first row (in source order) of each duplicate group.

    A grouped ``min`` over ``struct(order..., rest...)`` instead of a window:
    the aggregate combines map-side, so a key holding a third of all rows is
    collapsed in every map task before the shuffle, and only one row per key
    and partition crosses the network.  NULL keys group together, as in pandas.
    ``keep`` names the columns needed of the row beside keys and order (all, if not given).
    Rows of a group that the order does not tell apart are told apart by these columns.
    """
    keys = keys or DEDUP_COLS
    order_cols = order_cols or source_order(df)
    if keep is not None:
        df = df.select(*[c for c in df.columns if c in keys or c in order_cols or c in keep])
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    first = F.min(F.struct(*[F.col(c) for c in order_cols + rest])).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order_cols + rest]) \
        .select(df.columns)


def fill_membrane(df: DataFrame, col: str = MEMBRANE_COL) -> DataFrame:
    """Missing base membrane -> ``Unk``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("Unk")))


def target_rows(df: DataFrame, target: str) -> DataFrame:
    """P5: rows where the target is measured."""
    return df.filter(F.col(TARGETS.get(target, target)).isNotNull())


def domain_filter(df: DataFrame, target: str) -> DataFrame:
    """Apply the target's domain rule (if any) to rows with that target."""
    col = TARGETS.get(target, target)
    out = target_rows(df, target)
    lo, hi = DOMAIN_FILTERS.get(target, (None, None))
    if lo is not None:
        out = out.filter(F.col(col) >= lo)
    if hi is not None:
        out = out.filter(F.col(col) <= hi)
    return out


def domain_filter_log(df: DataFrame) -> DataFrame:
    """P5/P6 log: per target, rows present, rule, rows excluded and kept.

    One pass: every count is a conditional aggregate over the same scan.
    """
    aggs = []
    for key, col in TARGETS.items():
        lo, hi = DOMAIN_FILTERS.get(key, (None, None))
        present = F.col(col).isNotNull()
        keep = present
        if lo is not None:
            keep = keep & (F.col(col) >= lo)
        if hi is not None:
            keep = keep & (F.col(col) <= hi)
        aggs += [F.count_if(present).alias(f"{key}__present"),
                 F.count_if(keep).alias(f"{key}__kept")]
    wide = df.agg(*aggs)
    rows = []
    for key in TARGETS:
        lo, hi = DOMAIN_FILTERS.get(key, (None, None))
        rule = f"[{lo}, {hi}]" if key in DOMAIN_FILTERS else None
        rows.append(F.struct(F.lit(key).alias("target"),
                             F.lit(rule).cast("string").alias("rule"),
                             F.col(f"{key}__present").alias("n_present"),
                             (F.col(f"{key}__present") - F.col(f"{key}__kept")).alias("n_excluded"),
                             F.col(f"{key}__kept").alias("n_kept")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ingest_counts(raw: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A10: rows before and after dedup and distinct recipes (one row), from one
    scan: the row counts of the duplicate groups are summed."""
    groups = raw.groupBy(*(keys or DEDUP_COLS)).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("synth_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")) \
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
             F.coalesce(F.sum("k"), F.lit(0)).alias("rows_after"), F.count("synth_key").alias("n_recipes"))


def clean_recipes(raw: DataFrame, order_cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """S1 -> P2 -> P3 -> P1: the training table of the reference's ingest (``keep``: see ``dedup_first``)."""
    return coerce_numeric(dedup_first(with_synth_key(with_recipe_columns(raw)), order_cols=order_cols, keep=keep))
