"""Fold assignment by hashing (V1-V4): no global sort, no driver-side index.

Folds of even size (``with_even_fold``, ``balanced_group_folds``) take a global rank by hash.

``fold = hash(seed, key) mod k`` with the hash taken as the first 8 hex digits
of MD5, so the same assignment is reproducible in any engine.  Rows are
grouped by construction when the key is the recipe key (V2/V3): a recipe can
never fall into two folds.  numpy's shuffle order is not reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A unique row key of the recipe table: the four integer keys are not unique
# on their own, the price (in cents, exact in any engine) makes them so.
ROW_KEY_COLS = ["batch", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                "l_extendedprice"]
HASH_RANGE = float(16 ** 8)


FILE_ROW = ["source_file", "source_block", "source_row"]


def row_cols(df: DataFrame) -> list[str]:
    """The columns that identify a row of a recipe table: the derived table's
    keys, or file and place in the file (S1)."""
    for cols in (ROW_KEY_COLS, FILE_ROW):
        if set(cols) <= set(df.columns):
            return cols
    raise ValueError(f"no row key: a recipe table needs {FILE_ROW}")


def row_key(cols: list[str] = ROW_KEY_COLS) -> Column:
    parts = [F.round(F.col(c) * 100).cast("bigint").cast("string") if c == "l_extendedprice"
             else F.col(c).cast("string") for c in cols]
    return F.concat_ws("|", *parts)


def hash32(key: Column, seed: int | Column) -> Column:
    """Unsigned 32-bit hash of ``seed:key`` (first 8 hex digits of MD5)."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    h = F.md5(F.concat(s.cast("string"), F.lit(":"), key))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def with_fold(df: DataFrame, k: int, key: Column, seed: int = 42, name: str = "fold") -> DataFrame:
    """V1 (row key) / V2 (recipe key): fold id in ``0..k-1``."""
    return df.withColumn(name, (hash32(key, seed) % k).cast("int"))


def with_even_fold(df: DataFrame, k: int, key: Column, seed: int = 42, name: str = "fold") -> DataFrame:
    """V1: folds whose sizes differ by at most one: the global rank by hash, modulo ``k``."""
    from .order import global_rank
    ranked = global_rank(df, [hash32(key, seed), key], "_rank", held=1)
    return ranked.withColumn(name, (F.col("_rank") % k).cast("int")).drop("_rank")


def balanced_group_folds(df: DataFrame, k: int, group_col: str = "synth_key", seed: int = 42) -> DataFrame:
    """V2: (group, n rows, fold) with whole groups in folds of balanced size.

    The groups, longest first (equal ones by hash), are dealt to the folds in turn.  Two
    folds then differ by at most one largest group: of any two folds, the one that is
    dealt to first leads by a sum of differences between neighbours, which telescopes.
    Groups are counted with a partial aggregate, so a hot group is one row here."""
    from .order import global_rank
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(sizes, [-F.col("n"), hash32(F.col(group_col), seed), F.col(group_col)], "_rank")
    return ranked.select(group_col, "n", (F.col("_rank") % k).cast("int").alias("fold"))


def with_balanced_group_fold(df: DataFrame, k: int, group_col: str = "synth_key", seed: int = 42, name: str = "gfold") -> DataFrame:
    """``df`` with the folds of :func:`balanced_group_folds`."""
    folds = balanced_group_folds(df, k, group_col, seed).select(group_col, F.col("fold").alias(name))
    return df.join(folds, group_col)


def group_k(df: DataFrame, group_col: str = "synth_key", k: int = 5) -> int:
    """``min(k, number of groups)`` as the reference's GroupKFold uses."""
    n = df.agg(F.count_distinct(group_col)).first()[0]
    return max(1, min(k, n))


def with_holdout(df: DataFrame, key: Column, seed: int, test_size: float = 0.2,
                 name: str = "is_test") -> DataFrame:
    """V3/V4: test membership ``hash(seed, key) < test_size * 2^32``."""
    return df.withColumn(name, in_holdout(key, seed, test_size))


def in_holdout(key: Column, seed: int, test_size: float = 0.2) -> Column:
    return hash32(key, seed) < F.lit(test_size * HASH_RANGE)


def holdout_seeds(key: Column, seeds: list[int], test_size: float = 0.2) -> Column:
    """The seeds for which a row is a test row, ascending in their given order: what
    ``seeds_frame`` and ``in_holdout`` give, without a copy of the row for each seed."""
    return F.filter(F.array(*[F.when(in_holdout(key, s, test_size), F.lit(s)) for s in seeds]), lambda s: s.isNotNull())


def seeds_frame(df: DataFrame, seeds: list[int], name: str = "seed") -> DataFrame:
    """Replicate rows once per seed with ``explode`` (narrow, no join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(s) for s in seeds])))
