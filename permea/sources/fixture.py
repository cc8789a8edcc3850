"""The derived ``recipes`` table built from the driver's lineitem and part.

The reference's lab spreadsheets are not public, so the recipe table is derived
from TPC-H-like tables with portable arithmetic (FIXTURES.md section 2).  Batch 2
repeats the rows with ``l_orderkey % 50 = 0`` and stands for the same sheet
copied twice, which is what the dedup operator exists for.

Everything is a narrow projection of one lineitem x part join: Catalyst prunes
the scan to the nine lineitem and two part columns used here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values (FIXTURES.md section 2; index from 0) ----
MEMBRANES = ["Psf", "PES", "PAN", "PAI", "PK", "PE"]          # index 6 -> null
AQ_LIST = ["C1CNCCN1", "CC1CNCCN1", "CC1CNC(C)CN1", "NCC1CNCCN1", "OCCN1CCNCC1",
           "Nc1cccc(N)c1", "Nc1ccc(N)cc1", "{NCCN}3.4", "{NCCN}19", "{NCCN} 132",
           "NCCNCCN", "nan"]
ORG_LIST = ["O=C(Cl)C1=CC(C(=O)Cl)=CC(C(=O)Cl)=C1", "O=C(Cl)c1cccc(C(=O)Cl)c1",
            "O=C(Cl)c1ccc(C(=O)Cl)cc1", "O=C(Cl)CCCCC(=O)Cl", "O=C(Cl)C1CCC(C(=O)Cl)CC1"]

# Source order: unique within a batch, so (batch, ORDER_COLS) is a total order
# that reproduces "first in file / row order".
ORDER_COLS = ["batch", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
              "l_extendedprice", "l_shipdate"]

SMILES_COLS = [f"smiles_part{i}" for i in range(1, 6)]
DENS_COLS = [f"density_part{i}" for i in range(1, 6)]
TIME_COLS = [f"time_{i}" for i in range(1, 6)]
CHAR_COLS = ["wca", "zeta", "ra", "rq", "pore", "mwco", "thickness", "mod_temp", "mod_time"]
OP_COLS = ["pressure", "feed"]
MEMBRANE_COL = "membrane"
# Target key -> column (keys are the reference's target names).
TARGETS = {"PWP": "pwp", "Mg_rej": "mg_rej", "Flux_Mg": "flux_mg",
           "Li_rej": "li_rej", "Flux_Li": "flux_li"}
TARGET_COLS = list(TARGETS.values())
RECIPE_COLS = ([MEMBRANE_COL] + SMILES_COLS + DENS_COLS + TIME_COLS + CHAR_COLS
               + OP_COLS + TARGET_COLS)


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def pick(values: list, index: Column) -> Column:
    """``values[index]`` as a CASE expression; out of range gives null."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(~cond, value)


def _dbl(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def recipe_rows(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Batch-1 recipe rows: one per lineitem row joined to its part."""
    li = lineitem.select(*LINEITEM_COLS)
    pt = part.select(F.col("p_partkey"), F.col("p_size"))
    # part is a dimension keyed by part key; AQE picks broadcast at runtime
    # when the scanned size is under the threshold, sort-merge otherwise.
    j = li.join(pt, li.l_partkey == pt.p_partkey, "inner")
    ok, pk, sk, ln = (F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
                      F.col("l_linenumber"))
    size, disc, tax = F.col("p_size"), F.col("l_discount"), F.col("l_tax")
    null_s = F.lit(None).cast("string")
    null_d = F.lit(None).cast("double")
    dens1 = (F.ceil(F.col("l_quantity") / 10.0).cast("double") / 5.0).cast("string")
    cols = {
        "membrane": pick(MEMBRANES, sk % 7),
        "smiles_part1": pick(AQ_LIST, pk % 12),
        "smiles_part2": pick(ORG_LIST, sk % 5),
        "smiles_part3": F.when(ln == 3, pick(AQ_LIST, sk % 12)),
        "smiles_part4": null_s,
        "smiles_part5": null_s,
        "density_part1": F.when(ok % 97 == 0, F.lit("n/a")).otherwise(dens1),
        "density_part2": 0.1 + 0.05 * _dbl(sk % 3),
        "density_part3": F.when(ln == 3, F.lit(0.05)).cast("double"),
        "density_part4": null_d,
        "density_part5": null_d,
        "time_1": 30.0 * _dbl(1 + pk % 120),
        "time_2": 15.0 * _dbl(1 + sk % 3),
        "time_3": null_d, "time_4": null_d, "time_5": null_d,
        "wca": _null_if(pk % 5 == 0, 30.0 + _dbl(size)),
        "zeta": _null_if(pk % 3 == 0, _dbl(pk % 41 - 20)),
        "ra": null_d, "rq": null_d,
        "pore": _null_if(sk % 4 == 0, 0.25 + 0.01 * _dbl(sk % 40)),
        "mwco": _null_if(pk % 7 == 0, 150.0 + _dbl(pk % 500)),
        "thickness": _null_if(sk % 3 == 0, 20.0 + 3.0 * _dbl(size)),
        "mod_temp": null_d, "mod_time": null_d,
        "pressure": _null_if(ok % 11 == 0, 2.0 + _dbl(ln)),
        "feed": _null_if(ok % 13 == 0, 500.0 * _dbl(1 + ok % 4)),
        "pwp": _null_if(ok % 6 == 0, 3.0 + 0.3 * _dbl(size) + 20.0 * disc),
        "mg_rej": _null_if(ok % 10 == 0, 99.5 - 0.03 * _dbl(pk % 500) - 100.0 * disc),
        "flux_mg": _null_if(ok % 8 == 0, (2.0 + _dbl(ln)) * (1.0 + 0.1 * _dbl(size)) + 10.0 * tax),
        "li_rej": _null_if(ok % 9 == 0, 12.0 + _dbl(sk % 60) + 100.0 * disc),
        "flux_li": _null_if(ok % 7 == 0, (2.0 + _dbl(ln)) * (0.8 + 0.08 * _dbl(size)) + 10.0 * disc),
    }
    return j.select(*[F.col(c) for c in ORDER_COLS[1:]],
                    *[e.alias(n) for n, e in cols.items()])


def recipe_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two "sheets" of the fixture, each tagged with its batch number."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = recipe_rows(lineitem, part)
    b1 = rows.withColumn("batch", F.lit(1))
    b2 = rows.filter(F.col("l_orderkey") % 50 == 0).withColumn("batch", F.lit(2))
    return [b1.select(ORDER_COLS + RECIPE_COLS), b2.select(ORDER_COLS + RECIPE_COLS)]


#: lineitem rows of one task of the spread table: what it sorts as whole recipe rows stays in memory.
SPREAD_ROWS = 150_000


def recipes(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Raw recipe table (both batches, before dedup), in ``ORDER_COLS`` + ``RECIPE_COLS``.

    One scan and one join: the batch-2 copy is produced by ``explode`` on the
    same rows instead of a second scan plus union.  With ``spread`` the narrow
    lineitem rows are first dealt to even tasks, whatever files and row groups they come from.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    if spread:
        n = max(math.ceil(lineitem.count() / SPREAD_ROWS), spark.sparkContext.defaultParallelism)
        lineitem = lineitem.select(*LINEITEM_COLS).repartition(n)
    rows = recipe_rows(lineitem, part)
    batches = F.when(F.col("l_orderkey") % 50 == 0, F.array(F.lit(1), F.lit(2))) \
        .otherwise(F.array(F.lit(1)))
    return rows.withColumn("batch", F.explode(batches)).select(ORDER_COLS + RECIPE_COLS)
