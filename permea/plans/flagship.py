"""Flagship: ingest -> key -> dedup -> measured score -> best row per monomer
pair -> top-N pairs (SURVEY section 7, minimum slice)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import with_composite
from ..operators.clean import clean_recipes
from ..operators.rank import best_per_group, top_n
from ..sources.fixture import ORDER_COLS

PAIR = ["smiles_part1", "smiles_part2"]
BEST_COLS = ["membrane", "pressure", "feed", "mg_rej", "li_rej", "flux_mg", "pwp",
             "score", "separation", "mg_quality", "li_quality"]


def measured_scores(raw: DataFrame) -> DataFrame:
    """Deduplicated rows with all four scored targets measured, plus P26.

    The presence filter runs *before* the dedup: the four targets are part
    of the dedup key, so a duplicate group is either wholly kept or wholly
    dropped by it, and filtering first is exact while it shrinks the sort and
    the shuffle of the dedup.
    """
    present = (F.col("mg_rej").isNotNull() & F.col("li_rej").isNotNull()
               & F.col("flux_mg").isNotNull() & F.col("pwp").isNotNull())
    return with_composite(clean_recipes(raw.filter(present)))


def best_measured_pairs(raw: DataFrame, n: int = 15) -> DataFrame:
    """Top-``n`` (aqueous, organic) monomer pairs by their best measured score."""
    scored = measured_scores(raw)
    best = best_per_group(scored, PAIR, "score", ORDER_COLS, payload=BEST_COLS,
                          count_name="n_measured")
    out = best.select(F.col("smiles_part1").alias("aq"), F.col("smiles_part2").alias("org"),
                      "membrane", "pressure", "feed",
                      *[F.round(c, 6).alias(c) for c in ["mg_rej", "li_rej", "flux_mg", "pwp"]],
                      F.round("score", 4).alias("score"),
                      F.round("separation", 4).alias("separation"),
                      F.round("mg_quality", 4).alias("mg_quality"),
                      F.round("li_quality", 4).alias("li_quality"),
                      "n_measured")
    return top_n(out, n, [F.desc("score"), F.asc("aq"), F.asc("org")])
