"""Feature engineering (P11-P20, P29, P30, P33) as one projection chain.

The monomer descriptors are computed once on the distinct-monomer dimension
and brought back with five size-checked broadcast joins (one per slot): the
big recipe table is never shuffled for them.  Everything else is column
arithmetic that stays inside one whole-stage-codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chem import DESC_KEYS, descriptors, parse_monomer, strip
from ..functions.expr import clip
from ..sources.fixture import DENS_COLS, MEMBRANE_COL, SMILES_COLS
from .dims import sized
from .quantiles import exact_quantiles

# ---- fixed values (renamed characterisation columns, ion radii, fallbacks) ----
CHAR_RENAME = {"wca": "WCA_d", "zeta": "Zeta_Potential", "ra": "Ra_nm", "rq": "Rq_nm",
               "pore": "Average_pore_diameter", "mwco": "MWCO_Da",
               "thickness": "Thickness_nm", "mod_temp": "Modification_Temperature_C",
               "mod_time": "Modification_Time_s"}
R_MG, R_LI = 0.428, 0.382           # hydrated radii, nm
PRESSURE_FALLBACK, FEED_FALLBACK = 5.0, 1000.0

PHYSICS_COLS = ["zeta_sq", "zeta_abs", "steric_Mg", "steric_Li", "steric_gap",
                "donnan_proxy", "pore_sq", "mwco_per_thk", "log_mwco"]
STRUCTURE_COLS = [f"mw_tag_{j}" for j in range(1, 6)] + ["wtd_mw_tag", "n_steps", "n_polymer"]
SYNTH_COLS = ["D1_aq", "D2_org", "T1_rxn", "T2_rxn", "conc_x_time", "sqrt_t1", "sqrt_t2",
              "d_ratio", "d1_sq", "d1_x_d2", "ip_balance"]
OP_FEATURES = ["pressure", "feed", "p_sq", "p_x_feed", "log_feed"]
MOL_COLS = [f"agg_{k}" for k in DESC_KEYS] + [f"wtd_{k}" for k in DESC_KEYS]
CHAR_FEATURES = list(CHAR_RENAME.values())
# Stage-1 characterisation targets and their transform.
STAGE1_CHARS = {"Zeta_Potential": None, "Average_pore_diameter": None,
                "MWCO_Da": "log", "WCA_d": None, "Thickness_nm": None}
STAGE1_SOURCE = {"Zeta_Potential": "zeta", "Average_pore_diameter": "pore",
                 "MWCO_Da": "mwco", "WCA_d": "wca", "Thickness_nm": "thickness"}


def _z(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


# ------------------------------------------------------------------ P11/P12
def monomer_dim(df: DataFrame, slots: list[str] = SMILES_COLS) -> DataFrame:
    """Distinct monomers over all slots with their P11 descriptors and what P14 reads from their text."""
    m = (df.select(F.explode(F.array(*[F.col(c) for c in slots])).alias("smiles"))
           .where(F.col("smiles").isNotNull()).distinct())
    d = descriptors("smiles") | slot_text("smiles")
    return m.select("smiles", *[v.alias(k) for k, v in d.items()])


def slot_text(c) -> dict[str, Column]:
    """P14 of one slot: the tag of a polymer, and whether there is any text (else NULL)."""
    return {"tag": parse_monomer(c)[1], "filled": F.when(F.col(c).isNotNull() & (strip(F.col(c).cast("string")) != ""), 1.0)}


def with_molecular_inline(df: DataFrame) -> DataFrame:
    """P12 without the dimension join: descriptors evaluated per slot in the
    projection.  Needed on streams (no count or distinct there); more CPU per
    row, no shuffle and no broadcast."""
    cols = {}
    per_slot = [descriptors(c) for c in SMILES_COLS]
    for k in DESC_KEYS:
        vals = [per_slot[j][k] for j in range(5)]
        wts = [_z(DENS_COLS[j]) for j in range(5)]
        cols[f"agg_{k}"] = vals[0] + vals[1] + vals[2] + vals[3] + vals[4]
        p = [v * w for v, w in zip(vals, wts)]
        cols[f"wtd_{k}"] = p[0] + p[1] + p[2] + p[3] + p[4]
    return df.withColumns(cols)


def _with_dimension(df: DataFrame, dim: DataFrame | None) -> DataFrame:
    """``df`` with P12's columns and each slot's row of the dimension as a struct ``_d<slot>``."""
    dim = dim if dim is not None else sized(monomer_dim(df))
    out = df
    for j, c in enumerate(SMILES_COLS, 1):
        dj = dim.select(F.col("smiles").alias(f"_s{j}"), F.struct(*[k for k in dim.columns if k != "smiles"]).alias(f"_d{j}"))
        out = out.join(dj, out[c] == dj[f"_s{j}"], "left")
    cols = {}
    for k in DESC_KEYS:
        vals = [_z(f"_d{j}.{k}") for j in range(1, 6)]
        wts = [_z(DENS_COLS[j - 1]) for j in range(1, 6)]
        cols[f"agg_{k}"] = vals[0] + vals[1] + vals[2] + vals[3] + vals[4]
        p = [v * w for v, w in zip(vals, wts)]
        cols[f"wtd_{k}"] = p[0] + p[1] + p[2] + p[3] + p[4]
    return out.withColumns(cols).drop(*[f"_s{j}" for j in range(1, 6)])


def with_molecular(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """``agg_*`` (sum over the five slots) and ``wtd_*`` (density-weighted)."""
    if df.isStreaming and dim is None:
        return with_molecular_inline(df)
    return _with_dimension(df, dim).drop(*_DIM_COLS)


_DIM_COLS = [f"_d{j}" for j in range(1, 6)]


def _slots_of(x: DataFrame, dim: DataFrame | None) -> list[dict[str, Column]]:
    """``slot_text`` of the five slots: looked up where the joined dimension has it (the one made of
    the table's own monomers), else worked out row by row."""
    if dim is None and _DIM_COLS[0] in x.columns:
        return [{k: F.col(f"{d}.{k}") for k in ("tag", "filled")} for d in _DIM_COLS]
    return [slot_text(c) for c in SMILES_COLS]


# ------------------------------------------------------------------ P13
def synthesis_columns() -> dict[str, Column]:
    D1, D2 = _z("density_part1"), _z("density_part2")
    T1, T2 = _z("time_1"), _z("time_2")
    ratio = (D1 * F.greatest(F.col("agg_n_amine"), F.lit(0.0))) / \
            (D2 * F.greatest(F.col("agg_nCl"), F.lit(0.0)) + 1e-6)
    return {"D1_aq": D1, "D2_org": D2, "T1_rxn": T1, "T2_rxn": T2,
            "conc_x_time": D1 * T1,
            "sqrt_t1": F.sqrt(clip(T1, 0.0)), "sqrt_t2": F.sqrt(clip(T2, 0.0)),
            "d_ratio": D1 / (D2 + 1e-6), "d1_sq": D1 * D1, "d1_x_d2": D1 * D2,
            "ip_balance": clip(ratio, 0.0, 50.0)}


# ------------------------------------------------------------------ P14
def structure_columns(slots: list[dict[str, Column]] | None = None) -> dict[str, Column]:
    slots = slots or [slot_text(c) for c in SMILES_COLS]
    tags = [s["tag"] for s in slots]
    cols = {f"mw_tag_{j}": t for j, t in enumerate(tags, 1)}
    filled = [_z(s["filled"]) for s in slots]
    poly = [F.when(t.isNotNull(), 1.0).otherwise(0.0) for t in tags]
    wtd = [_z(t) * _z(DENS_COLS[j]) for j, t in enumerate(tags)]
    cols["wtd_mw_tag"] = wtd[0] + wtd[1] + wtd[2] + wtd[3] + wtd[4]
    cols["n_steps"] = filled[0] + filled[1] + filled[2] + filled[3] + filled[4]
    cols["n_polymer"] = poly[0] + poly[1] + poly[2] + poly[3] + poly[4]
    return cols


# ------------------------------------------------------------------ P15
def operating_medians(df: DataFrame) -> DataFrame:
    """One-row table of the batch medians, with fallbacks when all missing."""
    m = exact_quantiles(df, {"p": F.col("pressure"), "f": F.col("feed")})
    p = PRESSURE_FALLBACK if m["p"] is None else m["p"]
    f = FEED_FALLBACK if m["f"] is None else m["f"]
    return df.sparkSession.createDataFrame([(float(p), float(f))], "_med_p double, _med_f double")


def with_operating(df: DataFrame, medians: DataFrame | dict | None = None) -> DataFrame:
    """Fill pressure/feed with the batch median (or given medians).

    The medians are one aggregated row: joining it is a broadcast of exactly
    one row, a scalar sub-query in effect.  ``medians`` may also be a dict of
    fitted values ({"pressure": .., "feed": ..}), which is what a stream uses.
    """
    if isinstance(medians, dict):
        out = df.withColumns({
            "_med_p": F.lit(float(medians.get("pressure") or PRESSURE_FALLBACK)),
            "_med_f": F.lit(float(medians.get("feed") or FEED_FALLBACK))})
    else:
        med = medians if medians is not None else operating_medians(df)
        out = df.crossJoin(F.broadcast(med))
    P = F.coalesce(F.col("pressure"), F.col("_med_p"))
    Fe = F.coalesce(F.col("feed"), F.col("_med_f"))
    return out.withColumns({"_P": P, "_F": Fe}).withColumns({
        "pressure": F.col("_P"), "feed": F.col("_F"),
        "p_sq": F.col("_P") * F.col("_P"), "p_x_feed": F.col("_P") * F.col("_F"),
        "log_feed": F.log1p(F.col("_F"))}).drop("_P", "_F", "_med_p", "_med_f")


# ------------------------------------------------------------------ P16/P17
def physics_columns() -> dict[str, Column]:
    zeta, pore = F.col("zeta"), F.col("pore")
    mwco, thick = F.col("mwco"), F.col("thickness")
    st_mg = pore / (2 * R_MG)
    st_li = pore / (2 * R_LI)
    return {"zeta_sq": zeta * zeta, "zeta_abs": F.abs(zeta),
            "steric_Mg": st_mg, "steric_Li": st_li, "steric_gap": st_li - st_mg,
            "donnan_proxy": zeta * zeta / (pore * pore + 1e-6), "pore_sq": pore * pore,
            "mwco_per_thk": mwco / (thick + 1e-6), "log_mwco": F.log1p(clip(mwco, 0.0))}


# ------------------------------------------------------------------ P18
def membrane_categories(df: DataFrame) -> list[str]:
    """Sorted distinct membranes (missing -> ``Unk``); a handful of values."""
    rows = (df.select(F.coalesce(F.col(MEMBRANE_COL), F.lit("Unk")).alias("m"))
              .distinct().orderBy("m").collect())
    return [r.m for r in rows]


def onehot_columns(categories: list[str]) -> dict[str, Column]:
    m = F.coalesce(F.col(MEMBRANE_COL), F.lit("Unk"))
    return {f"base_{c}": (m == F.lit(c)).cast("double") for c in categories}


# ------------------------------------------------------------------ P19/P20
def feature_names(categories: list[str]) -> list[str]:
    return (CHAR_FEATURES + PHYSICS_COLS + STRUCTURE_COLS + SYNTH_COLS + OP_FEATURES
            + MOL_COLS + [f"base_{c}" for c in categories])


def recipe_feature_names(categories: list[str]) -> list[str]:
    return SYNTH_COLS + OP_FEATURES + MOL_COLS + [f"base_{c}" for c in categories]


def build_features(df: DataFrame, categories: list[str], keep: list[str] | None = None,
                   medians: DataFrame | None = None, monomers: DataFrame | None = None,
                   names: list[str] | None = None, recipe_only: bool = False) -> DataFrame:
    """P19 (or P20 with ``recipe_only``): the model matrix as named double columns.

    ``df`` must be coerced (P1).  ``names`` aligns to a saved order; a name
    not produced here becomes a NULL column.  ``keep`` columns pass through.
    """
    keep = [c for c in (keep or []) if c in df.columns]
    x = with_molecular_inline(df) if df.isStreaming and monomers is None else _with_dimension(df, monomers)
    x = with_operating(x, medians)
    x = x.withColumns(synthesis_columns())
    feats: dict[str, Column] = {}
    if not recipe_only:
        for src, dst in CHAR_RENAME.items():
            feats[dst] = F.col(src).cast("double")
        feats.update(physics_columns())
        feats.update(structure_columns(_slots_of(x, monomers)))
    for c in SYNTH_COLS + OP_FEATURES + MOL_COLS:
        feats[c] = F.col(c)
    feats.update(onehot_columns(categories))
    order = names or (recipe_feature_names(categories) if recipe_only else feature_names(categories))
    cols = [(feats[n] if n in feats else F.lit(None).cast("double")).cast("double").alias(n)
            for n in order]
    keep_cols = [F.col(c).alias(f"_keep_{c}") if c in order else F.col(c) for c in keep]
    out = x.select(*keep_cols, *cols)
    return out.withColumnsRenamed({f"_keep_{c}": f"src_{c}" for c in keep if c in order})


# ---- fixed values: name prefixes of the physics ablation ----
PHYSICS_PREFIXES = ("WCA", "Zeta", "Ra", "Rq", "Average", "MWCO", "Thickness", "Modification",
                    "zeta_", "steric_", "donnan", "pore_", "mwco_", "pressure", "feed", "p_",
                    "log_feed")


def physics_subset(names: list[str]) -> list[str]:
    """The compact physics columns of an ablation, by name prefix."""
    return [c for c in names if c.startswith(PHYSICS_PREFIXES)]


def with_features(df: DataFrame, categories: list[str], names: list[str] | None = None,
                  recipe_only: bool = False, medians: DataFrame | dict | None = None,
                  monomers: DataFrame | None = None) -> DataFrame:
    """Append the model matrix to ``df`` keeping every input column.

    ``pressure``/``feed`` come back median-filled (they are features too);
    every other input column is unchanged.  Used on scoring batches, where
    predictions must stay on the input rows without any join.
    """
    x = with_molecular_inline(df) if df.isStreaming and monomers is None else _with_dimension(df, monomers)
    x = with_operating(x, medians)
    x = x.withColumns(synthesis_columns())
    feats: dict[str, Column] = {}
    if not recipe_only:
        for src, dst in CHAR_RENAME.items():
            feats[dst] = F.col(src).cast("double")
        feats.update(physics_columns())
        feats.update(structure_columns(_slots_of(x, monomers)))
    for c in SYNTH_COLS + OP_FEATURES + MOL_COLS:
        feats[c] = F.col(c)
    feats.update(onehot_columns(categories))
    order = names or (recipe_feature_names(categories) if recipe_only else feature_names(categories))
    extra = [(feats[n] if n in feats else F.lit(None).cast("double")).cast("double").alias(n)
             for n in order if n not in df.columns]
    return x.select(*[F.col(c) for c in df.columns], *extra)
