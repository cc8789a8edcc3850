"""Registered queries: one per operator of SURVEY section 2.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
derived recipe table (or data Spark derives from it).  Output doubles are
rounded to 6 places and every computed column is named, so the DuckDB oracle
in ``oracles.py`` can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clip, to_number
from ..functions.score import composite_score
from ..operators import clean as C
from ..plans import flagship as FL
from ..session import materialize
from ..sources import fixture as FX

ROW_ID = ["batch", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def raw(spark, sf_dir) -> DataFrame:
    return FX.recipes(spark, sf_dir)


def clean(spark, sf_dir) -> DataFrame:
    return C.clean_recipes(FX.recipes(spark, sf_dir, spread=True))


def cleaned(spark, sf_dir) -> DataFrame:
    """The cleaned table, written once for a query that reads it more than once: the
    deduplication sorts and shuffles whole rows, and without this each pass over them would."""
    return materialize(clean(spark, sf_dir), "clean")


# ------------------------------------------------------------------ flagship
@query("flagship_best_pairs")
def q_flagship(spark, sf_dir):
    return FL.best_measured_pairs(raw(spark, sf_dir), n=15)


# ------------------------------------------------------- ingest and cleaning
@query("p1_coerce_numeric")
def q_p1(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select(*ROW_ID, F.col("density_part1").alias("density_part1_raw"),
                    to_number("density_part1").alias("density_part1"))


@query("p2_synth_key")
def q_p2(spark, sf_dir):
    return C.with_synth_key(raw(spark, sf_dir)).select(*ROW_ID, "synth_key")


@query("p3_dedup_first")
def q_p3(spark, sf_dir):
    d = C.dedup_first(C.with_synth_key(raw(spark, sf_dir)))
    return d.select(*ROW_ID, "synth_key")


@query("p4_membrane_unk")
def q_p4(spark, sf_dir):
    d = C.fill_membrane(clean(spark, sf_dir))
    return d.groupBy("membrane").agg(F.count(F.lit(1)).alias("n_rows"))


@query("p6_domain_filter_log")
def q_p6(spark, sf_dir):
    return C.domain_filter_log(clean(spark, sf_dir))


@query("a10_ingest_counts")
def q_a10(spark, sf_dir):
    r = C.with_synth_key(raw(spark, sf_dir))
    return C.ingest_counts(r)


# ------------------------------------------------------------------ chemistry
from ..functions import chem as CH  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import monomers as MO  # noqa: E402
from ..sources.library import monomer_library  # noqa: E402


def _r6(df: DataFrame, skip: tuple = ()) -> DataFrame:
    """Round every double column to 6 places (cross-engine stable output)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if f.dataType.typeName() == "double" and f.name not in skip
                       else F.col(f.name) for f in df.schema.fields])


def distinct_monomers(spark, sf_dir) -> DataFrame:
    return FE.monomer_dim(clean(spark, sf_dir)).select("smiles")


@query("p7_parse_monomer")
def q_p7(spark, sf_dir):
    m = distinct_monomers(spark, sf_dir)
    base, tag = CH.parse_monomer("smiles")
    return m.select("smiles", base.alias("base"), tag.alias("tag"))


@query("p8_valid_monomer")
def q_p8(spark, sf_dir):
    lib = monomer_library(spark)
    m = distinct_monomers(spark, sf_dir).unionByName(lib.select("smiles")).distinct()
    return m.select("smiles", CH.is_valid_smiles("smiles").alias("is_valid"))


@query("p9_route_monomer")
def q_p9(spark, sf_dir):
    lib = monomer_library(spark)
    m = distinct_monomers(spark, sf_dir).unionByName(lib.select("smiles")).distinct()
    return m.select("smiles", CH.is_acyl("smiles").alias("is_acyl"),
                    CH.is_amine("smiles").alias("is_amine"))


@query("p10_candidates")
def q_p10(spark, sf_dir):
    return MO.candidates(clean(spark, sf_dir))


@query("j3_monomer_names")
def q_j3(spark, sf_dir):
    return MO.candidates(clean(spark, sf_dir)).select("smiles", "display_name")


@query("j4_in_dataset")
def q_j4(spark, sf_dir):
    return MO.candidates(clean(spark, sf_dir)).select("smiles", "role", "in_dataset")


@query("u2_monomer_union")
def q_u2(spark, sf_dir):
    return MO.monomer_union(clean(spark, sf_dir))


@query("s3_options")
def q_s3(spark, sf_dir):
    return MO.options(clean(spark, sf_dir))


@query("p11_descriptors")
def q_p11(spark, sf_dir):
    lib = monomer_library(spark)
    m = distinct_monomers(spark, sf_dir).unionByName(lib.select("smiles")).distinct()
    return _r6(m.select("smiles", *[v.alias(k) for k, v in CH.descriptors("smiles").items()]))


def features(spark, sf_dir, recipe_only=False, keep=None) -> DataFrame:
    c = cleaned(spark, sf_dir)
    cats = FE.membrane_categories(c)
    return FE.build_features(c, cats, keep=keep or ROW_ID, recipe_only=recipe_only)


@query("p12_molecular")
def q_p12(spark, sf_dir):
    return _r6(features(spark, sf_dir).select(*ROW_ID, *FE.MOL_COLS))


@query("p13_synthesis")
def q_p13(spark, sf_dir):
    return _r6(features(spark, sf_dir).select(*ROW_ID, *FE.SYNTH_COLS))


@query("p14_structure")
def q_p14(spark, sf_dir):
    return _r6(features(spark, sf_dir).select(*ROW_ID, *FE.STRUCTURE_COLS))


@query("p15_operating")
def q_p15(spark, sf_dir):
    return _r6(features(spark, sf_dir).select(*ROW_ID, *FE.OP_FEATURES))


@query("p16_char_rename")
def q_p16(spark, sf_dir):
    return _r6(features(spark, sf_dir).select(*ROW_ID, *FE.CHAR_FEATURES))


@query("p17_physics")
def q_p17(spark, sf_dir):
    return _r6(features(spark, sf_dir).select(*ROW_ID, *FE.PHYSICS_COLS))


@query("p18_membrane_onehot")
def q_p18(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(*ROW_ID, *[c for c in f.columns if c.startswith("base_")])


@query("p19_feature_matrix")
def q_p19(spark, sf_dir):
    return _r6(features(spark, sf_dir))


@query("p20_recipe_features")
def q_p20(spark, sf_dir):
    return _r6(features(spark, sf_dir, recipe_only=True))


@query("p33_physics_subset")
def q_p33(spark, sf_dir):
    f = features(spark, sf_dir)
    return _r6(f.select(*ROW_ID, *FE.physics_subset(f.columns)))


# ------------------------------------------------------- transforms, scores
from ..functions import transforms as TR  # noqa: E402
from ..functions.score import clip_rejection, composite_score, mg_retention_logscore  # noqa: E402
from ..operators import blend as BL  # noqa: E402
from ..operators import grid as GR  # noqa: E402
from ..operators import impute as IM  # noqa: E402
from ..operators import metrics as ME  # noqa: E402
from ..operators import rank as RK  # noqa: E402
from ..operators import select as SE  # noqa: E402
from ..operators import splits as SP  # noqa: E402
from ..sources import library as LB  # noqa: E402
from ..sources import standins as ST  # noqa: E402

REJ = list(TR.REJECTIONS)


def _by_target(fn_rej, fn_other, y):
    return F.when(F.col("target").isin(REJ), fn_rej(y)).otherwise(fn_other(y))


@query("p21_target_transform")
def q_p21(spark, sf_dir):
    t = ST.target_long(clean(spark, sf_dir))
    z = _by_target(lambda y: TR.fwd_transform("Mg_rej", y), lambda y: TR.fwd_transform("PWP", y), "y")
    t = t.withColumn("z", z)
    back = _by_target(lambda c: TR.inv_transform("Mg_rej", c), lambda c: TR.inv_transform("PWP", c), "z")
    return _r6(t.select(*ROW_ID, "target", "y", "z", back.alias("y_back")))


@query("p22_stage1_transform")
def q_p22(spark, sf_dir):
    c = clean(spark, sf_dir)
    items = [F.struct(F.lit(n).alias("char"), F.col(src).alias("y"))
             for n, src in FE.STAGE1_SOURCE.items()]
    t = c.select(*ROW_ID, F.explode(F.array(*items)).alias("t")).select(*ROW_ID, "t.*") \
        .where(F.col("y").isNotNull())
    is_log = F.col("char") == "MWCO_Da"
    z = F.when(is_log, TR.stage1_fwd("MWCO_Da", "y", "log")).otherwise(F.col("y"))
    t = t.withColumn("z", z)
    back = F.when(is_log, TR.stage1_inv("MWCO_Da", "z", "log")).otherwise(F.col("z"))
    return _r6(t.select(*ROW_ID, "char", "y", "z", back.alias("y_back")))


@query("p23_logit_transform")
def q_p23(spark, sf_dir):
    c = clean(spark, sf_dir).where(F.col("mg_rej").isNotNull())
    z = TR.logit_fwd("mg_rej")
    return _r6(c.select(*ROW_ID, F.col("mg_rej").alias("y"), z.alias("z"),
                        TR.logit_inv(z).alias("y_back"),
                        TR.fwd_transform("Mg_rej", "mg_rej").alias("z_complement_log")))


@query("p24_clip_round")
def q_p24(spark, sf_dir):
    s = ST.standin_predictions(clean(spark, sf_dir))
    lo, hi = F.least("pred_a", "pred_b"), F.greatest("pred_a", "pred_b")
    is_rej = F.col("target").isin(REJ)

    def fix(c):
        return F.round(F.when(is_rej, clip_rejection(c)).otherwise(c), 2)
    return s.select(*ROW_ID, "target", fix(F.col("pred_a")).alias("value"),
                    fix(lo).alias("lo"), fix(hi).alias("hi"))


@query("p25_mg_logscore")
def q_p25(spark, sf_dir):
    c = clean(spark, sf_dir).where(F.col("mg_rej").isNotNull())
    return _r6(c.select(*ROW_ID, "mg_rej", mg_retention_logscore("mg_rej").alias("mg_logscore")))


@query("p26_composite_score")
def q_p26(spark, sf_dir):
    parts = composite_score("mg_rej", "li_rej", "flux_mg", "pwp")
    return _r6(clean(spark, sf_dir).select(*ROW_ID, *[v.alias(k) for k, v in parts.items()]))


STANDIN_CHAR = {"wca": "pred_wca", "zeta": "pred_zeta", "pore": "pred_pore",
                "mwco": "pred_mwco", "thickness": "pred_thickness"}


def standin_char_predictions(df: DataFrame) -> DataFrame:
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    return df.withColumns({
        "pred_wca": 40.0 + (pk % 13).cast("double"),
        "pred_zeta": (pk % 21 - 10).cast("double"),
        "pred_pore": 0.3 + 0.01 * (sk % 20).cast("double"),
        "pred_mwco": 200.0 + (pk % 300).cast("double"),
        "pred_thickness": 50.0 + (sk % 50).cast("double")})


@query("p27_fill_characterisation")
def q_p27(spark, sf_dir):
    c = standin_char_predictions(clean(spark, sf_dir))
    f = GR.fill_characterisation(c, STANDIN_CHAR)
    return _r6(f.select(*ROW_ID, *STANDIN_CHAR, *[f"filled_{k}" for k in STANDIN_CHAR],
                        "char_source"))


@query("p29_impute_medians")
def q_p29(spark, sf_dir):
    f = features(spark, sf_dir)
    names = [c for c in f.columns if c not in ROW_ID]
    return _r6(IM.medians_table(f, names))


@query("p30_standardise")
def q_p30(spark, sf_dir):
    f = features(spark, sf_dir)
    names = [c for c in f.columns if c not in ROW_ID]
    return _r6(IM.scaler_table(f, names))


@query("p32_mutual_info_topk")
def q_p32(spark, sf_dir):
    f = features(spark, sf_dir, keep=ROW_ID + ["mg_rej"]).where(F.col("mg_rej").isNotNull())
    names = [c for c in f.columns if c not in ROW_ID + ["mg_rej"]]
    # medians, ranges and bin counts each scan the input: write it once
    f = materialize(f.withColumn("z", TR.fwd_transform("Mg_rej", "mg_rej")), "p32-input")
    return _r6(SE.mutual_info_topk(f, names, "z", k=20, bins=10))


# ------------------------------------------------------------------ splits
@query("v1_row_folds")
def q_v1(spark, sf_dir):
    c = clean(spark, sf_dir)
    return SP.with_fold(c, 5, SP.row_key(), seed=42).select(*ROW_ID, "fold")


@query("v2_group_folds")
def q_v2(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    f = SP.with_fold(c, SP.group_k(c), F.col("synth_key"), seed=42)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.count_distinct("synth_key").alias("n_groups"))


@query("v1_even_row_folds")
def q_v1e(spark, sf_dir):
    # the duplicates are found by all columns, but only the row's own are carried along
    c = C.clean_recipes(FX.recipes(spark, sf_dir, spread=True), keep=[]).select(*SP.ROW_KEY_COLS)
    return SP.with_even_fold(c, 5, SP.row_key(), seed=42).select(*ROW_ID, "fold")


@query("v2_balanced_group_folds")
def q_v2b(spark, sf_dir):
    return SP.balanced_group_folds(clean(spark, sf_dir), 5)


@query("v3_group_shuffle_split")
def q_v3(spark, sf_dir):
    c = clean(spark, sf_dir).where(F.col("mg_rej").isNotNull())
    s = SP.seeds_frame(c.select("synth_key"), list(range(20)))
    s = SP.with_holdout(s, F.col("synth_key"), F.col("seed"), 0.2)
    return s.groupBy("seed").agg(F.count_if("is_test").alias("n_test_rows"),
                                 F.count_if(~F.col("is_test")).alias("n_train_rows"),
                                 F.count_distinct(F.when(F.col("is_test"), F.col("synth_key")))
                                 .alias("n_test_groups"))


@query("v4_random_holdouts")
def q_v4(spark, sf_dir):
    c = clean(spark, sf_dir).where(F.col("mg_rej").isNotNull())
    s = SP.seeds_frame(c.select(*SP.ROW_KEY_COLS), list(range(5)))
    s = SP.with_holdout(s, SP.row_key(), F.col("seed"), 0.2)
    return s.groupBy("seed").agg(F.count_if("is_test").alias("n_test"),
                                 F.count_if(~F.col("is_test")).alias("n_train"))


# ------------------------------------------------------------------ metrics
def standin_metrics(spark, sf_dir) -> DataFrame:
    return ME.regression_metrics(ST.standin_long(clean(spark, sf_dir)), ["target", "candidate"])


@query("a4_regression_metrics")
def q_a4(spark, sf_dir):
    return _r6(standin_metrics(spark, sf_dir))


@query("a5_holdout_mean_sd")
def q_a5(spark, sf_dir):
    # A row's splits depend on its key alone: found once a row, before its targets and
    # seeds make rows of their own.
    c = clean(spark, sf_dir).withColumn("seeds", SP.holdout_seeds(SP.row_key(), list(range(5)), 0.2))
    s = ST.standin_predictions(c, extra=["seeds"])
    s = s.select("target", "y", F.col("pred_a").alias("y_pred"), F.explode("seeds").alias("seed"))
    m = ME.regression_metrics(s, ["target", "seed"])
    return _r6(ME.mean_sd(m, ["target"], ["r2", "rmse"]))


@query("a7_auc_average_precision")
def q_a7(spark, sf_dir):
    return _r6(ME.auc_ap(ST.risk_scores(clean(spark, sf_dir))))


@query("a8_alert_metrics")
def q_a8(spark, sf_dir):
    return _r6(ME.alert_metrics(ST.risk_scores(clean(spark, sf_dir)), alert_at=0.2))


@query("a9_target_summary")
def q_a9(spark, sf_dir):
    return _r6(ME.target_summary(ST.target_long(clean(spark, sf_dir)), "y", ["target"]))


def standin_phi(spark, sf_dir) -> DataFrame:
    f = features(spark, sf_dir, keep=ROW_ID + ["mg_rej"]).where(F.col("mg_rej").isNotNull())
    names = FE.PHYSICS_COLS + FE.OP_FEATURES
    items = [F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names]
    u = f.select("l_orderkey", F.explode(F.array(*items)).alias("u")).select("l_orderkey", "u.*")
    phi = 0.01 * (F.col("l_orderkey") % 7 - 3).cast("double") * F.coalesce("x", F.lit(0.0))
    return u.withColumn("phi", phi)


@query("a11_shap_summary")
def q_a11(spark, sf_dir):
    return _r6(ME.shap_summary(standin_phi(spark, sf_dir), top_k=10))


@query("a12_histogram")
def q_a12(spark, sf_dir):
    return _r6(ME.histogram(ST.target_long(clean(spark, sf_dir)), "y", 30, ["target"]))


@query("a13_fold_failures")
def q_a13(spark, sf_dir):
    c = clean(spark, sf_dir).where(F.col("mg_rej").isNotNull())
    c = SP.with_fold(c, 5, F.col("synth_key"), seed=42)
    return ME.fold_failure_counts(c, "mg_rej")


@query("o2_rank_methods")
def q_o2(spark, sf_dir):
    return _r6(ME.rank_methods(standin_metrics(spark, sf_dir), ["target"]))


@query("o3_top_features")
def q_o3(spark, sf_dir):
    f = features(spark, sf_dir, keep=FX.TARGET_COLS)
    names = [c for c in f.columns if c not in FX.TARGET_COLS]
    labels = {t: F.when(TRN.target_rows(t), F.col(c)) for t, c in FX.TARGETS.items()}
    imp = SE.correlation_importance(f, names, labels, "target")
    return _r6(RK.top_n_per_group(imp, ["target"], 15,
                                  [F.desc(F.round("importance", 9)), F.asc("feature")]))


@query("m4_residual_interval")
def q_m4(spark, sf_dir):
    s = ST.standin_predictions(cleaned(spark, sf_dir))
    z = _by_target(lambda y: TR.fwd_transform("Mg_rej", y), lambda y: TR.fwd_transform("PWP", y), "y")
    zp = _by_target(lambda y: TR.fwd_transform("Mg_rej", y), lambda y: TR.fwd_transform("PWP", y),
                    "pred_a")
    s = s.withColumns({"z": z, "zp": zp})
    q = BL.residual_quantiles(s, ["target"], "z", "zp")
    j = s.join(F.broadcast(q), "target")
    rej = BL.interval("Mg_rej", F.col("zp"), F.col("q_lo"), F.col("q_hi"))
    oth = BL.interval("PWP", F.col("zp"), F.col("q_lo"), F.col("q_hi"))
    is_rej = F.col("target").isin(REJ)
    lo = F.when(is_rej, rej["lo"]).otherwise(oth["lo"])
    hi = F.when(is_rej, rej["hi"]).otherwise(oth["hi"])
    j = j.withColumns({"lo": lo, "hi": hi})
    return _r6(j.groupBy("target").agg(
        F.first("q_lo").alias("q_lo"), F.first("q_hi").alias("q_hi"),
        F.avg(((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))
         .alias("coverage"),
        F.avg(F.col("hi") - F.col("lo")).alias("mean_width")))


@query("m5_blend_weight")
def q_m5(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    s = ST.standin_predictions(c)
    metrics = materialize(ME.regression_metrics(ST.standin_long(c), ["target", "candidate"]), "m5-metrics")
    top = materialize(BL.choose_top2(metrics, ["target"]), "m5-top")  # a row per target
    j = s.join(F.broadcast(top), "target")
    p1 = F.when(F.col("top1") == "A", F.col("pred_a")).otherwise(F.col("pred_b"))
    p2 = F.when(F.col("top2") == "A", F.col("pred_a")).otherwise(F.col("pred_b"))
    j = j.withColumns({"p1": p1, "p2": p2})
    grid = BL.weight_grid(j, ["target"], "y", "p1", "p2", BL.WEIGHTS_050_100)
    best = BL.best_weight(grid, ["target"], top.select("target", "top1_r2"))
    out = best.join(top, "target").select(
        "target", "top1", "top2", "weight", "r2",
        F.when(F.col("weight") >= 0.999, F.col("top1"))
         .otherwise(F.concat_ws("+", "top1", "top2")).alias("model"))
    return _r6(out)


@query("m7_blend_grid")
def q_m7(spark, sf_dir):
    s = ST.standin_predictions(clean(spark, sf_dir))
    return _r6(BL.weight_grid(s, ["target"], "y", "pred_a", "pred_b", BL.WEIGHTS_000_100)
               .withColumn("w", F.round("w", 1)))


# ------------------------------------------------------ grids and rankings
@query("a1_best_condition")
def q_a1(spark, sf_dir):
    scored = FL.measured_scores(raw(spark, sf_dir))
    best = RK.best_per_group(scored, FL.PAIR, "score", FX.ORDER_COLS,
                             payload=["l_orderkey", "l_linenumber", "membrane", "score"],
                             count_name="n_measured")
    return _r6(best.withColumnsRenamed({"smiles_part1": "aq", "smiles_part2": "org"}))


@query("a2_best_per_amine")
def q_a2(spark, sf_dir):
    pairs = q_a1(spark, sf_dir)
    best = RK.best_per_group(pairs.withColumn("score4", F.round("score", 4)), ["aq"], "score4",
                             ["org"], payload=["org", "score4", "l_orderkey"])
    return RK.top_n(best.withColumnRenamed("score4", "best_score"), 15,
                    [F.desc("best_score"), F.asc("aq")])


@query("o1_top_n_recipes")
def q_o1(spark, sf_dir):
    scored = FL.measured_scores(raw(spark, sf_dir))
    out = scored.select(*ROW_ID, "smiles_part1", "smiles_part2",
                        F.round("score", 4).alias("score"), "l_extendedprice", "l_shipdate")
    return RK.top_n(out, 15, [F.desc("score")] + [F.asc(c) for c in FX.ORDER_COLS]) \
        .drop("l_extendedprice", "l_shipdate")


@query("j1_recipe_grid")
def q_j1(spark, sf_dir):
    # all measured base recipes; descriptors once per base, before the grid
    c = clean(spark, sf_dir)
    base = c.where("smiles_part1 is not null and smiles_part2 is not null") \
        .select(F.col("smiles_part1").alias("aq"), F.col("smiles_part2").alias("org"), "membrane").distinct()
    aq, org = CH.descriptors("aq"), CH.descriptors("org")
    base = base.withColumns({f"agg_{k}": aq[k] + org[k] for k in ["n_amine", "nCl"]})
    g = GR.explode_grid(base, LB.RECIPE_GRID, limit=LB.RECIPE_GRID_LIMIT)
    syn = FE.synthesis_columns()
    g = g.withColumns({"density_part1": F.col("D1"), "density_part2": F.col("D2"),
                       "time_1": F.col("T1"), "time_2": F.col("T2")})
    return _r6(g.select("aq", "org", "membrane", "D1", "D2", "T1", "T2", "agg_n_amine", "agg_nCl",
                        *[syn[c].alias(c) for c in ["conc_x_time", "sqrt_t1", "sqrt_t2",
                                                    "d_ratio", "d1_sq", "d1_x_d2", "ip_balance"]]))


def monomer_grid(spark, sf_dir) -> DataFrame:
    cands = MO.candidates(clean(spark, sf_dir))
    desc = CH.descriptors("smiles")
    dimmed = cands.select("smiles", "role", "in_dataset", *[v.alias(k) for k, v in desc.items()])
    pairs = GR.monomer_pairs(dimmed)
    g = GR.explode_grid(pairs, LB.MONOMER_GRID)
    cols = {}
    for k in CH.DESC_KEYS:
        cols[f"agg_{k}"] = F.col(f"aq_{k}") + F.col(f"org_{k}")
        cols[f"wtd_{k}"] = F.col(f"aq_{k}") * F.col("D1") + F.col(f"org_{k}") * F.col("D2")
    return g.withColumns(cols)


@query("j2_monomer_grid")
def q_j2(spark, sf_dir):
    g = monomer_grid(spark, sf_dir)
    ip = (F.col("D1") * F.greatest(F.col("agg_n_amine"), F.lit(0.0))) / \
         (F.col("D2") * F.greatest(F.col("agg_nCl"), F.lit(0.0)) + 1e-6)
    return _r6(g.select("aq", "org", "D1", "D2", "T1", "T2", *FE.MOL_COLS,
                        clip(ip, 0.0, 50.0).alias("ip_balance")))


@query("a3_screen_counts")
def q_a3(spark, sf_dir):
    return SC.screen_counts(MO.candidates(clean(spark, sf_dir)), LB.MONOMER_GRID)


@query("u1_union_by_name")
def q_u1(spark, sf_dir):
    b1, b2 = FX.recipe_batches(spark, sf_dir)
    # the second sheet lacks two columns: unionByName fills them with NULL
    u = b1.unionByName(b2.drop("ra", "rq"), allowMissingColumns=True)
    return u.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.count("membrane").alias("n_membrane"),
                                  F.count("ra").alias("n_ra"))


# ---------------------------------------------- models (rows-only checks)
# Model-dependent results have no SQL oracle; each query still trains on the
# whole derived table.  The comparisons of candidates (M1, M2, M6, M12, M13, E4) have the
# reference's sizes (``MD.FULL``), the others those of ``MD.FAST`` (12 trees, depth 8).
from ..operators import models as MD  # noqa: E402
from ..sources import files as FI  # noqa: E402
from . import audit as AU  # noqa: E402
from . import explain as XP  # noqa: E402
from . import scoring as SC  # noqa: E402
from . import sinks as SK  # noqa: E402
from . import training as TRN  # noqa: E402

PROFILE = MD.FAST


def _target_data(spark, sf_dir, target="Mg_rej"):
    c = cleaned(spark, sf_dir)
    feats, cats, names = TRN.feature_table(c)
    return c, TRN.target_frame(feats, target), names


def _metric_rows(o: DataFrame, cols: dict[str, str], y: str = "z") -> DataFrame:
    items = [F.struct(F.lit(k).alias("model"), F.col(v).alias("p")) for k, v in cols.items()]
    long = o.select(y, F.explode(F.array(*items)).alias("m")).select(y, "m.model", "m.p")
    return ME.regression_metrics(long, ["model"], y, "p")


@query("v5_oof_predictions")
def q_v5(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    o = MD.oof(d, "fold", 5, names, "z", {"ET.5": MD.CANDIDATES["ET.5"]}, PROFILE)
    return _r6(o.select(*ROW_ID, "fold", "y", "z", F.col("oof_ET_5").isNotNull().alias("predicted")))


@query("m1_forest_oof")
def q_m1(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    specs = {k: MD.CANDIDATES[k] for k in ["ET.5", "ET.7", "ET1", "RF"]}
    o = MD.oof(d, "fold", 5, names, "z", specs, MD.FULL, keep=["z"])
    return _metric_rows(o, {k: "oof_" + MD.colname(k) for k in specs})


@query("m2_boosted_oof")
def q_m2(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    specs = {"HGB": MD.CANDIDATES["HGB"], "GBR_abs": MD.Spec("gbt", loss="absolute"),
             "GBR_huber": AU.AUDIT_EXPERIMENTS["GBR depth=3"]}
    o = MD.oof(d, "fold", 5, names, "z", specs, MD.FULL, keep=["z"])
    return _metric_rows(o, {k: "oof_" + MD.colname(k) for k in specs})


@query("m3_ridge_oof")
def q_m3(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    o = MD.oof(d, "fold", 5, names, "z", {"Ridge": MD.Spec("ridge", reg=20.0)}, PROFILE, keep=["z"])
    return _metric_rows(o, {"Ridge": "oof_Ridge"})


@query("m6_ensemble_blend")
def q_m6(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    feats, cats, names = TRN.feature_table(c)
    res = TRN.TrainResult(cats, names)
    TRN.train_target(feats, "Mg_rej", names, MD.FULL, grouped=True, holdouts=0, intervals=True,
                     result=res)
    tm = res.models["Mg_rej"]
    r = res.report[0]
    return spark.createDataFrame(
        [(r["target"], r["model"], ",".join(tm.names), [float(w) for w in tm.weights],
          r["CV_R2"], r.get("GroupKFold_R2"), tm.q_lo, tm.q_hi)],
        "target string, model string, members string, weights array<double>, CV_R2 double, "
        "GroupKFold_R2 double, q_lo double, q_hi double")


@query("v4_holdout_predictions")
def q_v4m(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    feats, cats, names = TRN.feature_table(c)
    res = TRN.TrainResult(cats, names)
    TRN.train_target(feats, "Mg_rej", names, PROFILE, {"ET.5": MD.CANDIDATES["ET.5"]},
                     grouped=False, holdouts=5, intervals=False, result=res)
    # Predictions back on their source rows (ids, membrane)
    h = SK.holdout_table(res.holdout_predictions["Mg_rej"], "Mg_rej")
    return _r6(h.select(*ROW_ID, "split_seed", "membrane", "y_true", F.col("y_pred").isNotNull().alias("predicted")))


def _quick(spark, sf_dir, stage1=False, intervals=False, targets=None):
    c = cleaned(spark, sf_dir)
    return c, TRN.quick_models(c, PROFILE, stage1=stage1, intervals=intervals, targets=targets)


@query("m4_prediction_interval")
def q_m4m(spark, sf_dir):
    c, res = _quick(spark, sf_dir, intervals=True, targets=["Mg_rej", "Flux_Mg"])
    s = SC.score_batch(c.where(F.col("mg_rej").isNotNull() & F.col("flux_mg").isNotNull()), res)
    # what SQL can check of every row: the measured values stay, the interval is
    # ordered and inside the physical range
    ordered = F.lit(True)
    for t in ["Mg_rej", "Flux_Mg"]:
        p = SC.prediction_name(t)
        ordered = ordered & (F.col(f"{p}_lo") <= F.col(f"{p}_hi"))
    ranged = F.col("pred_Mg_rej").between(0, 100) & F.col("pred_Mg_rej_lo").between(0, 100) \
        & F.col("pred_Mg_rej_hi").between(0, 100)
    return _r6(s.select(*ROW_ID, "mg_rej", "flux_mg", ordered.alias("interval_ordered"),
                        ranged.alias("rejection_in_range")))


@query("m8_stage1_models")
def q_m8(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    cats = FE.membrane_categories(c)
    res = TRN.TrainResult(cats, FE.feature_names(cats))
    TRN.train_stage1(c, cats, PROFILE, res, evaluate=True)
    return spark.createDataFrame([(r["char"], r["n"], r["transform"], r["R2"] is not None)
                                  for r in res.stage1_report],
                                 "char string, n long, transform string, evaluated boolean")


@query("m9_fill_characterisation")
def q_m9(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    cats = FE.membrane_categories(c)
    res = TRN.TrainResult(cats, FE.feature_names(cats))
    TRN.train_stage1(c, cats, PROFILE, res, evaluate=False)
    f = SC.fill_predicted_char(c, res)
    chars = ["zeta", "pore", "mwco", "wca", "thickness"]
    complete = F.lit(True)
    for k in chars:
        complete = complete & F.col(k).isNotNull()
    return _r6(f.select(*ROW_ID, *[F.when(~F.col(f"filled_{k}"), F.col(k)).alias(f"measured_{k}") for k in chars],
                        *[f"filled_{k}" for k in chars], "char_source", complete.alias("complete")))


@query("m10_batch_score")
def q_m10(spark, sf_dir):
    c, res = _quick(spark, sf_dir)
    s = SC.score_batch(c, res)
    # what SQL can check of every row: all measured targets stay as they were, the
    # score follows from the emitted predictions and lies in 0..1
    again = composite_score(*[SC.prediction_name(t) for t in ["Mg_rej", "Li_rej", "Flux_Mg", "PWP"]])
    same = F.abs(again["score"] - F.col("score")) < 1e-12
    return _r6(s.select(*ROW_ID, *FX.TARGETS.values(), same.alias("score_follows"),
                        F.col("score").between(0, 1).alias("score_in_range")))


@query("m10_predicted_values")
def q_m10v(spark, sf_dir):
    """The model's values themselves (rows only: no SQL for a forest)."""
    c, res = _quick(spark, sf_dir)
    s = SC.round_predictions(SC.score_batch(c, res))
    return s.select(*ROW_ID, *[SC.prediction_name(t) for t in FX.TARGETS], "score", "separation",
                    "mg_quality", "li_quality", "flux_norm", "pwp_norm")


@query("e2_screen_recipes")
def q_e2(spark, sf_dir):
    c, res = _quick(spark, sf_dir)
    # every measured base recipe; the condition grid's size is guarded per base
    bases = c.groupBy("smiles_part1", "smiles_part2", "membrane").agg(
        F.max("pressure").alias("pressure"), F.max("feed").alias("feed"))
    return SC.screen_recipes(bases, res, top_n=15,
                             group=["smiles_part1", "smiles_part2", "membrane"])


@query("e3_screen_monomers")
def q_e3(spark, sf_dir):
    c, res = _quick(spark, sf_dir, stage1=True)
    return SC.screen_monomers(c, res)["results"]


@query("e3_amine_ranking")
def q_e3b(spark, sf_dir):
    c, res = _quick(spark, sf_dir, stage1=True)
    return SC.screen_monomers(c, res)["aq_ranking"]


@query("m11_risk_classifier")
def q_m11(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    return AU.risk_report(AU.risk_oof(d, names, PROFILE))


@query("m11_risk_classifier_rows")
def q_m11r(spark, sf_dir):
    """Per fold: rows, failures, and whether every row has a probability."""
    _, d, names = _target_data(spark, sf_dir)
    p = AU.risk_oof(d, names, PROFILE)
    return p.groupBy("gfold").agg(F.count_if(F.col("fail") == 1).alias("n_fail"), F.count(F.lit(1)).alias("n"),
                                  F.min(F.col("p_RISK").between(0, 1)).alias("probabilities"))


@query("m12_leaderboard")
def q_m12(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    feats, cats, names = TRN.feature_table(c)
    by_t = {t: TRN.target_frame(feats, t) for t in FX.TARGETS}
    return AU.leaderboard(by_t, names, MD.FULL)


@query("m13_cascade")
def q_m13(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    return AU.cascade(d, names, MD.FULL, audit=_audit(spark, sf_dir))


@query("m14_seed_stability")
def q_m14(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    return AU.seed_stability(d, names, PROFILE)


@query("a6_split_gap")
def q_a6(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    return AU.split_gap(d, names, PROFILE)


def _mg_model(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    return d, MD.fit(d, names, "z", MD.CANDIDATES["ET.5"], PROFILE)


@query("m15_permutation_importance")
def q_m15(spark, sf_dir):
    d, m = _mg_model(spark, sf_dir)
    imp = XP.permutation_importance(d, m, "z", SP.ROW_KEY_COLS, n_repeats=4)
    return RK.top_n(imp, 15, [F.desc("importance"), F.asc("feature")])


@query("m16_path_shap_summary")
def q_m16(spark, sf_dir):
    d, m = _mg_model(spark, sf_dir)
    long, _, _ = XP.path_shap(d, m, SP.ROW_KEY_COLS)
    return ME.shap_summary(long, top_k=20)


@query("m16_shap_additivity")
def q_m16b(spark, sf_dir):
    d, m = _mg_model(spark, sf_dir)
    _, check, b = XP.path_shap(d, m, SP.ROW_KEY_COLS)
    near = F.abs(F.col("prediction") - F.col("base_plus_phi")) < 1e-9
    return check.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(near).alias("n_additive"))


@query("s7_shap_values_wide")
def q_s7(spark, sf_dir):
    d, m = _mg_model(spark, sf_dir)
    wide, _ = XP.path_arrays(d, m, SP.ROW_KEY_COLS)
    wide = materialize(wide, "shap-wide")
    mean = wide.select(F.posexplode("phi").alias("j", "phi")).groupBy("j").agg(F.avg(F.abs(F.col("phi"))).alias("m"))
    top = [m.kept[r.j] for r in RK.top_n(mean, 20, [F.desc("m"), F.asc("j")]).collect()]
    return wide.select(*SP.ROW_KEY_COLS, *[F.col("phi")[m.kept.index(f)].alias(f) for f in top])


def _input_paths(sf_dir):
    return [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet"]


@query("s2_fingerprint")
def q_s2(spark, sf_dir):
    return FI.fingerprint(spark, _input_paths(sf_dir))


@query("m17_retrain_decision")
def q_m17(spark, sf_dir):
    """All three answers, against a run and a bundle stored from this input: before
    the bundle exists, for another input, and for the same input."""
    import uuid

    from ..session import checkpoint_path
    fp = FI.fingerprint(spark, _input_paths(sf_dir)).first().fingerprint
    base = checkpoint_path(spark, f"runs-{uuid.uuid4().hex[:8]}")
    d, m = _mg_model(spark, sf_dir)
    res = TRN.TrainResult([], m.features)
    res.models["Mg_rej"] = TRN.TargetModel("Mg_rej", ["ET.5"], [1.0], [m])
    res.report.append({"target": "Mg_rej", "n": d.count(), "model": "ET.5"})
    SK.write_run(res, base, fp)
    answers = [("no bundle", SK.retrain_needed(f"{base}/metrics", f"{base}/bundle", fp))]
    SK.save_bundle(res, f"{base}/bundle")
    answers.append(("other input", SK.retrain_needed(f"{base}/metrics", f"{base}/bundle", fp[::-1] + "x")))
    answers.append(("same input", SK.retrain_needed(f"{base}/metrics", f"{base}/bundle", fp)))
    out = None
    for name, a in answers:
        a = a.select(F.lit(name).alias("case_name"), "retrain", "reason")
        out = a if out is None else out.unionByName(a)
    return out


@query("s4_run_record")
def q_s4(spark, sf_dir):
    import uuid
    from ..session import checkpoint_path
    c = cleaned(spark, sf_dir)
    feats, cats, names = TRN.feature_table(c)
    res = TRN.TrainResult(cats, names)
    TRN.train_target(feats, "Mg_rej", names, PROFILE, {"ET.5": MD.CANDIDATES["ET.5"]},
                     grouped=True, holdouts=2, intervals=True, result=res)
    out = checkpoint_path(spark, f"run-{uuid.uuid4().hex[:8]}")
    fp = FI.fingerprint(spark, _input_paths(sf_dir)).first().fingerprint
    rid = SK.write_run(res, out, fp, {"domain_filters": C.domain_filter_log(c)})
    return spark.read.parquet(f"{out}/metrics").where(F.col("run_id") == rid)


@query("s8_bundle_roundtrip")
def q_s8(spark, sf_dir):
    import uuid
    from ..session import checkpoint_path
    c, res = _quick(spark, sf_dir, stage1=True)
    path = checkpoint_path(spark, f"bundle-{uuid.uuid4().hex[:8]}")
    SK.save_bundle(res, path)
    back = SK.load_bundle(path)
    a = SC.score_batch(c, res, intervals=False, components=False).select(*SP.ROW_KEY_COLS, "score")
    b = SC.score_batch(c, back, intervals=False, components=False) \
        .select(*SP.ROW_KEY_COLS, F.col("score").alias("score_reloaded"))
    j = a.join(b, SP.ROW_KEY_COLS)
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("score").eqNullSafe(F.col("score_reloaded"))).alias("n_equal"))


@query("m12_interpolation_benchmark")
def q_m12b(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    return AU.interpolation_benchmark(d, names, MD.FULL)


@query("p31_monomer_onehot_oof")
def q_p31(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    specs = {"ET_onehot": MD.Spec("et", 0.7, onehot=AU.SLOTS), "ET": MD.Spec("et", 0.7)}
    o = MD.oof(d, "gfold", 5, names, "z", specs, PROFILE)
    return _metric_rows(o, {k: "oof_" + k for k in specs})


@query("m7_blend_raw_transformed")
def q_m7m(spark, sf_dir):
    _, d, names = _target_data(spark, sf_dir)
    return AU.blend_raw_transformed(d, names, PROFILE)


@query("s1_load_recipe_files")
def q_s1(spark, sf_dir):
    """S1 on sheets derived from the tables: two sheets (the second lacks two
    columns) plus an editor lock file that must be skipped."""
    import uuid
    from ..session import checkpoint_path
    folder = checkpoint_path(spark, f"sheets-{uuid.uuid4().hex[:8]}")
    b1, b2 = FX.recipe_batches(spark, sf_dir)
    b1.write.parquet(f"{folder}/sheet_1.parquet")
    b2.drop("ra", "rq").write.parquet(f"{folder}/sheet_2.parquet")
    b2.limit(1).write.parquet(f"{folder}/~$sheet_2.parquet")
    df = FI.load_recipe_files(spark, folder, "parquet")
    return df.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count("membrane").alias("n_membrane"),
                                   F.count("ra").alias("n_ra"))


_AUDITS: dict[tuple[str, str], DataFrame] = {}


def _audit(spark, sf_dir) -> DataFrame:
    """E4's result as a written table; a session writes it once for an input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _AUDITS:
        _, d, names = _target_data(spark, sf_dir)
        _AUDITS[key] = materialize(AU.audit_single_stage(d, names, MD.FULL), "audit")
    return _AUDITS[key]


@query("e4_audit_single_stage")
def q_e4(spark, sf_dir):
    return _audit(spark, sf_dir)
