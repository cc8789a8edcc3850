"""Invariants and null/edge cases."""

import pytest
from pyspark.sql import functions as F

from permea.operators import clean as C
from permea.operators import features as FE
from permea.operators import impute as IM
from permea.operators import metrics as ME
from permea.operators import splits as SP
from permea.sources.fixture import recipes


def test_dedup_idempotent_and_counts(spark, sf_dir):
    r = C.with_synth_key(recipes(spark, sf_dir))
    d1 = C.dedup_first(r)
    d2 = C.dedup_first(d1)
    assert d1.count() == d2.count() == 6000        # FIXTURES.md: 6,000 kept at sf0.001
    assert r.count() > d1.count()


def test_dedup_keeps_first_in_source_order(spark):
    from permea.sources.fixture import ORDER_COLS
    rows = [(2, 1, 1, 1, 1, 1.0, "k", 5.0), (1, 9, 1, 1, 1, 1.0, "k", 5.0),
            (1, 3, 1, 1, 1, 1.0, "k", 5.0), (1, 3, 1, 1, 1, 1.0, "j", 5.0)]
    df = spark.createDataFrame(rows, "batch int, l_orderkey long, l_linenumber int, "
                               "l_partkey long, l_suppkey long, l_extendedprice double, "
                               "synth_key string, pressure double") \
        .withColumn("l_shipdate", F.lit(None).cast("timestamp"))
    out = C.dedup_first(df, ["synth_key", "pressure"], ORDER_COLS).orderBy("synth_key").collect()
    assert [(r.synth_key, r.batch, r.l_orderkey) for r in out] == [("j", 1, 3), ("k", 1, 3)]


def test_synth_key_keeps_nulls_apart(spark):
    from permea.operators.clean import KEY_COLS
    schema = ", ".join(f"{c} string" for c in KEY_COLS)
    a = [None] * len(KEY_COLS)
    b = list(a)
    b[0], b[1] = "A", None
    c = list(a)
    c[0], c[1] = None, "A"
    df = spark.createDataFrame([tuple(b), tuple(c)], schema)
    keys = [r.synth_key for r in C.with_synth_key(df).collect()]
    assert keys[0] != keys[1] and keys[0].startswith("A|nan")


def test_no_recipe_in_two_folds(clean):
    f = SP.with_fold(clean, 5, F.col("synth_key"), 42)
    worst = f.groupBy("synth_key").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0]
    assert worst == 1


def test_row_folds_cover_each_row_once(clean):
    f = SP.with_fold(clean, 5, SP.row_key(), 42)
    assert f.where((F.col("fold") < 0) | (F.col("fold") > 4)).count() == 0
    assert f.select(SP.row_key().alias("k")).distinct().count() == clean.count()


def test_stage1_matrix_has_no_characterisation(clean):
    cats = FE.membrane_categories(clean)
    names = FE.recipe_feature_names(cats)
    assert not set(names) & set(FE.CHAR_FEATURES + FE.PHYSICS_COLS)
    f = FE.build_features(clean, cats, recipe_only=True)
    assert not set(f.columns) & set(FE.CHAR_FEATURES)


def test_unseen_membrane_is_all_zero(spark, clean):
    cats = FE.membrane_categories(clean)
    row = clean.limit(1).withColumn("membrane", F.lit("NEW"))
    f = FE.build_features(row, cats).first()
    assert all(f[f"base_{c}"] == 0.0 for c in cats)


def test_all_null_column_is_dropped_by_imputer(clean):
    cats = FE.membrane_categories(clean)
    f = FE.build_features(clean, cats)
    names = FE.feature_names(cats)
    med = IM.fit_medians(f, names)
    assert med["Ra_nm"] is None and med["Rq_nm"] is None
    out, kept = IM.apply_medians(f, med)
    assert "Ra_nm" not in kept and "Ra_nm" not in out.columns
    assert out.where(F.col("WCA_d").isNull()).count() == 0


def test_exact_median_matches_numpy(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert IM.fit_medians(df, ["x"])["x"] == 3.0


def test_zero_variance_r2_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert ME.regression_metrics(df, [], "y", "p").first().r2 is None


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.5)], "fail int, score double")
    r = ME.auc_ap(df, "score", "fail").first()
    assert r.roc_auc is None


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "fail int, score double")
    r = ME.auc_ap(df, "score", "fail").first()
    assert r.roc_auc == pytest.approx(0.875)
    assert r.average_precision == pytest.approx((1.0 + 2 / 3) / 2)


def test_empty_input_flows(spark, clean):
    empty = clean.limit(0)
    assert C.domain_filter_log(empty).where("n_present > 0").count() == 0
    cats = FE.membrane_categories(clean)
    assert FE.build_features(empty, cats).count() == 0


def test_histogram_closed_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "y double")
    h = {r.bin: r.n for r in ME.histogram(df, "y", 3).collect()}
    assert h == {0: 1, 1: 1, 2: 1}
