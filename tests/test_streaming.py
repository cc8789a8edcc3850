"""The stateless feature/score chain runs on a stream (file source -> parquet)."""

import os
import tempfile

from pyspark.sql import functions as F

from permea.operators import features as FE
from permea.streaming import score_stream as SS


def test_stream_scores_match_batch(spark, clean):
    src = tempfile.mkdtemp(prefix="permea-stream-src-")
    out = tempfile.mkdtemp(prefix="permea-stream-out-")
    cols = [f.name for f in SS.RECIPE_SCHEMA.fields]
    sample = clean.where(F.col("mg_rej").isNotNull()).limit(50) \
        .withColumn("density_part1", F.col("density_part1").cast("string")).select(*cols)
    sample.write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    cats = FE.membrane_categories(clean)
    stream = SS.read_recipe_stream(spark, os.path.join(src, "batch1"))
    q = SS.start(SS.score_stream(stream, cats, {"pressure": 5.0, "feed": 1000.0}), out,
                 name="t", available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 50
    assert got.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    assert "agg_nN" in got.columns and "base_Psf" in got.columns


def test_stream_with_a_trained_bundle(spark, clean):
    """No aggregate appears on the stream: the fills are given."""
    from permea.operators import models as MD
    from permea.plans import training
    src = tempfile.mkdtemp(prefix="permea-stream-src-")
    out = tempfile.mkdtemp(prefix="permea-stream-out-")
    cols = [f.name for f in SS.RECIPE_SCHEMA.fields]
    clean.limit(40).withColumn("density_part1", F.col("density_part1").cast("string")).select(*cols) \
        .write.mode("overwrite").parquet(os.path.join(src, "b"))
    res = training.quick_models(clean, MD.Profile(n_trees=2, max_depth=3, max_bins=32, gbt_iter=2),
                                targets=["Mg_rej", "Li_rej"], stage1=False)
    stream = SS.read_recipe_stream(spark, os.path.join(src, "b"))
    q = SS.start(SS.score_stream(stream, res.categories, {"pressure": 5.0, "feed": 1000.0}, res), out,
                 name="bundle", available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 40 and "mg_rej" in got.columns and got.where("pred_Mg_rej is null").count() == 0
