"""Physical-plan checks: pruning, partial aggregation, top-N, broadcast bounds."""

from permea.operators import clean as C
from permea.operators import dims as DM
from permea.plans import flagship as FL
from permea.sources.fixture import recipes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned(spark, sf_dir):
    p = plan(FL.best_measured_pairs(recipes(spark, sf_dir), 15))
    assert "l_returnflag" not in p and "p_name" not in p       # unused columns never read
    assert "TakeOrderedAndProject" in p                         # top-N without a global sort


def test_dedup_aggregates_partially(spark, sf_dir):
    d = C.dedup_first(C.with_synth_key(recipes(spark, sf_dir)))
    p = d._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in p or "partial_" in p               # map-side combine before shuffle
    assert "Window" not in p


def test_sized_dimension_follows_the_threshold(spark):
    """Spark broadcasts a written dimension by its bytes, and not beyond its threshold."""
    dim, key = DM.sized(spark.range(10)), "spark.sql.autoBroadcastJoinThreshold"
    assert "BroadcastHashJoin" in plan(spark.range(1000).join(dim, "id"))
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1")
        assert "SortMergeJoin" in plan(spark.range(1000).join(dim, "id"))
    finally:
        spark.conf.set(key, before)
