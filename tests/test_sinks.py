"""The retrain job and the tables of a run (S4-S9, M17) on sf0.001."""

from pyspark.sql import functions as F

from permea.operators import models as MD
from permea.operators import splits as SP
from permea.plans import sinks as SK

TINY = MD.Profile(n_trees=3, max_depth=4, max_bins=16, gbt_iter=3)


def test_retrain_trains_once_and_writes_every_table(spark, clean, tmp_path):
    out = str(tmp_path / "runs")
    options = {"targets": ["Mg_rej"], "candidates": {"ET.5": MD.CANDIDATES["ET.5"]}, "grouped": False, "holdouts": 1, "stage1": False}
    first = SK.retrain(clean, out, "fp-1", TINY, **options).first()
    assert first.retrain == "true" and first.run_id
    again = SK.retrain(clean, out, "fp-1", TINY, **options).first()
    assert (again.retrain, again.reason, again.run_id) == ("false", "up to date", None)
    n = clean.where("mg_rej IS NOT NULL").count()
    one = f"{out}/{{}}/run_id={first.run_id}/target=Mg_rej"
    assert spark.read.parquet(one.format("metrics")).first().CV_R2 is not None
    assert spark.read.parquet(one.format("importances")).count() > 10
    shap = spark.read.parquet(one.format("shap_values"))
    rows = shap.select(*SP.ROW_KEY_COLS).distinct().count()
    assert shap.count() == 20 * rows and 0.5 * n < rows <= n
    facts = {(r.fact, r.target): r.value for r in spark.read.parquet(f"{out}/run_facts").collect()}
    assert int(facts["n_rows", ""]) == clean.count() and ("candidate:ET.5", "Mg_rej") in facts and ("domain_filter", "Mg_rej") in facts
    model = SK.load_bundle(f"{out}/bundle").models["Mg_rej"]
    assert model.lo is not None and model.hi is not None
    SK.write_audit(spark.createDataFrame([("X", 1)], "method string, rank int"), out, first.run_id)
    assert spark.read.parquet(f"{out}/audit").where(F.col("run_id") == first.run_id).count() == 1
