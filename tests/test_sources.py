"""S1 file loading (temp files skipped, union by name, provenance) and S2."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from permea.sources import files as FI


def _write_csv(path, header, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_load_csv_union_by_name_skips_temp(spark):
    d = tempfile.mkdtemp(prefix="permea-s1-")
    _write_csv(os.path.join(d, "a.csv"), ["SMILES_part1", "Mg2+", "Pressure(bar)"],
               [["C1CNCCN1", "97.5", "5"], ["NCCN", "bad", "6"]])
    _write_csv(os.path.join(d, "b.csv"), ["Mg2+", "SMILES_part1", "Li+"], [["90", "NCCN", "20"]])
    _write_csv(os.path.join(d, "~$a.csv"), ["junk"], [["x"]])
    df = FI.load_recipe_files(spark, d, "csv")
    assert set(["smiles_part1", "mg_rej", "pressure", "li_rej", "source_file"]) <= set(df.columns)
    assert df.count() == 3
    files = {r.source_file for r in df.select("source_file").distinct().collect()}
    assert files == {"a.csv", "b.csv"}
    from permea.operators.clean import coerce_numeric
    c = coerce_numeric(df, ["mg_rej"])
    assert c.where(F.col("mg_rej").isNull()).count() == 1


def test_load_parquet_with_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="permea-s1p-")
    spark.createDataFrame([("A", 1.0)], "`SMILES_part1` string, `Mg2+` double") \
        .write.parquet(os.path.join(d, "x.parquet"))
    spark.createDataFrame([("B",)], "`SMILES_part1` string") \
        .write.parquet(os.path.join(d, "y.parquet"))
    df = FI.load_recipe_files(spark, d, "parquet")
    assert df.count() == 2 and "mg_rej" in df.columns


def test_fingerprint_stable_and_changes(spark):
    d = tempfile.mkdtemp(prefix="permea-fp-")
    p1 = os.path.join(d, "a.csv")
    _write_csv(p1, ["x"], [["1"]])
    a = FI.fingerprint(spark, [p1]).first().fingerprint
    b = FI.fingerprint(spark, [p1]).first().fingerprint
    assert a == b
    time.sleep(1.1)
    p2 = os.path.join(d, "b.csv")
    _write_csv(p2, ["x"], [["2"]])
    c = FI.fingerprint(spark, [p1, p2]).first()
    assert c.fingerprint != a and c.n_files == 2


def test_unreadable_file_is_reported(spark):
    import pytest
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    d = tempfile.mkdtemp(prefix="permea-s1u-")
    spark.createDataFrame([("A", 1.0)], "`SMILES_part1` string, `Mg2+` double").coalesce(1).write.parquet(os.path.join(d, "x.parquet"))
    with open(os.path.join(d, "bad.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises((PySparkException, Py4JJavaError)):
        FI.load_recipe_files(spark, d, "parquet")
    skipped = []
    assert FI.load_recipe_files(spark, d, "parquet", skipped).count() == 1
    assert len(skipped) == 1 and skipped[0][0].endswith("bad.parquet")


def test_files_to_clean_to_model(spark):
    """A lab folder without any column of the derived table: load, clean (the first
    of duplicates in file order stays), train and score."""
    from permea.operators import models as MD
    from permea.operators.clean import clean_recipes
    from permea.plans import scoring, training
    d = tempfile.mkdtemp(prefix="permea-s1m-")
    head = ["SMILES_part1", "SMILES_part2", "Density_part1(wt%)", "Covered Time_1(s)", "Mg2+", "Li+", "Flux Mg2+", "PWP", "Foundational Membrane"]
    rows = [["C1CNCCN1", "O=C(Cl)c1ccc(cc1)C(=O)Cl", str(0.1 + i % 7), str(30 + i % 5), str(80 + i % 17), str(20 + i % 9), str(3 + i % 4), "8", "Psf"]
            for i in range(60)]
    _write_csv(os.path.join(d, "b.csv"), head, rows[30:])
    _write_csv(os.path.join(d, "a.csv"), head, rows[:30] + rows[:2])
    _write_csv(os.path.join(d, "c.csv"), list(reversed(head)), [list(reversed(rows[0]))])
    raw = FI.load_recipe_files(spark, d, "csv")
    assert raw.count() == 63
    clean = clean_recipes(raw)
    assert clean.count() == 60
    assert clean.where("source_file = 'c.csv'").count() == 0
    assert clean.where("source_file = 'a.csv'").agg(F.max("source_row")).first()[0] == 29
    tiny = MD.Profile(n_trees=2, max_depth=3, max_bins=16, gbt_iter=2)
    res = training.quick_models(clean, tiny, targets=["Mg_rej", "Li_rej"], stage1=False)
    scored = scoring.score_batch(clean, res)
    assert scored.count() == 60 and scored.where("score is null or pred_Mg_rej is null").count() == 0
