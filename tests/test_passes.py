"""How often the recipe table is read, ranks, splits and correlations in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permea.operators import clean, order, select
from permea.operators import splits as SP
from permea.plans import catalog
from permea.sources import fixture as FX


def test_spread_gives_the_same_rows(spark, sf_dir):
    a, b = FX.recipes(spark, sf_dir), FX.recipes(spark, sf_dir, spread=True)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert b.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _sources(df):
    return {"lineitem" if "lineitem.parquet" in f else "written" for f in df.inputFiles()}


@pytest.mark.parametrize("name", ["p12_molecular", "p15_operating", "p19_feature_matrix", "p20_recipe_features", "p33_physics_subset",
                                  "a11_shap_summary", "m4_residual_interval", "m5_blend_weight", "m10_batch_score"])
def test_queries_of_several_passes_read_the_written_table(spark, sf_dir, name):
    """Each pass over an unwritten table would deduplicate all rows again."""
    if name == "m10_batch_score":
        c, _ = catalog._quick(spark, sf_dir, targets=["Mg_rej"])
        assert _sources(c) == {"written"}
    else:
        assert _sources(catalog.QUERIES[name](spark, sf_dir)) == {"written"}


def test_global_rank_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 5000, 1, 4).select((F.col("id") * 7919 % 1009).alias("v"), "id").mapInArrow(count, "v long, id long")
    got = [(r.v, r.id, r.i) for r in order.global_rank(df, [F.col("v"), F.col("id")], "i").collect()]
    want = sorted((i * 7919 % 1009, i) for i in range(5000))
    assert sorted(got, key=lambda r: r[2]) == [(*r, i) for i, r in enumerate(want)]
    assert seen.value == 5000


def test_holdout_seeds_are_those_of_the_copied_rows(spark):
    df = spark.createDataFrame([(f"k{i % 90}",) for i in range(300)] + [(None,)], "k string")
    seeds = list(range(5))
    copied = SP.with_holdout(SP.seeds_frame(df, seeds), F.col("k"), F.col("seed"), 0.2).where("is_test").groupBy("k", "seed").count()
    listed = df.select("k", F.explode(SP.holdout_seeds(F.col("k"), seeds, 0.2)).alias("seed")).groupBy("k", "seed").count()
    assert sorted(map(tuple, copied.collect())) == sorted(map(tuple, listed.collect()))


def test_correlations_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        a = float(rng.normal()) + 1e6
        y = 2 * a + float(rng.normal())
        rows.append((a if i % 5 else None, 1e6 + 0.1, float("nan") if i == 3 else a, None, y if i % 3 else None, -a, 4.0))
    df = spark.createDataFrame(rows, "a double, constant double, odd double, empty double, y double, z double, flat double").repartition(6)
    got = {(r.target, r.feature): r.importance for r in select.correlation_importance(
        df, ["a", "constant", "odd", "empty"], {t: F.col(t) for t in ("y", "z", "flat")}, "target").collect()}

    def corr(i, j):
        both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        return abs(np.corrcoef(both.T)[0, 1])

    want = {("y", "a"): corr(0, 4), ("z", "a"): corr(0, 5)}
    if rows[3][4] is None:  # the row with NaN has no y
        want["y", "odd"] = corr(2, 4)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    none = select.correlation_importance(df.limit(0), ["a"], {"y": F.col("y")}, "target")
    assert none.count() == 0


def test_open_session_settings_are_filled(spark):
    """Generated methods that HotSpot would not compile are not used; a session's own limit stays."""
    from permea.session import fill_gaps
    key = "spark.sql.codegen.hugeMethodLimit"
    own = spark.newSession()
    fill_gaps(own)
    assert own.conf.get(key) == "8000"
    own.conf.set(key, "20000")
    fill_gaps(own)
    assert own.conf.get(key) == "20000"


def test_slot_text_is_read_once_a_monomer(spark):
    """P14's patterns run on the distinct monomers, not on every row; the values are those of the rows' own text."""
    from permea.operators import features as FE
    texts = ["{NCCN}3.4", " {NCCN} 19 ", "NCCN", "  ", "", None, "{X}1.2.3", "nan"]
    rows = [(i, texts[i % 8], texts[(i * 3 + 1) % 8], 0.5, None if i % 3 else 2.0) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, smiles_part1 string, smiles_part2 string, density_part1 double, density_part2 double")
    df = clean.with_recipe_columns(df)
    joined = FE.build_features(df, ["Unk"], keep=["id"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan
    by_row = df.select("id", *[c.alias(k) for k, c in FE.structure_columns().items()])
    want = {r.id: r.asDict() for r in by_row.collect()}
    got = {r.id: r.asDict() for r in joined.select("id", *FE.STRUCTURE_COLS).collect()}
    assert len(want) == 24 and got == want
    assert want[0]["mw_tag_1"] == 3.4 and want[6]["mw_tag_1"] is None and want[3]["n_steps"] == 1.0


def test_even_folds_carry_the_row_key_only(spark, sf_dir, monkeypatch):
    """The deduplication and the ranked tables of V1 hold no measured column and no key text; the folds are those of whole rows."""
    from permea.operators.clean import clean_recipes
    seen = {}
    real = order.materialize
    monkeypatch.setattr(order, "materialize", lambda df, name: seen.setdefault(name, df) and real(df, name))
    got = catalog.QUERIES["v1_even_row_folds"](spark, sf_dir)
    plan = seen["to-rank"]._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1].split("\n")[0]
    assert "l_shipdate" in plan and "thickness" not in plan and "more fields" not in plan
    assert set(seen["to-rank"].columns) == {*SP.ROW_KEY_COLS, "_o0"}
    ranked = order.global_rank(clean_recipes(FX.recipes(spark, sf_dir)), [SP.hash32(SP.row_key(), 42), SP.row_key()], "i")
    want = ranked.select(*catalog.ROW_ID, (F.col("i") % 5).cast("int").alias("fold"))
    assert got.count() == want.count() > 5000 and got.exceptAll(want).isEmpty()


def test_ranks_with_ties_in_what_is_held(spark):
    df = spark.createDataFrame([(i % 3, None if i % 11 == 0 else f"k{i * 7 % 50:02d}", i) for i in range(50)], "a int, k string, id int").repartition(5)
    parts = [F.col("a"), F.concat(F.col("k"), F.lit("x")), F.col("id")]
    rows = lambda held: sorted(map(tuple, order.global_rank(df, parts, "i", held).collect()), key=str)
    assert rows(1) == rows(None) and sorted(r[-1] for r in rows(1)) == list(range(50))


def test_dedup_of_some_columns_keeps_the_same_rows(spark):
    rows = [(1, None, "u", 5.0), (1, 2, "v", 6.0), (2, 3, None, 7.0), (2, 3, "w", None), (None, 1, "x", 8.0), (None, 0, "y", None)]
    df = spark.createDataFrame(rows, "k int, o int, t string, v double")
    whole = clean.dedup_first(df, ["k"], ["o"]).select("k", "o", "t")
    assert sorted(map(str, whole.collect())) == sorted(map(str, clean.dedup_first(df, ["k"], ["o"], keep=["t"]).collect()))
    assert clean.dedup_first(df, ["k"], ["o"], keep=[]).columns == ["k", "o"]


def test_predictions_beside_what_is_kept(spark):
    """What a comparison does not read is not written again with the predictions."""
    from permea.operators import models as MD
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(a - b), i % 3) for i, (a, b) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, z double, fold int")
    specs = {"Ridge": MD.Spec("ridge"), "ET": MD.Spec("et", 1.0), "GBR": MD.Spec("gbt", iters=40, depth=2)}
    every = MD.oof(df, "fold", 3, ["a", "b"], "z", specs, MD.FAST)
    assert every.columns[:5] == df.columns
    few = MD.oof(df, "fold", 3, ["a", "b"], "z", specs, MD.FAST, keep=["id", "z"])
    assert set(few.columns) == {"id", "z", "oof_Ridge", "oof_ET", "oof_GBR"}
    got, want = ({r.id: (r.z, r.oof_Ridge, r.oof_ET, r.oof_GBR) for r in o.collect()} for o in (few, every))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
