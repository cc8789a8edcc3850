"""Model-layer invariants on a tiny profile (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from permea.operators import growth
from permea.operators import models as MD
from permea.operators import splits as SP
from permea.plans import explain as XP
from permea.plans import training as TRN

TINY = MD.Profile(n_trees=3, max_depth=4, max_bins=32, gbt_iter=3)


@pytest.fixture(scope="module")
def mg(clean):
    feats, cats, names = TRN.feature_table(clean)
    return TRN.target_frame(feats, "Mg_rej").cache(), names


def test_oof_predicts_every_row_once(mg):
    d, names = mg
    o = MD.oof(d, "fold", 5, names, "z", {"ET.5": MD.CANDIDATES["ET.5"]}, TINY)
    assert o.count() == d.count()
    assert o.select(SP.row_key().alias("k")).distinct().count() == d.count()
    assert o.where(F.col("oof_ET_5").isNull()).count() == 0


def test_imputer_fitted_on_training_rows_only(mg):
    d, names = mg
    tr = d.where("fold != 0")
    m = MD.fit(tr, names, "z", MD.CANDIDATES["ET.5"], TINY)
    from permea.operators.impute import fit_medians
    assert m.medians == fit_medians(tr, names)


def test_path_shap_additivity(mg):
    d, names = mg
    m = MD.fit(d, names, "z", MD.CANDIDATES["ET.5"], TINY)
    long, check, base = XP.path_shap(d, m, SP.ROW_KEY_COLS)
    err = check.agg(F.max(F.abs(F.col("prediction") - F.col("base_plus_phi")))).first()[0]
    assert err < 1e-9
    assert check.count() == d.count()


def test_constant_feature_has_zero_permutation_importance(mg):
    d, names = mg
    d2 = d.withColumn("const_feature", F.lit(1.0))
    m = MD.fit(d2, names + ["const_feature"], "z", MD.CANDIDATES["ET.5"], TINY)
    imp = XP.permutation_importance(d2, m, "z", SP.ROW_KEY_COLS, n_repeats=1)
    v = imp.where(F.col("feature") == "const_feature").first().importance
    assert v == pytest.approx(0.0, abs=1e-12)


def test_interval_is_ordered(clean):
    res = TRN.quick_models(clean, TINY, targets=["Mg_rej"], stage1=False, intervals=True)
    from permea.plans.scoring import score_batch
    s = score_batch(clean.limit(200), res)
    bad = s.where((F.col("pred_Mg_rej_lo") > F.col("pred_Mg_rej_hi")) | (F.col("pred_Mg_rej_hi") > 100)
                  | (F.col("pred_Mg_rej_lo") < 0))
    assert bad.count() == 0


def test_onehot_unseen_monomer_and_select_k(mg):
    d, names = mg
    tr = d.where("fold != 0")
    spec = MD.Spec("et", 0.7, onehot=("smiles_part1", "smiles_part2"), select_k=10)
    m = MD.fit(tr, names, "z", spec, TINY)
    assert len(m.kept) == 10
    new = d.where("fold = 0").limit(5).withColumn("smiles_part1", F.lit("NEVER_SEEN"))
    out = m.transform(new, "p")
    assert out.where(F.col("p").isNull()).count() == 0 and out.count() == 5


def test_scoring_keeps_measured_targets(clean):
    from permea.plans.scoring import score_batch
    res = TRN.quick_models(clean, TINY, targets=["Mg_rej", "Li_rej"], stage1=False)
    rows = clean.where("mg_rej is not null").limit(50).cache()
    s = score_batch(rows, res)
    assert {c for c in s.columns if c.startswith("pred_")} == {"pred_Mg_rej", "pred_Li_rej"}
    key = SP.ROW_KEY_COLS + ["mg_rej", "li_rej"]
    assert s.select(*key).exceptAll(rows.select(*key)).count() == 0
    assert s.where("abs(pred_Mg_rej - mg_rej) > 1e-6").count() > 0
    with pytest.raises(ValueError):
        score_batch(s, res)


def test_ridge_equals_closed_form(spark):
    """min SSE + 20 |w|^2 on features scaled by their population deviation."""
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, (200, 2))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.3, 200) + 5
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = MD.fit(df, ["a", "b"], "y", MD.Spec("ridge", reg=20.0), TINY)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 20 * np.eye(2), z.T @ (y - y.mean()))
    got = np.array([r.p for r in m.transform(df, "p").collect()])
    assert np.allclose(got, z @ w + y.mean(), atol=1e-6)


def test_boosted_depth_and_sizes(mg):
    d, names = mg
    for depth in (2, 3):
        spec = MD.Spec("gbt", loss="absolute", iters=350, rate=0.025, depth=depth)
        m = MD.fit(d, names, "z", spec, TINY)
        assert max(t.depth for t in m.model.trees) == depth
    full = MD.make_estimator(spec, MD.FULL)
    assert (full.getMaxIter(), full.getStepSize(), full.getMaxDepth()) == (350, 0.025, 3)
    risk = MD.grown_fit(MD.RISK_SPEC, MD.FULL, 0, growth.Rows(()), [0], [0.0])
    assert (risk.trees, risk.min_leaf, risk.max_depth) == (700, 3, 30)


def test_indicators_only_for_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, None, 2.0), (3.0, 4.0, 3.0), (4.0, 2.0, 5.0)], "a double, b double, y double")
    m = MD.fit(df, ["a", "b"], "y", MD.Spec("et", 1.0, indicators=True), TINY)
    assert m.kept == ["a", "b", "missing_b"]
    assert [f for f in m.transform(df, "p").select("b").collect()][1].b is None


def test_physics_subset_candidate(mg):
    from permea.operators import features as FE
    d, names = mg
    m = MD.fit(d, names, "z", MD.Spec("et", 1.0, subset=FE.PHYSICS_PREFIXES), TINY)
    assert set(m.kept) <= set(FE.physics_subset(names)) and m.kept


def test_bundle_keeps_onehot(mg, tmp_path):
    from permea.plans import sinks as SK
    d, names = mg
    m = MD.fit(d, names, "z", MD.Spec("et", 0.7, onehot=("smiles_part1",)), TINY)
    res = TRN.TrainResult([], names)
    res.models["Mg_rej"] = TRN.TargetModel("Mg_rej", ["X"], [1.0], [m])
    SK.save_bundle(res, str(tmp_path / "b"))
    back = SK.load_bundle(str(tmp_path / "b")).models["Mg_rej"]
    a = sorted(r.p for r in res.models["Mg_rej"].predict_z(d, "p").collect())
    assert a == sorted(r.p for r in back.predict_z(d, "p").collect())


def test_path_shap_of_a_constant_label(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(30)], "id int, a double, y double")
    m = MD.fit(df, ["a"], "y", MD.Spec("et", 1.0), TINY)
    _, check, base = XP.path_shap(df, m, ["id"])
    assert base == 1.0 and check.where("abs(prediction - base_plus_phi) > 1e-9").count() == 0


def test_cascade_and_risk(mg):
    from permea.plans import audit as AU
    d, names = mg
    exps = {"ET leaf=1 mf=0.5": AU.AUDIT_EXPERIMENTS["ET leaf=1 mf=0.5"], "GBR depth=2": AU.AUDIT_EXPERIMENTS["GBR depth=2"]}
    out = {(r.threshold, r.gate) for r in AU.cascade(d, names, TINY, exps).collect()}
    assert out == {(t, g) for t in (80.0, 85.0, 90.0) for g in ("soft", "hard")}
    p = AU.risk_oof(d, names, TINY)
    assert p.count() == d.count() and p.where("p_RISK < 0 or p_RISK > 1 or p_RISK is null").count() == 0
