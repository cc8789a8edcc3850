"""Hand-worked cases for the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from permea.functions import chem as CH
from permea.functions import transforms as TR
from permea.functions.score import composite_score, mg_retention_logscore


def one(spark, exprs, data, schema="s string"):
    df = spark.createDataFrame(data, schema)
    return df.select(*exprs).collect()


def test_parse_monomer(spark):
    rows = [("{NCCN}3.4",), ("{NCCN} 132",), ("{X}1.2.3",), ("NCCN",), (None,)]
    base, tag = CH.parse_monomer("s")
    out = one(spark, [base.alias("b"), tag.alias("t")], rows)
    assert [(r.b, r.t) for r in out] == [("NCCN", 3.4), ("NCCN", 132.0), ("X", None),
                                         ("NCCN", None), (None, None)]


def test_descriptors_pip_and_tmc(spark):
    d = CH.descriptors("s")
    out = one(spark, [v.alias(k) for k, v in d.items()],
              [("C1CNCCN1",), ("O=C(Cl)C1=CC(C(=O)Cl)=CC(C(=O)Cl)=C1",), ("nan",), (None,)])
    pip, tmc, nan, null = [r.asDict() for r in out]
    assert pip == {"mw": 76.0, "nN": 2.0, "nO": 0.0, "nCl": 0.0, "nF": 0.0, "nC": 4.0,
                   "n_ring": 1.0, "n_amine": 2.0, "n_acyl": 0.0, "n_arom": 0.0, "length": 8.0}
    assert tmc["n_acyl"] == 2.0 and tmc["nCl"] == 3.0 and tmc["nO"] == 3.0
    assert tmc["nC"] == 9.0 and tmc["n_ring"] == 1.0
    assert all(v == 0.0 for v in nan.values()) and all(v == 0.0 for v in null.values())


def test_polymer_descriptors_use_base(spark):
    d = CH.descriptors("s")
    a, b = one(spark, [d["length"].alias("n")], [("{NCCN}19",), ("NCCN",)])
    assert a.n == b.n == 4.0


def test_valid_and_route(spark):
    rows = [("C1CNCCN1",), ("{NCCN}19",), ("x",), ("O=C(Cl)CCCCC(=O)Cl",), ("a.b.c.d",), ("nan",)]
    out = one(spark, [CH.is_valid_smiles("s").alias("v"), CH.is_acyl("s").alias("a"),
                      CH.is_amine("s").alias("m")], rows)
    assert [r.v for r in out] == [True, False, False, True, False, True]
    assert [r.a for r in out][3] is True and out[3].m is False
    assert out[0].m is True and out[5].m is True     # the text 'nan' routes as an amine


def test_mg_logscore(spark):
    out = one(spark, [F.round(mg_retention_logscore("r"), 2).alias("x")],
              [(95.0,), (99.0,), (100.0,), (None,)], "r double")
    assert [r.x for r in out] == [1.30, 2.00, 3.30, None]


def test_composite_zero_separation(spark):
    parts = composite_score("mg", "li", "flux", "pwp")
    out = one(spark, [parts["separation"].alias("s"), parts["score"].alias("score")],
              [(0.0, 50.0, 10.0, 5.0), (99.0, 100.0, 10.0, 5.0), (99.0, 10.0, 40.0, 30.0)],
              "mg double, li double, flux double, pwp double")
    assert out[0].s == 0.0 and out[1].s == 0.0
    assert 0.0 <= out[2].score <= 1.0
    assert out[2].score == pytest.approx(0.8 * out[2].s + 0.12 + 0.08)


def test_composite_weights_drop_per_call(spark):
    parts = composite_score("mg", "li")
    out = one(spark, [parts["score"].alias("score"), parts["separation"].alias("s")],
              [(99.0, 10.0)], "mg double, li double")
    assert out[0].score == pytest.approx(out[0].s)


@pytest.mark.parametrize("target", ["Mg_rej", "Li_rej", "PWP", "Flux_Mg"])
def test_transform_roundtrip(spark, target):
    y = [(0.0,), (12.5,), (80.0,), (99.9,)]
    out = one(spark, [TR.inv_transform(target, TR.fwd_transform(target, "y")).alias("b")], y,
              "y double")
    for (v,), r in zip(y, out):
        assert r.b == pytest.approx(v, abs=1e-9)


def test_logit_roundtrip_and_clip(spark):
    out = one(spark, [TR.logit_inv(TR.logit_fwd("y")).alias("b")],
              [(50.0,), (0.0,), (100.0,)], "y double")
    assert out[0].b == pytest.approx(50.0)
    assert out[1].b == pytest.approx(0.5) and out[2].b == pytest.approx(99.5)
    assert math.isfinite(out[2].b)
