"""Spark queries against their DuckDB oracle SQL at sf0.001 (fast subset).

The full set runs at sf0.01 with ``python tools/oracle_check.py``.
"""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, compare

FAST = ["flagship_best_pairs", "p2_synth_key", "p3_dedup_first", "p6_domain_filter_log",
        "p10_candidates", "p11_descriptors", "p19_feature_matrix", "p26_composite_score",
        "a4_regression_metrics", "a7_auc_average_precision", "a12_histogram", "v2_group_folds",
        "m5_blend_weight", "j2_monomer_grid"]


@pytest.fixture(scope="module")
def con(sf_dir):
    import os
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, sf_dir, con, name):
    s = E.queries()[name](spark, sf_dir).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    assert compare(s, d) == "ok"


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "score" in df.columns
