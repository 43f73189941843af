"""Registered queries against their DuckDB oracles on sf0.001 (a subset;
``tools/oracle_check.py`` runs all of them)."""

import os

import duckdb
import pytest

from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
NAMES = ["scan_runs", "clean_cast", "engineered_features", "poly_features_d2", "robust_scale",
         "yeo_johnson_fit", "target_roundtrip", "stratified_kfold", "metrics_report", "ridgecv_stacking",
         "permutation_importance", "importance_table", "target_histogram", "model_comparison_series"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="test data absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(rel.columns, orows)[0]


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    out = entry(spark)
    assert out.columns[0] == "model" and out.count() == 4
