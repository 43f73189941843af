"""Plan properties: scans read only the used columns; no cross joins."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    from __spark_entry__ import queries

    plan = _plan(queries()["scan_runs"](spark, SF))
    read = ",".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) or plan
    for unused in ("l_returnflag", "l_linestatus", "l_shipdate"):
        assert unused not in read
    plan = _plan(queries()["yeo_johnson_fit"](spark, SF))
    assert "ReadSchema: struct<value:double>" in plan


@pytest.mark.parametrize("name", ["stratified_kfold", "metrics_report", "permutation_importance",
                                  "robust_scale", "model_comparison_series", "importance_table"])
def test_no_cross_join(spark, name):
    from __spark_entry__ import queries

    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
