"""Metrics (A1-A10) against the golden values of the reference's metrics test."""

import pytest

from rugosa.operators.metrics import calculate_metrics, metrics_report, pooled_oof_mse

GOLDEN = {"MSE": 0.0075, "RMSE": 0.08660254037844395, "RMSE_%": 3.464101615137758, "MAE": 0.075,
          "MAE_%": 3.0, "MBE": 0.025, "MBE_%": 1.0, "MAPE": 4.583333333333333, "R2": 0.994}


def test_nine_metrics_golden(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 2.9), (4.0, 4.0)], "y double, p double")
    row = calculate_metrics(df, "y", "p").collect()[0].asDict()
    for k, v in GOLDEN.items():
        assert row[k] == pytest.approx(v, abs=1e-12), k


def test_r2_constant_target(spark):
    df = spark.createDataFrame([(2.0, 2.0, 1.0), (2.0, 2.0, 3.0)], "y double, a double, b double")
    rows = {r["model"]: r for r in metrics_report(df, "y", {"perfect": "a", "off": "b"}).collect()}
    assert rows["perfect"]["R2"] == 1.0 and rows["off"]["R2"] == 0.0


def test_zero_mean_abs_gives_null_percentages(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "y double, p double")
    row = calculate_metrics(df, "y", "p").collect()[0]
    assert row["RMSE_%"] is None and row["MAPE"] == pytest.approx(1e11)


def test_pooled_vs_fold_mean(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 1.0), (1, 1.0, 4.0)], "fold int, y double, p double")
    r = pooled_oof_mse(df, "y", {"m": "p"}).collect()[0]
    assert r["pooled_mse"] == pytest.approx((1 + 0 + 9) / 3)
    assert r["mean_fold_mse"] == pytest.approx((0.5 + 9) / 2)
