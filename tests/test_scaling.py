"""Robust scaling, Yeo-Johnson fit/apply/inverse, standardisation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rugosa.functions import scaling as sc
from rugosa.operators.preprocess import yj_np


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.lognormal(0, 1, 300), -rng.exponential(1, 100)])
    return spark.createDataFrame(pd.DataFrame({"x": x})), x


def test_yeo_johnson_apply_matches_numpy(spark, data):
    df, x = data
    for lam in (-1.0, 0.0, 0.5, 2.0, 3.0):
        got = np.array([r[0] for r in df.select(sc.yeo_johnson(F.col("x"), lam)).collect()])
        assert np.allclose(got, yj_np(x[:, None], np.array([lam]))[:, 0], rtol=1e-12, atol=1e-12)


def test_inverse_round_trip(spark, data):
    df, x = data
    back = df.select(sc.yeo_johnson_inverse(sc.yeo_johnson(F.col("x"), F.lit(0.7)), F.lit(0.7))).collect()
    assert np.allclose([r[0] for r in back], x, rtol=1e-10, atol=1e-10)


def test_lambda_fit_matches_brute_force(spark, data):
    df, x = data
    grid = np.linspace(-2, 3, 501)
    ll = [-len(x) / 2 * np.log(np.var(yj_np(x[:, None], np.array([g]))[:, 0]))
          + (g - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x))) for g in grid]
    assert sc.yj_fit_lambda(df, "x") == pytest.approx(grid[int(np.argmax(ll))], abs=0.02)


def test_robust_scale_and_standardize(spark, data):
    df, x = data
    rs = np.array([r[0] for r in sc.robust_scale(df, ["x"]).collect()])
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    assert np.allclose(rs, (x - med) / (q3 - q1), rtol=1e-12)
    st = np.array([r[0] for r in sc.standardize(df, ["x"]).collect()])
    assert np.allclose(st, (x - x.mean()) / x.std(), rtol=1e-10)


def test_zero_spread_divides_by_one(spark):
    df = spark.createDataFrame([(3.0,)] * 4 + [(9.0,)], "x double")
    assert [r[0] for r in sc.robust_scale(df, ["x"]).collect()] == [0.0] * 4 + [6.0]
