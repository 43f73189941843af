"""Engineered features and polynomial expansion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rugosa.functions import features as feat
from rugosa.operators.preprocess import engineered_np, poly_np


def _df(spark):
    return spark.createDataFrame([("a", 7.5, 0.05, 0.75, 0.4), ("b", 10.0, 0.0, 1.0, 0.9)],
                                 "run_id string, Vc double, Fz double, ap double, Ra double")


def test_engineered_columns_and_values(spark):
    out = feat.add_engineered_features(_df(spark)).orderBy("run_id").collect()
    assert set(feat.FEATURES_15) <= set(out[0].asDict())
    a = out[0]
    assert a["Vc2"] == 56.25 and a["Vc_Fz"] == 7.5 * 0.05
    assert a["Vc_Fz_ratio"] == pytest.approx(7.5 / (0.05 + 1e-9))
    assert a["log_Fz"] == pytest.approx(math.log(0.05 + 1e-9))
    # guarded log of a zero input is finite; unguarded ratio/log are NULL
    assert out[1]["log_Fz"] == pytest.approx(math.log(1e-9))
    raw = feat.add_engineered_features(_df(spark), guard_eps=None).orderBy("run_id").collect()[1]
    assert raw["Vc/Fz"] is None and raw["log_Fz"] is None


def test_spark_and_numpy_features_agree(spark):
    df = feat.add_engineered_features(_df(spark)).orderBy("run_id")
    sp = np.array([[r[c] for c in feat.FEATURES_15] for r in df.collect()])
    npv = engineered_np(np.array([[7.5, 0.05, 0.75], [10.0, 0.0, 1.0]]))
    assert np.allclose(sp, npv, rtol=1e-12)


@pytest.mark.parametrize("n,d,expected", [(15, 2, 135), (15, 3, 815), (15, 4, 3875), (12, 2, 90), (12, 4, 1819)])
def test_poly_sizes(n, d, expected):
    assert len(feat.poly_terms(n, d)) == expected


def test_poly_order_and_names(spark):
    terms = feat.poly_terms(3, 2)
    names = [feat.poly_term_name(t, ["a", "b", "c"]) for t in terms]
    assert names == ["a", "b", "c", "a^2", "a b", "a c", "b^2", "b c", "c^2"]
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    row = feat.poly_expand(df, ["a", "b", "c"], 2).collect()[0]
    assert list(row) == [2.0, 3.0, 5.0, 4.0, 6.0, 10.0, 9.0, 15.0, 25.0]
    assert np.allclose(poly_np(np.array([[2.0, 3.0, 5.0]]), 2)[0], list(row))


def test_feature_matrix_order(spark):
    m = feat.feature_matrix(feat.add_engineered_features(_df(spark)), feat.FEATURES_15).orderBy("run_id").collect()
    assert len(m[0]["x"]) == 15 and m[0]["x"][:3] == [7.5, 0.05, 0.75] and m[0]["y"] == 0.4


def test_poly_array_has_the_terms_in_order(spark):
    """One array expression against numpy products over the exponent tuples."""
    import numpy as np
    from pyspark.sql import functions as F

    from rugosa.functions.features import poly_array, poly_terms

    rng = np.random.default_rng(2)
    for n, degree in ((1, 4), (3, 1), (4, 3), (15, 3), (6, 4)):
        x = rng.uniform(-2, 2, (5, n))
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
        got = np.array([r["t"] for r in df.select("i", poly_array(F.col("x"), n, degree).alias("t")).orderBy("i").collect()])
        want = np.column_stack([np.prod(x[:, list(t)], axis=1) for t in poly_terms(n, degree)])
        assert got.shape == want.shape and np.allclose(got, want, rtol=1e-13)


def test_poly_degree_sums_equal_the_array_form(spark):
    """Bit for bit the terms of ``poly_array`` added in order, over more rows than a
    block; a NULL input gives NULL sums, a NaN one NaN."""
    from math import comb

    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.normal(size=4))) for i in range(2 * feat.POLY_ROWS + 5)]
    rows += [(len(rows), 1.0, None, 2.0, 3.0), (len(rows) + 1, 1.0, math.nan, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double").coalesce(1)
    cols, degree = [F.col(c) for c in "abcd"], 3
    out = df.select("*", feat.poly_array(F.array(*cols), 4, degree).alias("t"), feat.poly_degree_sums(cols, degree).alias("s"))
    at, want = 1, []
    for d in range(1, degree + 1):
        size = comb(4 + d - 1, d)
        want.append(F.aggregate(F.slice("t", at, size), F.lit(0.0), lambda a, b: a + b).alias(f"w{d}"))
        at += size
    for r in out.select(F.size("t").alias("n"), *want, "s").collect():
        assert r["s"]["n_terms"] == r["n"] == at - 1
        for d in range(1, degree + 1):
            assert repr(r["s"][f"sum_d{d}"]) == repr(r[f"w{d}"])
