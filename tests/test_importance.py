"""Permutation and importance tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rugosa.functions.features import FEATURES_12
from rugosa.operators import importance as imp


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 1500
    pdf = pd.DataFrame({"k": [f"id{i}" for i in range(n)], "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["y"] = 3 * pdf.a + 0.1 * rng.normal(size=n)
    return spark.createDataFrame(pdf), pdf


def test_permutation_preserves_multiset(spark, table):
    df, pdf = table
    out = imp.permute_column(df, "k", "a", repeat=3).toPandas()
    assert len(out) == len(pdf)
    assert np.allclose(np.sort(out["a_perm"]), np.sort(pdf["a"]))
    assert abs(np.corrcoef(out["a"], out["a_perm"])[0, 1]) < 0.15


def test_small_tables_are_permuted_as_a_whole(spark):
    """119 rows: about one row per repeat keeps its own value."""
    df = spark.createDataFrame([(f"r{i}", float(i)) for i in range(119)], "k string, a double")
    fixed = [imp.permute_column(df, "k", "a", repeat=r).where("a = a_perm").count() for r in range(8)]
    assert sum(fixed) <= 24 and len(set(fixed)) > 1


def test_importance_ranks_informative_feature(spark, table):
    df, _ = table
    res = imp.permutation_importance(df, "k", ["a", "b"], "y", {"lin": lambda c: F.lit(3.0) * c["a"]},
                                     n_repeats=4).toPandas().set_index("feature")
    assert res.loc["a", "importance"] > 10 and res.loc["b", "importance"] == pytest.approx(0.0, abs=1e-12)
    assert res.loc["a", "std"] >= 0


def test_mappings():
    lit = imp.literal_mapping(FEATURES_12)
    assert sorted(f for f, v in lit if v == "Fz") == sorted(["Fz", "Fz/ap", "Vc/ap"])
    assert [f for f, v in lit if v == "Vc"] == ["Vc"] and [f for f, v in lit if v == "ap"] == ["ap"]
    lin = imp.lineage_mapping(FEATURES_12)
    assert sorted(v for f, v in lin if f == "Vc/ap") == ["Vc", "ap"]
    assert sorted(v for f, v in lin if f == "Fz2") == ["Fz"]


def test_group_normalize_table(spark):
    raw = spark.createDataFrame([("m", "Vc", 2.0, 0.1), ("m", "Vc_Fz", 1.0, 0.3), ("m", "ap", 1.0, 0.2)],
                                "method string, feature string, importance double, std double")
    g = imp.group_importance(raw, imp.lineage_mapping(["Vc", "Vc_Fz", "ap"]))
    n = {r["variable"]: r["importance"] for r in imp.normalize_importance(g).collect()}
    assert n == pytest.approx({"Vc": 0.6, "Fz": 0.2, "ap": 0.2})
    s = {r["variable"]: r["std"] for r in g.collect()}
    assert s["Vc"] == pytest.approx(0.2) and s["Fz"] == pytest.approx(0.3)
    t = imp.importance_table(imp.normalize_importance(g), ["m"]).collect()
    assert len(t) == 3


def test_one_shuffle_gives_the_pairs_of_the_two_ranks(spark, monkeypatch):
    """Chunks of ranks hold the receivers and donors that the join of exact ranks
    pairs, over several chunks and pieces; NULL, NaN and -0.0 stay what they are, a row
    without a key takes no part."""
    monkeypatch.setattr(imp, "PACK_ROWS", 700)
    rows = [(f"id{i}", float(i), [None, math.nan, -0.0, 0.25][i % 4], float(i % 7)) for i in range(9000)] + [(None, -1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double").repartition(3)
    want = imp.permutation_pairs(df, "k", ["a", "b"], "y", 3).select("rep", "a", "b", "_pv.p0", "_pv.p1", "y")
    got = imp.permutation_rows(df, "k", ["a", "b"], "y", 3).select("rep", "o0", "o1", "p0", "p1", "y")
    plain = lambda d: sorted(repr(tuple(r)) for r in d.collect())
    assert plain(got) == plain(want) and got.count() == 27000


def test_rows_of_equal_inputs_share_an_evaluation(spark):
    """A model is evaluated once for equal inputs and values over all repeats, and its
    importances are those of a plain pass over the pairs."""
    rows = [(f"id{i}", float(i % 5), float(i % 3), float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    seen = spark.sparkContext.accumulator(0)

    def predict(x):
        return 2.0 * x[:, 0] + x[:, 1] * x[:, 1]

    def swapped(x):
        def run(j, at, values):
            seen.add(len(at))
            c = x[at]
            c[:, j] = values
            return predict(c)
        return run

    got = {r["feature"]: r for r in imp.model_permutation_importance(df, "k", ["a", "b"], "y", predict, "m", 4, swapped=swapped).collect()}
    assert 0 < seen.value <= 15 * (5 + 3)
    p = imp.permutation_pairs(df, "k", ["a", "b"], "y", 4).select("rep", "a", "b", "_pv.p0", "_pv.p1", "y").toPandas()
    base = np.mean([(2 * a + b * b - y) ** 2 for _, a, b, y in rows])
    for j, f in enumerate("ab"):
        a, b = (p.p0, p.b) if j == 0 else (p.a, p.p1)
        d = ((2 * a + b * b - p.y) ** 2).groupby(p.rep).mean() - base
        assert got[f]["importance"] == pytest.approx(d.mean(), rel=1e-9) and got[f]["std"] == pytest.approx(d.std(ddof=0), rel=1e-6)


def test_large_tables_take_their_repeats_in_rounds(spark, monkeypatch):
    """A few repeats at a time give what all at once give, and no shuffle holds more than
    a round's: six bytes of a hash and two of a code for a row and repeat."""
    rows = [(f"id{i}", float(i % 50), float(i % 11), float(i % 7)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    once = imp.model_permutation_importance(df, "k", ["a", "b"], "y", lambda x: x[:, 0] * x[:, 1], "m", 5).collect()
    asked, plain = [], imp.aligned_chunks
    monkeypatch.setattr(imp, "WHOLE_ROWS", 1000)
    monkeypatch.setattr(imp, "aligned_chunks", lambda *a: asked.append(list(a[6])) or plain(*a))
    parts = imp.model_permutation_importance(df, "k", ["a", "b"], "y", lambda x: x[:, 0] * x[:, 1], "m", 5).collect()
    assert sum(asked, []) == [0, 1, 2, 3, 4] and max(map(len, asked)) <= imp.REPEATS_AT_ONCE
    assert [r["feature"] for r in parts] == [r["feature"] for r in once]
    for p, o in zip(parts, once):
        assert p["importance"] == pytest.approx(o["importance"], rel=1e-12) and p["std"] == pytest.approx(o["std"], rel=1e-9)


def test_rows_travel_in_few_bytes():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, n, 5000).astype(np.float64).view(np.uint64) for n in (50, 11, 9)] + [rng.normal(size=5000).view(np.uint64)]
    code, data, values = imp._packed_columns(columns)
    assert code.itemsize == 2 and values[3] is None and (data[3] == columns[3]).all()
    for i in (2, 1, 0):
        assert (values[i][code % len(values[i])] == columns[i]).all()
        code = code // len(values[i])


def test_equal_keys_are_ordered_by_values(spark, monkeypatch):
    """Whatever is left of a hash, every repeat is a permutation, the same on any split."""
    monkeypatch.setattr(imp, "KEY_BITS", 18)
    rows = [(f"id{i}", float(i), float(i % 7)) for i in range(5000)]
    got = []
    for n in (1, 5):
        df = spark.createDataFrame(rows, "k string, a double, y double").repartition(n)
        got.append(sorted(map(tuple, imp.permutation_rows(df, "k", ["a"], "y", 2).select("rep", "o0", "p0", "y").collect())))
    assert got[0] == got[1]
    for r in range(2):
        for i in (1, 2):
            assert sorted(x[i] for x in got[0] if x[0] == r) == [float(i) for i in range(5000)]


def test_predictions_are_remembered_over_chunks(monkeypatch):
    asked = []

    def score(x):
        return lambda j, rows, values: asked.append(len(rows)) or x[rows, 1 - j] * 100 + values

    known = imp._Scores(2)
    for keep in (True, False):
        for shift in (0, 0, 1):
            x = np.array([[a + shift, b] for a in range(4) for b in range(3)], np.float64)
            run = known.of(np.ascontiguousarray(x.T).view(np.uint64), x, score(x))
            for j in range(2):
                values = np.unique(x[:, j])
                rows, which = (v.ravel() for v in np.meshgrid(np.arange(len(x)), np.arange(len(values))))
                assert (run(j, rows, values, which) == x[rows, 1 - j] * 100 + values[which]).all()
        every = 12 * 4 + 12 * 3
        assert every < sum(asked) < 2 * every if keep else sum(asked) == 3 * every
        asked.clear()
        monkeypatch.setattr(imp, "KNOWN_CELLS", 1)
        known = imp._Scores(2)
