"""Quantile bins, stratified folds, dense ranks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rugosa.operators import folds as fo


def _qcut_codes(y, q=5):
    edges = np.unique(np.quantile(y, np.linspace(0, 1, q + 1)))
    return np.clip(np.searchsorted(edges, y, side="left") - 1, 0, len(edges) - 2)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    y = np.round(np.concatenate([np.full(400, 1.0), rng.exponential(2.0, 1600)]), 3)
    pdf = pd.DataFrame({"k": [f"r{i}" for i in range(len(y))], "y": y})
    return spark.createDataFrame(pdf), y


def test_bins_match_qcut_codes(spark, skewed):
    df, y = skewed
    got = fo.stratified_bins(df, "y").toPandas().set_index("k").loc[[f"r{i}" for i in range(len(y))], "bin"]
    assert (got.to_numpy() == _qcut_codes(y)).all()


def test_fold_balance_and_partition(spark, skewed):
    df, y = skewed
    folded = fo.assign_folds(df, "k", "y").toPandas()
    assert len(folded) == len(y) and folded["k"].is_unique
    for _, g in folded.groupby("bin"):
        c = g["fold"].value_counts().reindex(range(5), fill_value=0)
        assert c.max() - c.min() <= 1
    counts = {r["fold"]: (r["n_train"], r["n_test"]) for r in fo.train_test_counts(fo.assign_folds(df, "k", "y")).collect()}
    assert all(a + b == len(y) for a, b in counts.values())


def test_folds_independent_of_partitioning(spark, skewed):
    df, _ = skewed
    a = fo.assign_folds(df.repartition(1), "k", "y").select("k", "fold").toPandas().sort_values("k")
    b = fo.assign_folds(df.repartition(7), "k", "y").select("k", "fold").toPandas().sort_values("k")
    assert (a["fold"].to_numpy() == b["fold"].to_numpy()).all()


def test_two_stage_rank_equals_global_row_number(spark, skewed):
    df, _ = skewed
    got = fo.dense_index(df, "k", hex_digits=2).toPandas()
    ref = df.select("k", (F.row_number().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(F.md5("k"))) - 1).alias("ref")).toPandas()
    m = got.merge(ref, on="k")
    assert (m["idx"] == m["ref"]).all() and sorted(m["idx"]) == list(range(len(m)))


def test_quantile_edges_dedupe(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "y double")
    ref = np.unique(np.quantile([1.0] * 8 + [2.0, 3.0], np.linspace(0, 1, 6))).tolist()
    assert fo.quantile_edges(df, "y").collect()[0]["edges"] == pytest.approx(ref) and len(ref) == 3


def test_bracket_quantiles_equal_exact(spark, skewed):
    """The bounded-memory bracket path (used above the row threshold) gives
    the same values as numpy's linear percentiles, ties and all."""
    from rugosa.operators import quantiles as qq

    df, y = skewed
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = qq.exact_quantiles(df, ["y"], qs)["y"]
    assert np.allclose(got, np.quantile(y, qs), rtol=0, atol=1e-12)


def test_weighted_quantiles_of_many_columns(spark, monkeypatch):
    """Continuous, tied, constant, infinite and empty columns under several
    weightings, with summaries so small that several rounds are needed."""
    import pandas as pd

    from rugosa.operators import ranks

    monkeypatch.setattr(ranks, "LEAST", 16)
    monkeypatch.setattr(ranks, "MOST", 16)
    rng = np.random.default_rng(6)
    n = 5000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.4, 3.0, rng.random(n)),
                        "c": np.full(n, 7.0), "d": np.full(n, np.nan), "e": np.exp(rng.normal(size=n) * 9),
                        "w": rng.integers(0, 30, n), "u": (rng.random(n) < 0.2).astype(int)})
    pdf.loc[0, "a"], pdf.loc[1, "a"], pdf.loc[::9, "e"] = np.inf, -np.inf, np.nan
    qs = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = ranks.weighted_quantiles(
        spark.createDataFrame(pdf).repartition(6), lambda p: (p[list("abcde")].to_numpy(float), p[["w", "u"]].to_numpy(float)), 5, 2, qs)
    for s, w in enumerate(("w", "u")):
        for j, c in enumerate("abcde"):
            m = pdf[c].notna()
            v = np.sort(np.repeat(pdf[c][m].to_numpy(), pdf[w][m].to_numpy()))
            for k, q in enumerate(qs):
                if not len(v):
                    assert np.isnan(got[s, j, k])
                    continue
                h = (len(v) - 1) * q
                a, b = v[int(h)], v[min(int(h) + 1, len(v) - 1)]
                want = a if h == int(h) or a == b else a + (h - int(h)) * (b - a)
                assert got[s, j, k] == want, (w, c, q)


def test_thinned_summaries_keep_weight_and_largest_value():
    from rugosa.operators.ranks import merge_summaries

    rng = np.random.default_rng(3)
    parts = [np.column_stack([rng.integers(0, 3, 500), rng.normal(size=500).round(2), np.zeros(500), rng.integers(0, 9, (500, 2))]) for _ in range(4)]
    both = merge_summaries([merge_summaries(parts[:2], 20), merge_summaries(parts[2:], 20)], 20)
    rows = np.vstack(parts)
    for k in range(3):
        own, part = rows[rows[:, 0] == k], both[both[:, 0] == k]
        assert len(part) <= 21 and part[-1, 1] == own[:, 1].max() and (np.diff(part[:, 1]) > 0).all()
        assert np.array_equal(part[:, 3:].sum(0), own[:, 3:].sum(0)) and part[:, 2].all()
