"""The out-of-fold table at scale: what its tables hold and how they are joined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rugosa.operators import preprocess as pp
from rugosa.operators import scorers as sco

COLS = "run_id string, Vc double, Fz double, ap double, t double, fold int"


def _rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    out = [(f"r{i}", float(rng.integers(1, 6)), float(rng.integers(0, 4)) / 100, 0.5 + float(rng.integers(0, 3)) / 100,
            round(float(rng.normal()), 6), int(rng.integers(0, 5))) for i in range(n)]
    return out + [("n1", None, 0.01, 0.5, 0.25, 1), ("n2", 3.0, None, 0.5, 0.5, 2), ("n3", 3.0, 0.02, 0.51, None, 0), out[0]]


def _expected(rows):
    """Group means over the other folds, row by row; a missing group drops the row."""
    first = {}
    for r in rows:
        if r[1] is not None:
            first.setdefault("kept", []).append(r)
    got = []
    for r in first["kept"]:
        if r[2] is None or r[3] is None:
            continue
        preds = []
        for key, pool in ((lambda x: x[1], rows), (lambda x: (x[2], x[3]), first["kept"])):
            rest = [x for x in pool if x[5] != r[5]]
            same = [x for x in rest if key(x) == key(r)]
            use = same or rest
            vals = [round(x[4] * 1e6) for x in use if x[4] is not None]
            preds.append(sum(vals) / len(use) / 1e6)
        got.append((r[0], r[5], r[4], *preds))
    return got


@pytest.mark.parametrize("few", [True, False])
def test_scorers_equal_row_by_row_means(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(sco, "BROADCAST_GROUPS", 0)
    rows = _rows()
    got = sco.oof_base_predictions(spark.createDataFrame(rows, COLS), "t", decimals=6).collect()
    key = lambda r: (r[0], r[1], str(r[2]))
    got, want = sorted(map(tuple, got), key=key), sorted(_expected(rows), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    np.testing.assert_allclose([r[3:] for r in got], [r[3:] for r in want], rtol=0, atol=1e-12)


def test_rows_are_not_shuffled_for_few_groups(spark):
    df = spark.createDataFrame(_rows(), COLS)
    plan = sco.oof_base_predictions(df, "t", decimals=6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_folded_and_oof_tables_are_read_by_column(spark):
    from rugosa.plans.common import folded, oof

    sf = "/root/testdata/sf0.001"
    f, o = folded(spark, sf), oof(spark, sf)
    plan = o.agg(F.avg("pred_svr"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<pred_svr:double>" in plan
    assert f.count() == o.count() == 0 + spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_target_values_are_transformed_once_for_states_that_share_a_grid(spark, monkeypatch):
    rows = [(float(v), i % 5) for i, v in enumerate(np.random.default_rng(1).gamma(2.0, size=300))]
    df = spark.createDataFrame(rows, "t double, fold int")
    cells = []
    real = pp.yj_np

    def counted(x, lam, *rest):
        cells.append(np.broadcast(np.asarray(x), np.asarray(lam)).size)
        return real(x, lam, *rest)

    def local(frame, fn, *a, **k):
        monkeypatch.setattr(pp, "yj_np", counted)
        return fn(frame.toPandas())

    monkeypatch.setattr(pp, "partial_sums", local)
    got = pp.fit_target_prep(df, "t")
    assert cells[0] == 300 * 33 and cells[2] < 6 * 300 * 17
    y, fold = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for s in range(6):
        t = real(y[fold != s], np.array(got.lam[s]))
        assert abs(t.mean() - got.mean[s]) < 1e-9 and abs(t.std() - got.sd[s]) < 1e-9


def test_large_parts_of_one_interval_are_thinned_before_they_are_held(spark):
    from rugosa.operators.quantiles import exact_quantiles

    df = spark.range(60_000, numPartitions=2).select(F.expr("cast((id * 7919) % 60000 as double)").alias("v"))
    got = exact_quantiles(df, ["v"], [0.0, 0.2, 0.5, 1.0])["v"]
    np.testing.assert_allclose(got, np.quantile(np.arange(60_000.0), [0.0, 0.2, 0.5, 1.0]))


def test_fold_quantiles_read_inputs_and_counts_only(spark, monkeypatch):
    from rugosa.operators import ranks

    seen = []
    monkeypatch.setattr(ranks, "weighted_quantiles", lambda df, *rest: seen.extend(df.columns) or np.zeros((6, 15, 3)))
    names = [*pp.INPUTS, "y0", *[f"{c}{k}" for k in range(5) for c in ("n", "sy", "syy")]]
    pp.robust_fold_stats(spark.range(1).select(*[F.lit(1.0).alias(c) for c in names]), 1)
    assert seen == [*pp.INPUTS, "n0", "n1", "n2", "n3", "n4"]
