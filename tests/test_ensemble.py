"""Blend weight, trial table, ridge stacking with leave-one-out."""

import numpy as np
import pandas as pd
import pytest

from rugosa.operators import ensemble as ens


@pytest.fixture(scope="module")
def oof(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(1, 0.5, 200)
    pdf = pd.DataFrame({"y": y, "pred_svr": y + rng.normal(0.1, 0.3, 200), "pred_gpr": y + rng.normal(-0.05, 0.2, 200)})
    return spark.createDataFrame(pdf), pdf


def test_alpha_equals_grid_search(spark, oof):
    df, pdf = oof
    grid = np.linspace(0, 1, 10001)
    mse = [np.mean((a * pdf.pred_gpr + (1 - a) * pdf.pred_svr - pdf.y) ** 2) for a in grid]
    got = ens.optimal_alpha(ens.blend_stats(df)).collect()[0]
    assert got["alpha"] == pytest.approx(grid[int(np.argmin(mse))], abs=1e-4)
    assert got["mse"] == pytest.approx(min(mse), rel=1e-6)


def test_trials_and_best(spark, oof):
    df, pdf = oof
    trials = ens.ensemble_trials(df, n_trials=80).toPandas()
    assert len(trials) == 80 and trials.alpha.between(0, 1).all()
    a = trials.alpha.to_numpy()
    ref = [np.mean((x * pdf.pred_gpr + (1 - x) * pdf.pred_svr - pdf.y) ** 2) for x in a]
    assert np.allclose(trials.mse, ref, rtol=1e-9)
    best = ens.best_trial(ens.ensemble_trials(df, n_trials=80)).collect()[0]
    assert best["trial_id"] == int(trials.trial_id[np.argmin(ref)])


def _ridge(X, y, a):
    xm, ym = X.mean(0), y.mean()
    c = np.linalg.solve((X - xm).T @ (X - xm) + a * np.eye(2), (X - xm).T @ (y - ym))
    return ym - xm @ c, c


def test_ridge_loo_shortcut(spark, oof):
    df, pdf = oof
    X, y = pdf[["pred_svr", "pred_gpr"]].to_numpy(), pdf.y.to_numpy()
    table = {r["alpha"]: r for r in ens.ridgecv_stacking(df).collect()}
    for a in (0.1, 1.0, 10.0):
        b0, c = _ridge(X, y, a)
        assert table[a]["intercept"] == pytest.approx(b0, rel=1e-9)
        assert [table[a]["coef_svr"], table[a]["coef_gpr"]] == pytest.approx(list(c), rel=1e-9)
        # hat-matrix LOO with the centring of the full fit
        Xc = X - X.mean(0)
        H = np.ones((len(y), len(y))) / len(y) + Xc @ np.linalg.solve(Xc.T @ Xc + a * np.eye(2), Xc.T)
        r = y - (b0 + X @ c)
        assert table[a]["loo_mse"] == pytest.approx(np.mean((r / (1 - np.diag(H))) ** 2), rel=1e-9)
    sel = [r for r in table.values() if r["selected"]]
    assert len(sel) == 1 and sel[0]["loo_mse"] == min(r["loo_mse"] for r in table.values())


def test_stacking_weights_normalised(spark, oof):
    df, _ = oof
    w = ens.stacking_weights(ens.selected_stacker(df)).collect()[0]
    assert w["weight_svr"] + w["weight_gpr"] == pytest.approx(1.0)


def test_nested_stacking_fits_without_the_fold(spark):
    """Each fold's stacker equals the plain one on the rows of the other folds, also
    where a large common part would cancel in raw squares."""
    import numpy as np

    from rugosa.operators import ensemble as en

    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        y = 1e6 + rng.normal()
        rows.append((i, int(i % 4), y, y + 0.3 * rng.normal(), 0.5 * y + 0.2 * rng.normal()))
    df = spark.createDataFrame(rows, "id int, fold int, y double, pred_svr double, pred_gpr double")
    got = {r["fold"]: r for r in en.nested_stackers(df).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for k in range(4):
        want = en.fit_stacker(df.where(f"fold <> {k}"))
        for c in ("alpha", "loo_mse", "coef_svr", "coef_gpr"):
            assert abs(got[k][c] - want[c]) <= 1e-6 * max(1.0, abs(want[c])), (k, c)
    pred = en.stacking_predict_nested(df).collect()
    assert len(pred) == 300
    r = pred[0]
    s = got[r["fold"]]
    assert r["pred_stack"] == s["intercept"] + s["coef_svr"] * r["pred_svr"] + s["coef_gpr"] * r["pred_gpr"]
