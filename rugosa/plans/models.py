"""Registered model queries (no SQL oracle; checked against numpy in tests).

Every query fits on the whole ``runs`` table of the given scale. Fitted
parameters (D x D-sized) are memoised per (scale, fit) on the driver so that
queries of one session share a fit; the row tables are always re-derived by
Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rugosa.operators import ensemble as ens
from rugosa.operators import kernels as kk
from rugosa.operators import metrics as me
from rugosa.operators import preprocess as pp
from rugosa.operators import tuning as tu
from rugosa.plans.common import TARGET, folded, round_all
from rugosa.session import materialize, stored
from rugosa.settings import SETTINGS

_MEMO: dict = {}
ALL = SETTINGS.n_splits  # index of the all-rows state


def _memo(key, fn):
    """Fits of this application alone: a new session starts anew."""
    spark = SparkSession.getActiveSession()
    key = (spark.sparkContext.applicationId if spark else None, key)
    if key not in _MEMO:
        _MEMO[key] = fn()
    return _MEMO[key]


def _base(spark: SparkSession, sf: str):
    def build():
        f = folded(spark, sf)
        return f, materialize(pp.input_summary(f, TARGET), checkpoint=True)
    return _memo((sf, "base"), build)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows for the model passes, kept for a query that scores them, too."""
    return _memo((sf, "rows"), lambda: materialize(kk.with_fold_rows(_base(spark, sf)[0], TARGET)))


def _prep(spark, sf, degree):
    return _memo((sf, "prep", degree), lambda: pp.fit_prep(_base(spark, sf)[1], degree))


def _target_prep(spark, sf):
    return _memo((sf, "tprep"), lambda: pp.fit_target_prep(_base(spark, sf)[0], TARGET))


def default_gp(spark: SparkSession, sf: str) -> kk.GPModel:
    return _memo((sf, "gp"), lambda: kk.fit_gp(_base(spark, sf)[1], _prep(spark, sf, SETTINGS.poly_degree),
                                                 [kk.GPSpec(**SETTINGS.gpr_defaults)]))


def default_svr(spark: SparkSession, sf: str) -> kk.SVRModel:
    def build():
        spec = kk.SVRSpec(**SETTINGS.svr_defaults)
        # the fit alone reads them once, and no keys
        kept = _MEMO.get((spark.sparkContext.applicationId, (sf, "rows")))
        rows = kk.with_fold_rows(_base(spark, sf)[0], TARGET) if kept is None else kept
        return kk.fit_svr(rows, {spec.poly_degree: _prep(spark, sf, spec.poly_degree)},
                          _target_prep(spark, sf), [spec], states=range(SETTINGS.n_splits + 1))
    return _memo((sf, "svr"), build)


def _oof(spark, sf) -> DataFrame:
    return kk.score_rows(_rows(spark, sf), default_svr(spark, sf), default_gp(spark, sf))


# --- queries ---------------------------------------------------------------------

def q_svr_fit(spark, sf):
    m = default_svr(spark, sf)
    rows = []
    for i, (t, s) in enumerate(m.problems):
        sp = m.specs[t]
        rows.append((s, sp.C, sp.epsilon, m.gamma(t, s), sp.poly_degree, float(m.objective[i]), m.iterations,
                     float(m.gap[i]), float(m.target.lam[s]), float(m.target.mean[s]), float(m.target.sd[s])))
    schema = ("state int, C double, epsilon double, gamma double, poly_degree int, objective double, "
              "iterations int, relative_gap double, target_lambda double, target_mean double, target_sd double")
    return spark.createDataFrame(rows, schema)


def q_svr_predict(spark, sf):
    return kk.score_rows(_rows(spark, sf), default_svr(spark, sf), None).select("run_id", "fold", "y", "pred_svr")


def q_gpr_fit(spark, sf):
    m = default_gp(spark, sf)
    rows = [(int(s), *[float(v) for v in (st.spec.length_scale, st.amplitude, st.spec.alpha, st.noise,
                                            st.y_mean, st.y_std, st.n, st.lml)])
            for (t, s), st in sorted(m.states.items())]
    schema = ("state int, length_scale double, amplitude double, alpha double, noise double, y_mean double, "
              "y_std double, n_train double, log_marginal_likelihood double")
    return spark.createDataFrame(rows, schema)


def q_gpr_marginal_likelihood(spark, sf):
    m = default_gp(spark, sf)
    chosen = {s: st.lml for (t, s), st in m.states.items()}
    rows = [(int(c["state"]), float(c["length_scale"]), float(c["alpha"]), float(c["amplitude"]), float(c["noise"]),
             float(c["lml"]), chosen[c["state"]] == c["lml"]) for c in m.candidates]
    return spark.createDataFrame(rows, "state int, length_scale double, alpha double, amplitude double, noise double, "
                                       "lml double, selected boolean")


def q_gpr_predict(spark, sf):
    return kk.score_rows(_rows(spark, sf), None, default_gp(spark, sf)).select("run_id", "fold", "y", "pred_gpr")


def q_gpr_predict_std(spark, sf):
    return kk.score_rows(_rows(spark, sf), None, default_gp(spark, sf)).select(
        "run_id", "fold", "pred_gpr", "std_gpr")


def q_oof_predictions(spark, sf):
    return _oof(spark, sf)


def q_final_refit(spark, sf):
    return kk.score_rows(_rows(spark, sf), default_svr(spark, sf), default_gp(spark, sf), state=ALL).select(
        "run_id", "y", "pred_svr", "pred_gpr")


def q_model_metrics_report(spark, sf):
    o = stored(_oof(spark, sf), "model-oof")
    o = ens.with_optimal_blend(o)
    o = ens.stacking_predict(o, ens.fit_stacker(o))
    return me.metrics_report(o, "y", {"SVR": "pred_svr", "GPR": "pred_gpr",
                                      "Weighted_Ensemble": "pred_ens", "Stacking_Ensemble": "pred_stack"})


def q_model_stacking(spark, sf):
    o = stored(_oof(spark, sf), "model-oof")
    return ens.ridgecv_stacking(o)


def q_tune_svr(spark, sf):
    return _memo((sf, "tune_svr"), lambda: tu.tune_svr(_base(spark, sf)[0], TARGET))[0]


def q_tune_gpr(spark, sf):
    return _memo((sf, "tune_gpr"), lambda: tu.tune_gpr(_base(spark, sf)[0], TARGET))[0]


def q_gpr_sensitivity(spark, sf):
    rows, _ = _memo((sf, "gp_sens"), lambda: kk.gp_sensitivity(_base(spark, sf)[1]))
    return spark.createDataFrame([tuple(r.values()) for r in rows],
                                 "variable string, length_scale double, inv_length_scale double, "
                                 "importance double, lml double")


def q_svr_permutation_importance(spark, sf):
    """I1/I2 with the fitted all-rows SVR over the 15 model inputs, then I4
    lineage grouping and I3 normalisation (the monolith's flow)."""
    from rugosa.functions.features import FEATURES_15
    from rugosa.operators import importance as imp
    from rugosa.plans.common import runs

    svr = default_svr(spark, sf)
    d = svr.specs[0].poly_degree

    def predict(eng):
        return kk.svr_predict_np(svr, 0, ALL, eng, {d: pp.poly_np(eng, d)})

    df = runs(spark, sf).select("run_id", *pp.INPUTS, TARGET)
    raw = imp.model_permutation_importance(
        df, "run_id", FEATURES_15, TARGET, predict, "SVR (Permutation)", carry=pp.INPUTS, derive=pp.engineered_np,
        swapped=lambda eng: kk.svr_swapped_np(svr, 0, ALL, eng))
    grouped = imp.group_importance(raw, imp.lineage_mapping(FEATURES_15))
    return imp.normalize_importance(grouped)


def q_model_importance_table(spark, sf):
    """I7, A14 from the fitted models: permutation importance of the SVR beside
    the inverse length scales of the GP, and their mean, per variable."""
    from rugosa.operators import importance as imp

    svr = q_svr_permutation_importance(spark, sf).select("method", "variable", "importance")
    gp = q_gpr_sensitivity(spark, sf).select(F.lit("GPR (1/LengthScale)").alias("method"), "variable", "importance")
    both = materialize(svr.unionByName(gp))   # a few rows, read twice
    table = imp.importance_table(both, ["SVR (Permutation)", "GPR (1/LengthScale)"])
    return table.join(imp.sensitivity_mean(both), "variable")


MODEL_QUERIES = {
    "svr_fit": q_svr_fit,
    "svr_predict": q_svr_predict,
    "gpr_fit": q_gpr_fit,
    "gpr_predict": q_gpr_predict,
    "gpr_predict_std": q_gpr_predict_std,
    "gpr_marginal_likelihood": q_gpr_marginal_likelihood,
    "final_refit": q_final_refit,
    "oof_predictions": q_oof_predictions,
    "model_metrics_report": q_model_metrics_report,
    "model_stacking": q_model_stacking,
    "tune_gpr": q_tune_gpr,
    "tune_svr": q_tune_svr,
    "gpr_sensitivity": q_gpr_sensitivity,
    "svr_permutation_importance": q_svr_permutation_importance,
    "model_importance_table": q_model_importance_table,
}
