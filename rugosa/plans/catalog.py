"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads whole driver tables (``lineitem`` through the ``runs`` view,
or ``events``) and exercises one operator of the library; see
``rugosa/plans/oracle.py`` for the SQL each one is checked against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rugosa.functions import features as feat
from rugosa.functions import scaling as sc
from rugosa.operators import ensemble as ens
from rugosa.operators import folds as fo
from rugosa.operators import importance as imp
from rugosa.operators import metrics as me
from rugosa.operators import plotdata as pdat
from rugosa.operators import preprocess as pp
from rugosa.plans.common import TARGET, events, features, folded, oof, r6, round_all, runs
from rugosa.sources import experiments as ex
from rugosa.session import stored
from rugosa.settings import SETTINGS
from rugosa.sources.tables import continuous_inputs, load_table, run_id_expr

Query = Callable[[SparkSession, str], DataFrame]

# fixed values: the names of the reported models
MODELS4 = ("SVR", "GPR", "Weighted_Ensemble", "Stacking_Ensemble")
YJ_LAMBDAS = (-1.0, 0.0, 0.5, 2.0, 3.0)
YJ_FIT_GRID = (-3.0, 5.0, 33)
# two fixed formulas that stand for models where SQL has to follow; the fitted
# models are in plans/models.py
IMPORTANCE_METHODS = ("Formula (Fz/ap)", "Formula (Fz x ap)")


# --- sources, projections ---------------------------------------------------

def q_scan_runs(spark, sf):
    return runs(spark, sf)


def q_clean_cast(spark, sf):
    li = load_table(spark, sf, "lineitem")
    ln = F.col("l_linenumber").cast("string")
    return li.select(
        run_id_expr().alias("run_id"),
        ex.lenient_double(ln).alias("c_plain"),
        ex.lenient_double(F.col("l_returnflag")).alias("c_text"),
        ex.lenient_double(F.concat(ln, F.lit("d"))).alias("c_suffix"),
        ex.lenient_double(F.concat(F.lit(" "), ln, F.lit(" "))).alias("c_padded"),
        ex.lenient_double(F.concat(ln, F.lit("e1"))).alias("c_sci"),
        ex.lenient_double(F.concat(F.lit("1_"), ln)).alias("c_underscore"),
        ex.lenient_double(F.concat(F.lit("0x"), ln)).alias("c_hex"),
    )


def q_clean_runs(spark, sf):
    r = ex.normalize_columns(runs(spark, sf))
    return ex.clean_numeric(ex.select_required(r, keep=("run_id",)), keep=("run_id",))


def q_dense_index(spark, sf):
    return fo.dense_index(runs(spark, sf).select("run_id"), "run_id")


def _matrix(df, names, rounded_from):
    m = feat.feature_matrix(df, names, target=TARGET)
    cols = [F.col("x")[i].alias(f"x{i:02d}") for i in range(len(names))]
    cols = [r6(c).alias(f"x{i:02d}") if i >= rounded_from else c for i, c in enumerate(cols)]
    return m.select("run_id", *cols, "y")


def q_feature_matrix_15(spark, sf):
    return _matrix(features(spark, sf), feat.FEATURES_15, rounded_from=12)


def q_feature_matrix_12(spark, sf):
    return _matrix(features(spark, sf, guard_eps=None), feat.FEATURES_12, rounded_from=12)


def q_sample_count(spark, sf):
    return runs(spark, sf).agg(F.count(F.lit(1)).alias("n_samples")).select(
        "n_samples", F.lit(len(feat.BASE_INPUTS)).alias("n_features"))


def q_train_test_counts(spark, sf):
    return fo.train_test_counts(folded(spark, sf))


# --- scalar features ----------------------------------------------------------

def _feat_query(cols_fn, rounded=False):
    def q(spark, sf):
        cols = cols_fn()
        out = runs(spark, sf).select("run_id", *[c.alias(n) for n, c in cols.items()])
        return round_all(out) if rounded else out
    return q


def q_engineered_features(spark, sf):
    df = features(spark, sf)
    new = [c for c in feat.FEATURES_15 if c not in feat.BASE_INPUTS]
    return df.select("run_id", *[r6(c).alias(c) if c.startswith("log_") else F.col(c) for c in new])


def q_poly_features_d2(spark, sf):
    return feat.poly_expand(features(spark, sf, guard_eps=None), feat.FEATURES_12, 2, keep=("run_id",))


#: What brings nine inputs of the runs into [0, 1].
POLY_INPUTS = {"Vc": 50.0, "Fz": 0.1, "ap": 0.6, "Vc2": 2500.0, "Fz2": 0.01, "ap2": 0.36, "Vc_Fz": 5.0, "Vc_ap": 30.0, "Fz_ap": 0.06}


def _poly_query(degree):
    def q(spark, sf):
        inputs = [F.col(c) / F.lit(v) for c, v in POLY_INPUTS.items()]
        df = features(spark, sf).select("run_id", feat.poly_degree_sums(inputs, degree).alias("t"))
        return df.select("run_id", "t.n_terms", *[r6(f"t.sum_d{d}").alias(f"sum_d{d}") for d in range(1, degree + 1)])
    return q


def q_fold_robust_stats(spark, sf):
    """F9 as the models use it: median and interquartile range of the 15 inputs in
    every training state, over inputs that no two rows share."""
    f = folded(spark, sf)
    cont = continuous_inputs(f)
    summary = stored(pp.input_summary(cont, TARGET).select(*pp.INPUTS, *[f"n{k}" for k in range(SETTINGS.n_splits)]), "inputs")
    med, iqr = pp.robust_fold_stats(summary, 1)
    rows = [(s, c, float(med[s, j]), float(iqr[s, j])) for s in range(med.shape[0]) for j, c in enumerate(feat.FEATURES_15)]
    return round_all(spark.createDataFrame(rows, "state int, feature string, median double, iqr double"))


def q_stacking_predict_nested(spark, sf):
    out = ens.stacking_predict_nested(oof(spark, sf))
    return out.select("run_id", "fold", "y", r6("alpha").alias("alpha"), r6("pred_stack").alias("pred_stack"))


def q_robust_scale(spark, sf):
    df = features(spark, sf).select("run_id", *feat.FEATURES_15)
    return round_all(sc.robust_scale(df, feat.FEATURES_15))


def q_yeo_johnson_apply(spark, sf):
    ev = events(spark, sf).select("event_id", (F.col("value") - F.lit(50.0)).alias("v"))
    names = {-1.0: "yj_m1", 0.0: "yj_0", 0.5: "yj_0p5", 2.0: "yj_2", 3.0: "yj_3"}
    return ev.select("event_id", "v", *[r6(sc.yeo_johnson(F.col("v"), lam)).alias(names[lam]) for lam in YJ_LAMBDAS])


def _yj_grid():
    lo, hi, n = YJ_FIT_GRID
    return sc.yj_grid(lo, hi, n)


def q_yeo_johnson_fit(spark, sf):
    table = sc.yj_fit_table(events(spark, sf), "value", _yj_grid())
    best = sc.yj_best(table).select("lambda").scalar()
    return table.select(r6("lambda").alias("lambda"), (F.round(F.col("loglik") * F.lit(1e4), 0) / F.lit(1e4)).alias("loglik"),
                        (F.col("lambda") == best).alias("best"))


def q_standardize(spark, sf):
    cols = ["Vc", "Fz", "ap", TARGET]
    return round_all(sc.standardize(runs(spark, sf).select("run_id", *cols), cols))


def q_target_roundtrip(spark, sf):
    r = runs(spark, sf).select("run_id", F.col(TARGET).alias("y"))
    lam = sc.yj_best(sc.yj_fit_table(r, "y", _yj_grid())).select("lambda").scalar()
    t = r.withColumn("lam", lam).withColumn("t0", sc.yeo_johnson(F.col("y"), F.col("lam")))
    st = sc.bind_params(t, sc.standard_stats(t, ["t0"]))
    out = st.withColumn("t", (F.col("t0") - F.col("_p.t0_mean")) / F.col("_p.t0_sd"))
    back = sc.yeo_johnson_inverse(F.col("t") * F.col("_p.t0_sd") + F.col("_p.t0_mean"), F.col("lam"))
    return out.select("run_id", "y", r6("lam").alias("lambda"), r6("t").alias("t"), r6(back).alias("back"))


def q_target_normalize(spark, sf):
    r = runs(spark, sf).select("run_id", F.col(TARGET).alias("y"))
    st = sc.bind_params(r, sc.standard_stats(r, ["y"]))
    z = (F.col("y") - F.col("_p.y_mean")) / F.col("_p.y_sd")
    return st.select("run_id", "y", r6(z).alias("z"), r6(z * F.col("_p.y_sd") + F.col("_p.y_mean")).alias("back"))


# --- folds, ranks -----------------------------------------------------------------

def q_quantile_edges(spark, sf):
    e = fo.quantile_edges(runs(spark, sf), TARGET)
    return e.select(F.posexplode("edges").alias("edge_idx", "edge")).select(
        F.col("edge_idx").cast("int").alias("edge_idx"), r6("edge").alias("edge"))


def q_stratified_bins(spark, sf):
    return fo.stratified_bins(runs(spark, sf).select("run_id", TARGET), TARGET)


def q_stratified_kfold(spark, sf):
    return folded(spark, sf).select("run_id", "bin", "fold")


def q_seeded_shuffle(spark, sf):
    return fo.seeded_shuffle(runs(spark, sf).select("run_id"), "run_id")


def q_permute_column(spark, sf):
    return imp.permute_column(runs(spark, sf).select("run_id", "Vc"), "run_id", "Vc", repeat=0)


# --- out-of-fold table, metrics, blending, stacking -------------------------------

def _oof_full(spark, sf):
    o = ens.with_optimal_blend(oof(spark, sf))
    stacker = ens.selected_stacker(o)
    return ens.stacking_predict(o, stacker)


def q_oof_union(spark, sf):
    return round_all(oof(spark, sf), skip=("y",))


def q_meta_matrix(spark, sf):
    return round_all(oof(spark, sf).select("run_id", "y", "pred_svr", "pred_gpr"), skip=("y",))


def q_weighted_ensemble(spark, sf):
    o = ens.with_optimal_blend(oof(spark, sf))
    return round_all(o.select("run_id", "fold", "y", "pred_svr", "pred_gpr", "alpha", "pred_ens"), skip=("y",))


def q_metrics_report(spark, sf):
    o = _oof_full(spark, sf)
    rep = me.metrics_report(o, "y", dict(zip(MODELS4, ["pred_svr", "pred_gpr", "pred_ens", "pred_stack"])))
    return round_all(rep)


def q_pooled_oof_mse(spark, sf):
    return round_all(me.pooled_oof_mse(oof(spark, sf), "y", {"SVR": "pred_svr", "GPR": "pred_gpr"}))


def q_ensemble_alpha(spark, sf):
    return round_all(ens.optimal_alpha(ens.blend_stats(oof(spark, sf))))


def q_ensemble_trials(spark, sf):
    return round_all(ens.ensemble_trials(oof(spark, sf)), skip=("alpha",))


def q_best_trial(spark, sf):
    return round_all(ens.best_trial(ens.ensemble_trials(oof(spark, sf))), skip=("alpha",))


def q_ridgecv_stacking(spark, sf):
    return round_all(ens.ridgecv_stacking(oof(spark, sf)))


def q_stacking_predict(spark, sf):
    o = oof(spark, sf)
    return round_all(ens.stacking_predict(o, ens.selected_stacker(o)).select("run_id", "y", "pred_stack"), skip=("y",))


def q_stacking_weights(spark, sf):
    return round_all(ens.stacking_weights(ens.selected_stacker(oof(spark, sf))))


# --- importance -----------------------------------------------------------------------

def _scorer_svr(c):
    return F.lit(0.2) + F.lit(0.02) * c["Vc"] + F.lit(3.0) * c["Fz_ap"] + F.lit(0.15) * F.sin(c["Vc"] / F.lit(8.0))


def _scorer_gpr(c):
    return F.lit(0.2) + F.lit(0.02) * c["Vc"] + F.lit(3.0) * c["Fz"] * c["ap"]


SCORERS = {IMPORTANCE_METHODS[0]: _scorer_svr, IMPORTANCE_METHODS[1]: _scorer_gpr}


def _perm_importance(spark, sf):
    df = features(spark, sf, guard_eps=None)
    return imp.permutation_importance(df, "run_id", feat.FEATURES_12, TARGET, SCORERS, carry=feat.BASE_INPUTS,
                                      derive=lambda d: feat.add_engineered_features(d, None))


def q_permutation_importance(spark, sf):
    return round_all(_perm_importance(spark, sf))


def _grouped(spark, sf, literal=False):
    mapping = (imp.literal_mapping if literal else imp.lineage_mapping)(feat.FEATURES_12)
    return imp.group_importance(_perm_importance(spark, sf), mapping)


def q_importance_grouped(spark, sf):
    return round_all(_grouped(spark, sf))


def q_importance_grouped_literal(spark, sf):
    return round_all(_grouped(spark, sf, literal=True))


def q_importance_group_std(spark, sf):
    return round_all(_grouped(spark, sf).select("method", "variable", "std"))


def q_importance_normalize(spark, sf):
    return round_all(imp.normalize_importance(_grouped(spark, sf)).select("method", "variable", "importance"))


def q_importance_table(spark, sf):
    norm = imp.normalize_importance(_grouped(spark, sf))
    return round_all(imp.importance_table(norm, IMPORTANCE_METHODS))


def q_sensitivity_mean(spark, sf):
    return round_all(imp.sensitivity_mean(imp.normalize_importance(_grouped(spark, sf))))


# --- plot data --------------------------------------------------------------------------

def q_target_histogram(spark, sf):
    return round_all(pdat.histogram(runs(spark, sf), TARGET))


def q_scatter_by_param(spark, sf):
    return pdat.scatter_by_param(runs(spark, sf), "run_id", feat.BASE_INPUTS, TARGET)


def q_scatter_binned(spark, sf):
    return pdat.scatter_binned(runs(spark, sf), feat.BASE_INPUTS, TARGET, n_bins=20)


def q_actual_vs_predicted(spark, sf):
    o = ens.with_optimal_blend(oof(spark, sf))
    avp = pdat.actual_vs_predicted(o, "run_id", "y", {"SVR": "pred_svr", "GPR": "pred_gpr", "ENSEMBLE": "pred_ens"})
    return round_all(avp, skip=("actual",))


def q_actual_vs_predicted_bounds(spark, sf):
    return pdat.bounds(oof(spark, sf), "y")


def q_model_comparison_series(spark, sf):
    o = ens.with_optimal_blend(oof(spark, sf))
    s = pdat.model_comparison_series(o, "run_id", "y", {"SVR": "pred_svr", "GPR": "pred_gpr", "Ensemble": "pred_ens"})
    return round_all(s, skip=("actual",))


SQL_CHECKED: dict[str, Query] = {
    "scan_runs": q_scan_runs,
    "clean_cast": q_clean_cast,
    "clean_runs": q_clean_runs,
    "dense_index": q_dense_index,
    "feature_matrix_15": q_feature_matrix_15,
    "feature_matrix_12": q_feature_matrix_12,
    "sample_count": q_sample_count,
    "train_test_counts": q_train_test_counts,
    "feat_squares": _feat_query(feat.square_features),
    "feat_interactions": _feat_query(feat.interaction_features),
    "feat_ratios": _feat_query(lambda: feat.ratio_features(1e-9)),
    "feat_ratios_raw": _feat_query(lambda: feat.ratio_features(None)),
    "feat_logs": _feat_query(lambda: feat.log_features(1e-9), rounded=True),
    "feat_logs_raw": _feat_query(lambda: feat.log_features(None), rounded=True),
    "engineered_features": q_engineered_features,
    "poly_features_d2": q_poly_features_d2,
    "poly_features_d3": _poly_query(3),
    "poly_features_d4": _poly_query(4),
    "robust_scale": q_robust_scale,
    "fold_robust_stats": q_fold_robust_stats,
    "yeo_johnson_apply": q_yeo_johnson_apply,
    "yeo_johnson_fit": q_yeo_johnson_fit,
    "standardize": q_standardize,
    "target_roundtrip": q_target_roundtrip,
    "target_normalize": q_target_normalize,
    "quantile_edges": q_quantile_edges,
    "stratified_bins": q_stratified_bins,
    "stratified_kfold": q_stratified_kfold,
    "seeded_shuffle": q_seeded_shuffle,
    "permute_column": q_permute_column,
    "oof_union": q_oof_union,
    "meta_matrix": q_meta_matrix,
    "weighted_ensemble": q_weighted_ensemble,
    "metrics_report": q_metrics_report,
    "pooled_oof_mse": q_pooled_oof_mse,
    "ensemble_alpha": q_ensemble_alpha,
    "ensemble_trials": q_ensemble_trials,
    "best_trial": q_best_trial,
    "ridgecv_stacking": q_ridgecv_stacking,
    "stacking_predict": q_stacking_predict,
    "stacking_predict_nested": q_stacking_predict_nested,
    "stacking_weights": q_stacking_weights,
    "permutation_importance": q_permutation_importance,
    "importance_grouped": q_importance_grouped,
    "importance_grouped_literal": q_importance_grouped_literal,
    "importance_group_std": q_importance_group_std,
    "importance_normalize": q_importance_normalize,
    "importance_table": q_importance_table,
    "sensitivity_mean": q_sensitivity_mean,
    "target_histogram": q_target_histogram,
    "scatter_by_param": q_scatter_by_param,
    "scatter_binned": q_scatter_binned,
    "actual_vs_predicted": q_actual_vs_predicted,
    "actual_vs_predicted_bounds": q_actual_vs_predicted_bounds,
    "model_comparison_series": q_model_comparison_series,
}
