"""Blending and stacking of out-of-fold predictions.

* Blend weight: the MSE of ``a*g + (1-a)*s`` is the quadratic
  ``(A - 2aB + a^2 C)/n`` in three sums, so the optimum over [0, 1] is
  ``clip(B/C, 0, 1)`` from one aggregate, and any trial table of weights is
  scored without touching the rows again.
* Stacking: ridge on the two prediction columns with an unpenalised
  intercept; every candidate penalty is scored by its exact leave-one-out
  error ``r / (1 - h)`` from centred 2x2 sufficient statistics -- one
  aggregate for the statistics, one for the LOO errors of all candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rugosa.functions.scaling import bind_params
from rugosa.settings import SETTINGS
from rugosa.sources.tables import md5_unit


# --------------------------------------------------------------------------
# blend weight (T4) and the weighted ensemble
# --------------------------------------------------------------------------

def blend_stats(oof: DataFrame, y: str = "y", s: str = "pred_svr", g: str = "pred_gpr") -> DataFrame:
    ys, gs = F.col(y) - F.col(s), F.col(g) - F.col(s)
    return oof.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ys * ys).alias("A"),
        F.sum(ys * gs).alias("B"),
        F.sum(gs * gs).alias("C"),
    )


def optimal_alpha(stats: DataFrame) -> DataFrame:
    """T4 exact: ``alpha`` (weight of the GP column) and its MSE."""
    a = F.when(F.col("C") == F.lit(0.0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("B") / F.col("C"))))
    return stats.select(a.alias("alpha"), "A", "B", "C", "n").select(
        "alpha",
        ((F.col("A") - F.lit(2.0) * F.col("alpha") * F.col("B")
          + F.col("alpha") * F.col("alpha") * F.col("C")) / F.col("n")).alias("mse"),
    )


def trial_uniform(seed: int, stream: str, trial: Column, param: str) -> Column:
    """Seeded uniform in [0, 1] for (stream, trial, param), md5-based."""
    return md5_unit(F.concat(F.lit(f"{seed}:{stream}:"), trial.cast("string"), F.lit(f":{param}")))


def ensemble_trials(oof: DataFrame, n_trials: int = SETTINGS.ensemble_trials,
                    seed: int = SETTINGS.seed, y: str = "y", s: str = "pred_svr",
                    g: str = "pred_gpr") -> DataFrame:
    """T4 as a trial table: ``(trial_id, alpha, mse)`` for ``n_trials``
    seeded weights, all scored from the same three sums."""
    spark = oof.sparkSession
    trials = spark.range(n_trials).withColumnRenamed("id", "trial_id")
    trials = trials.withColumn("alpha", trial_uniform(seed, "ensemble", F.col("trial_id"), "alpha"))
    bound = bind_params(trials, blend_stats(oof, y, s, g))
    a = F.col("alpha")
    mse = (F.col("_p.A") - F.lit(2.0) * a * F.col("_p.B") + a * a * F.col("_p.C")) / F.col("_p.n")
    return bound.select(F.col("trial_id").cast("int").alias("trial_id"), "alpha", mse.alias("mse"))


def best_trial(trials: DataFrame, score: str = "mse", trial_id: str = "trial_id") -> DataFrame:
    """K1: the trial with the lowest score, ties to the lowest id; returns
    the whole winning row."""
    cols = trials.columns
    return trials.agg(
        F.min_by(F.struct(*cols), F.struct(F.col(score), F.col(trial_id))).alias("b")
    ).select("b.*")


def weighted_blend(oof: DataFrame, alpha: Column | float, s: str = "pred_svr", g: str = "pred_gpr",
                   out: str = "pred_ens") -> DataFrame:
    """``alpha * g + (1 - alpha) * s``."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return oof.withColumn(out, a * F.col(g) + (F.lit(1.0) - a) * F.col(s))


def with_optimal_blend(oof: DataFrame, y: str = "y", s: str = "pred_svr", g: str = "pred_gpr",
                       out: str = "pred_ens") -> DataFrame:
    """P9 with the exact optimal weight (one aggregate; the weight reaches the
    driver as a single float) bound as column ``alpha``."""
    alpha = float(optimal_alpha(blend_stats(oof, y, s, g)).first()["alpha"])
    return weighted_blend(oof.withColumn("alpha", F.lit(alpha)), F.col("alpha"), s, g, out)


# --------------------------------------------------------------------------
# stacking (E1-E3, K2)
# --------------------------------------------------------------------------

def ridge_stats(oof: DataFrame, y: str = "y", s: str = "pred_svr", g: str = "pred_gpr") -> DataFrame:
    n = F.count(F.lit(1)).cast("double")
    return oof.agg(
        n.alias("n"),
        F.avg(s).alias("ms"), F.avg(g).alias("mg"), F.avg(y).alias("my"),
        (n * F.var_pop(s)).alias("Sss"), (n * F.var_pop(g)).alias("Sgg"),
        (n * F.covar_pop(s, g)).alias("Ssg"),
        (n * F.covar_pop(s, y)).alias("Ssy"), (n * F.covar_pop(g, y)).alias("Sgy"),
    )


def _ridge_solution(st, alpha: float) -> dict[str, float]:
    """Closed-form 2x2 ridge with an unpenalised intercept (driver floats)."""
    a = float(alpha)
    det = (st["Sss"] + a) * (st["Sgg"] + a) - st["Ssg"] * st["Ssg"]
    i11 = (st["Sgg"] + a) / det
    i22 = (st["Sss"] + a) / det
    i12 = -st["Ssg"] / det
    c1 = i11 * st["Ssy"] + i12 * st["Sgy"]
    c2 = i12 * st["Ssy"] + i22 * st["Sgy"]
    b0 = st["my"] - c1 * st["ms"] - c2 * st["mg"]
    return {"i11": i11, "i22": i22, "i12": i12, "c1": c1, "c2": c2, "b0": b0}


def ridgecv_stacking(oof: DataFrame, alphas: Sequence[float] = SETTINGS.ridge_alphas,
                     y: str = "y", s: str = "pred_svr", g: str = "pred_gpr") -> DataFrame:
    """One row per candidate penalty ``(alpha, loo_mse, intercept,
    coef_svr, coef_gpr, selected)``; the selected one has the lowest LOO MSE
    (ties -> first candidate). Two scans: the centred sufficient statistics
    (9 numbers, collected), then the LOO errors of every candidate at once."""
    st = ridge_stats(oof, y, s, g).first().asDict()
    sols = [_ridge_solution(st, a) for a in alphas]
    aggs = []
    zs, zg = F.col(s) - F.lit(st["ms"]), F.col(g) - F.lit(st["mg"])
    for i, r in enumerate(sols):
        h = (F.lit(1.0 / st["n"]) + F.lit(r["i11"]) * zs * zs
             + F.lit(2.0 * r["i12"]) * zs * zg + F.lit(r["i22"]) * zg * zg)
        res = F.col(y) - (F.lit(r["b0"]) + F.lit(r["c1"]) * F.col(s) + F.lit(r["c2"]) * F.col(g))
        e = res / (F.lit(1.0) - h)
        aggs.append(F.avg(e * e).alias(f"loo{i}"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(float(a)).alias("alpha"), F.col(f"loo{i}").alias("loo_mse"),
                 F.lit(r["b0"]).alias("intercept"), F.lit(r["c1"]).alias("coef_svr"),
                 F.lit(r["c2"]).alias("coef_gpr"))
        for i, (a, r) in enumerate(zip(alphas, sols))
    ])
    table = oof.agg(*aggs).select(F.inline(rows))
    # the candidate table has len(alphas) rows: a global window over it is bounded
    best = F.min(F.struct("loo_mse", "idx")).over(Window.partitionBy())
    return table.withColumn("_best", best).select(
        "alpha", "loo_mse", "intercept", "coef_svr", "coef_gpr",
        (F.col("idx") == F.col("_best.idx")).alias("selected"),
    )


def selected_stacker(oof: DataFrame, **kw) -> DataFrame:
    return ridgecv_stacking(oof, **kw).filter("selected").drop("selected")


def fit_stacker(oof: DataFrame, **kw) -> dict[str, float]:
    """The selected stacker as driver floats (one row, parameter-sized)."""
    return selected_stacker(oof, **kw).first().asDict()


def stacking_predict(oof: DataFrame, stacker: DataFrame | dict, s: str = "pred_svr", g: str = "pred_gpr",
                     out: str = "pred_stack") -> DataFrame:
    """Apply the selected stacker to the same rows (in-sample, as the
    reference does)."""
    p = stacker if isinstance(stacker, dict) else stacker.first().asDict()
    return oof.withColumn(
        out, F.lit(p["intercept"]) + F.lit(p["coef_svr"]) * F.col(s) + F.lit(p["coef_gpr"]) * F.col(g))


def _merged(parts: Sequence[dict]) -> dict[str, float]:
    """Centred statistics (:func:`ridge_stats`) of the union of disjoint parts: sums of
    products are carried from one mean to the other, never taken as differences of
    raw squares."""
    out = dict.fromkeys(("n", "ms", "mg", "my", "Sss", "Sgg", "Ssg", "Ssy", "Sgy"), 0.0)
    for p in parts:
        n = out["n"] + p["n"]
        w = out["n"] * p["n"] / n
        d = {m: p[f"m{m}"] - out[f"m{m}"] for m in "sgy"}
        for a, b in ("ss", "gg", "sg", "sy", "gy"):
            out[f"S{a}{b}"] += p[f"S{a}{b}"] + w * d[a] * d[b]
        for m in "sgy":
            out[f"m{m}"] += d[m] * p["n"] / n
        out["n"] = n
    return out


def nested_stackers(oof: DataFrame, alphas: Sequence[float] = SETTINGS.ridge_alphas, fold: str = "fold",
                    y: str = "y", s: str = "pred_svr", g: str = "pred_gpr") -> DataFrame:
    """E1 for every fold, fitted on the other folds: ``(fold, alpha, loo_mse, intercept,
    coef_svr, coef_gpr)`` of the penalty with the lowest leave-one-out error there.
    Two scans, however many folds: the statistics of each fold, merged into those of
    its complement on the driver, then the errors of all (fold, penalty) pairs."""
    n = F.count(F.lit(1)).cast("double")
    per_fold = {r[fold]: r.asDict() for r in oof.groupBy(fold).agg(
        n.alias("n"), F.avg(s).alias("ms"), F.avg(g).alias("mg"), F.avg(y).alias("my"),
        (n * F.var_pop(s)).alias("Sss"), (n * F.var_pop(g)).alias("Sgg"), (n * F.covar_pop(s, g)).alias("Ssg"),
        (n * F.covar_pop(s, y)).alias("Ssy"), (n * F.covar_pop(g, y)).alias("Sgy")).collect()}
    folds = sorted(per_fold)
    if len(folds) < 2:
        raise ValueError("nested stacking needs two folds at least")
    stats = {k: _merged([per_fold[f] for f in folds if f != k]) for k in folds}
    sols = {(k, i): _ridge_solution(stats[k], a) for k in folds for i, a in enumerate(alphas)}
    aggs = []
    for (k, i), r in sols.items():
        zs, zg = F.col(s) - F.lit(stats[k]["ms"]), F.col(g) - F.lit(stats[k]["mg"])
        h = (F.lit(1.0 / stats[k]["n"]) + F.lit(r["i11"]) * zs * zs
             + F.lit(2.0 * r["i12"]) * zs * zg + F.lit(r["i22"]) * zg * zg)
        e = (F.col(y) - (F.lit(r["b0"]) + F.lit(r["c1"]) * F.col(s) + F.lit(r["c2"]) * F.col(g))) / (F.lit(1.0) - h)
        aggs.append(F.avg(F.when(F.col(fold) != F.lit(k), e * e)).alias(f"e{folds.index(k)}_{i}"))
    loo = oof.agg(*aggs).first()
    rows = []
    for j, k in enumerate(folds):
        i = min(range(len(alphas)), key=lambda i: (loo[f"e{j}_{i}"], i))
        r = sols[k, i]
        rows.append((int(k), float(alphas[i]), float(loo[f"e{j}_{i}"]), r["b0"], r["c1"], r["c2"]))
    return oof.sparkSession.createDataFrame(
        rows, f"{fold} int, alpha double, loo_mse double, intercept double, coef_svr double, coef_gpr double")


def stacking_predict_nested(oof: DataFrame, fold: str = "fold", s: str = "pred_svr", g: str = "pred_gpr",
                            out: str = "pred_stack", **kw) -> DataFrame:
    """E2 ``nested``: every row is predicted by the stacker of its own fold, which has
    not seen it (the fold table has as many rows as folds)."""
    m = F.broadcast(nested_stackers(oof, fold=fold, s=s, g=g, **kw).select(
        F.col(fold).alias("_f"), F.col("alpha").alias("_alpha"), F.col("intercept").alias("_b"), F.col("coef_svr").alias("_cs"), F.col("coef_gpr").alias("_cg")))
    joined = oof.join(m, F.col(fold) == F.col("_f"))
    return joined.withColumn(out, F.col("_b") + F.col("_cs") * F.col(s) + F.col("_cg") * F.col(g)).withColumnRenamed(
        "_alpha", "alpha").drop("_f", "_b", "_cs", "_cg")


def stacking_weights(stacker: DataFrame) -> DataFrame:
    """``coef / sum(coef)``; unchanged when the sum is zero."""
    tot = F.col("coef_svr") + F.col("coef_gpr")
    return stacker.select(
        "alpha",
        F.when(tot != F.lit(0.0), F.col("coef_svr") / tot).otherwise(F.col("coef_svr")).alias("weight_svr"),
        F.when(tot != F.lit(0.0), F.col("coef_gpr") / tot).otherwise(F.col("coef_gpr")).alias("weight_gpr"),
    )
