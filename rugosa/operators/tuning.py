"""Hyperparameter search as Spark jobs.

T1: the trial table is ``spark.range(n)`` with md5-derived uniforms mapped
into each search range (log-uniform where the reference samples on a log
scale), so it is reproducible and identical on any cluster. The reference's
sequential TPE sampler is a single-machine optimiser; here every trial is
evaluated in parallel, sharing each pass over the data:

* SVR (T2): all trials x training splits are one batch of Newton problems --
  one scan per step for the whole study;
* GP (T3): one Gram pass over the distinct-input table for all trials x
  splits (amplitude and noise reuse a Gram), then one scoring pass.

The objective is the pooled out-of-fold MSE (A10); the best trial is the
lowest MSE, ties to the lowest id (K1).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rugosa.operators import kernels as kk
from rugosa.operators import preprocess as pp
from rugosa.operators.ensemble import trial_uniform
from rugosa.session import materialize
from rugosa.settings import SETTINGS


def trial_table(spark: SparkSession, space: dict, n_trials: int, stream: str,
                seed: int = SETTINGS.seed) -> DataFrame:
    """``(trial_id, <param>...)`` for ``n_trials`` seeded trials."""
    df = spark.range(n_trials).select(F.col("id").cast("int").alias("trial_id"))
    cols = [F.col("trial_id")]
    for name, (lo, hi, log) in space.items():
        u = trial_uniform(seed, stream, F.col("trial_id"), name)
        if isinstance(lo, int) and isinstance(hi, int) and not log:
            v = F.least(F.lit(hi), F.lit(lo) + F.floor(u * F.lit(hi - lo + 1))).cast("int")
        elif log:
            v = F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi) - math.log(lo)))
        else:
            v = F.lit(float(lo)) + u * F.lit(float(hi - lo))
        cols.append(v.alias(name))
    return df.select(*cols)


def _result_table(spark, trials: list[dict], mse: np.ndarray, extra_cols: dict | None = None) -> DataFrame:
    names = [k for k in trials[0] if k != "trial_id"]
    best = int(min(range(len(trials)), key=lambda i: (mse[i], trials[i]["trial_id"])))
    fields = [T.StructField("trial_id", T.IntegerType())]
    for n in names:
        fields.append(T.StructField(n, T.IntegerType() if isinstance(trials[0][n], int) else T.DoubleType()))
    fields += [T.StructField("pooled_mse", T.DoubleType()), T.StructField("best", T.BooleanType())]
    rows = [tuple([t["trial_id"], *[t[n] for n in names], float(mse[i]), i == best]) for i, t in enumerate(trials)]
    return spark.createDataFrame(rows, T.StructType(fields))


def tune_svr(folded: DataFrame, target: str, n_trials: int = SETTINGS.svr_trials,
             seed: int = SETTINGS.seed) -> tuple[DataFrame, dict, kk.SVRModel]:
    """Returns (trial table with pooled OOF MSE, best params, fitted study)."""
    spark = folded.sparkSession
    trials = [r.asDict() for r in trial_table(spark, SETTINGS.svr_space, n_trials, "svr", seed).collect()]
    summary = materialize(pp.input_summary(folded, target), checkpoint=True)
    degrees = sorted({t["poly_degree"] for t in trials})
    preps = pp.fit_preps(summary, degrees)
    tprep = pp.fit_target_prep(folded, target)
    specs = [kk.SVRSpec(t["C"], t["epsilon"], t["gamma"], t["poly_degree"]) for t in trials]
    rows = materialize(kk.with_fold_rows(folded, target).drop("run_id"))
    model = kk.fit_svr(rows, preps, tprep, specs, states=range(SETTINGS.n_splits), seed=seed)
    mse = kk.pooled_trial_mse(rows, svr=model, n_specs=len(specs))
    rows.unpersist(blocking=False)
    table = _result_table(spark, trials, mse)
    best = min(range(len(trials)), key=lambda i: (mse[i], trials[i]["trial_id"]))
    return table, trials[best], model


def tune_gpr(folded: DataFrame, target: str, n_trials: int = SETTINGS.gpr_trials,
             seed: int = SETTINGS.seed, n_features: int = SETTINGS.gp_tuning_features,
             refit: bool = True) -> tuple[DataFrame, dict, kk.GPModel]:
    """Returns (trial table with pooled OOF MSE, best params, fitted study).
    ``refit`` lets each trial re-select amplitude and noise by marginal
    likelihood at its drawn length scale and alpha, which stay as drawn (the
    reference refits them, too); ``refit=False`` scores the kernel as drawn. All trials
    share their random draws."""
    spark = folded.sparkSession
    trials = [r.asDict() for r in trial_table(spark, SETTINGS.gpr_space, n_trials, "gpr", seed).collect()]
    summary = materialize(pp.input_summary(folded, target), checkpoint=True)
    prep = pp.fit_prep(summary, SETTINGS.poly_degree)
    specs = [kk.GPSpec(t["amplitude"], t["length_scale"], t["alpha"], t["noise"]) for t in trials]
    model = kk.fit_gp(summary, prep, specs, n_features=n_features, seed=seed, refit=refit,
                      states=range(SETTINGS.n_splits), length_mult=(1.0,))
    rows = kk.with_fold_rows(folded, target)
    mse = kk.pooled_trial_mse(rows, gp=model, n_specs=len(specs))
    table = _result_table(spark, trials, mse)
    best = min(range(len(trials)), key=lambda i: (mse[i], trials[i]["trial_id"]))
    return table, trials[best], model
