"""Regression metrics (A1-A10) as single-pass aggregates.

All models are scored in ONE global aggregate over the prediction table
(one column group per model), and the one-row result is turned into one row
per model afterwards -- no 4x row explosion, no shuffle beyond the final
single-partition merge of partial aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.settings import SETTINGS
from rugosa.sources.sinks import METRIC_NAMES


def _metric_aggs(y: Column, p: Column, tag: str) -> list[Column]:
    d = p - y
    return [
        F.count(F.lit(1)).alias(f"{tag}__n"),
        F.avg(d * d).alias(f"{tag}__mse"),
        F.sum(d * d).alias(f"{tag}__sse"),
        F.avg(F.abs(d)).alias(f"{tag}__mae"),
        F.avg(d).alias(f"{tag}__mbe"),
        F.avg(F.abs((y - p) / F.greatest(F.abs(y), F.lit(SETTINGS.mape_floor)))).alias(f"{tag}__mape"),
        F.avg(F.abs(y)).alias(f"{tag}__may"),
        F.var_pop(y).alias(f"{tag}__vy"),
    ]


def _metric_struct(tag: str, model_name: str) -> Column:
    c = lambda s: F.col(f"{tag}__{s}")
    rmse = F.sqrt(c("mse"))
    sst = c("n").cast("double") * c("vy")
    r2 = (
        F.when(sst == F.lit(0.0), F.when(c("sse") == F.lit(0.0), F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - c("sse") / sst)
    )
    pct = lambda v: F.try_divide(v, c("may")) * F.lit(100.0)
    return F.struct(
        F.lit(model_name).alias("model"),
        c("mse").alias("MSE"),
        rmse.alias("RMSE"),
        pct(rmse).alias("RMSE_%"),
        c("mae").alias("MAE"),
        pct(c("mae")).alias("MAE_%"),
        c("mbe").alias("MBE"),
        pct(c("mbe")).alias("MBE_%"),
        (c("mape") * F.lit(100.0)).alias("MAPE"),
        r2.alias("R2"),
    )


def calculate_metrics(df: DataFrame, y: str, p: str, model_name: str = "model") -> DataFrame:
    """The nine metrics of one prediction column, one row."""
    return metrics_report(df, y, {model_name: F.col(p)})


def metrics_report(df: DataFrame, y: str, models: Mapping[str, Column | str]) -> DataFrame:
    """``(model, MSE, RMSE, RMSE_%, MAE, MAE_%, MBE, MBE_%, MAPE, R2)``,
    one row per model, in one scan."""
    yc = F.col(y)
    aggs: list[Column] = []
    tags = {}
    for i, (name, pred) in enumerate(models.items()):
        tag = f"m{i}"
        tags[name] = tag
        aggs += _metric_aggs(yc, F.col(pred) if isinstance(pred, str) else pred, tag)
    one = df.agg(*aggs)
    rows = F.array(*[_metric_struct(tag, name) for name, tag in tags.items()])
    return one.select(F.inline(rows)).select("model", *METRIC_NAMES)


def pooled_oof_mse(oof: DataFrame, y: str, models: Mapping[str, Column | str],
                   fold_col: str = "fold") -> DataFrame:
    """A10: pooled out-of-fold MSE (sum of squared errors over all folds /
    all rows) next to the mean of per-fold MSEs, per model."""
    yc = F.col(y)
    per_fold = oof.groupBy(fold_col).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum((F.col(p) if isinstance(p, str) else p) - yc).alias(f"_d{i}") for i, p in enumerate(models.values())],
        *[F.sum(((F.col(p) if isinstance(p, str) else p) - yc) * ((F.col(p) if isinstance(p, str) else p) - yc)).alias(f"_s{i}")
          for i, p in enumerate(models.values())],
    )
    tot = per_fold.agg(
        F.sum("_n").alias("n"),
        *[(F.sum(f"_s{i}") / F.sum("_n")).alias(f"pooled{i}") for i in range(len(models))],
        *[F.avg(F.col(f"_s{i}") / F.col("_n")).alias(f"foldavg{i}") for i in range(len(models))],
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"pooled{i}").alias("pooled_mse"),
                 F.col(f"foldavg{i}").alias("mean_fold_mse"), F.col("n").cast("long").alias("n"))
        for i, name in enumerate(models)
    ])
    return tot.select(F.inline(rows))
