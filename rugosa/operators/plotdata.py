"""The data behind the reference's figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.operators.folds import _bucketed_rank, seeded_key
from rugosa.settings import SETTINGS


def bounds(df: DataFrame, column: str) -> DataFrame:
    """Min / max of a column (identity line of a parity plot)."""
    return df.agg(F.min(column).alias("mn"), F.max(column).alias("mx"))


def histogram(df: DataFrame, column: str, n_bins: int = SETTINGS.hist_bins) -> DataFrame:
    """Equal-width histogram, last bin closed:
    ``(bin, lo, hi, count)`` for every bin including empty ones."""
    spark = df.sparkSession
    b = bounds(df, column).select(F.struct("mn", "mx")).scalar()
    mn, mx = b["mn"], b["mx"]
    width = mx - mn
    raw = F.when(width == F.lit(0.0), F.lit(0)).otherwise(
        F.floor((F.col(column) - mn) / width * F.lit(float(n_bins))))
    code = F.least(raw, F.lit(n_bins - 1)).cast("int")
    counts = df.select(code.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    # the bin grid has exactly n_bins rows
    grid = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    step = width / F.lit(float(n_bins))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (mn + F.col("bin").cast("double") * step).alias("lo"),
        (mn + (F.col("bin") + 1).cast("double") * step).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def scatter_by_param(df: DataFrame, key: str, params: Sequence[str], target: str) -> DataFrame:
    """V2: long table ``(key, param, x, y)`` for the target-vs-input scatters."""
    return df.unpivot([key, target], list(params), "param", "x").select(
        key, "param", F.col("x").cast("double").alias("x"), F.col(target).alias("y"))


def scatter_binned(df: DataFrame, params: Sequence[str], target: str, n_bins: int = 50) -> DataFrame:
    """V2 at scale: 2-D binned counts per input instead of raw points."""
    long = df.unpivot([target], list(params), "param", "x")
    agg = long.groupBy("param").agg(F.min("x").alias("xmn"), F.max("x").alias("xmx"))
    yb = bounds(df, target).select(F.struct("mn", "mx")).scalar()
    j = long.join(F.broadcast(agg), "param")
    # a constant column has one bin, number 0
    bx = F.least(F.floor(F.try_divide(F.col("x") - F.col("xmn"), F.col("xmx") - F.col("xmn")) * n_bins), F.lit(n_bins - 1))
    by = F.least(F.floor(F.try_divide(F.col(target) - yb["mn"], yb["mx"] - yb["mn"]) * n_bins), F.lit(n_bins - 1))
    return j.groupBy("param", F.coalesce(bx, F.lit(0)).cast("int").alias("xbin"),
                     F.coalesce(by, F.lit(0)).cast("int").alias("ybin")).agg(F.count(F.lit(1)).alias("count"))


def actual_vs_predicted(oof: DataFrame, key: str, y: str, models: Mapping[str, str]) -> DataFrame:
    """V3: ``(model, key, actual, predicted)`` for every model."""
    cols = {name: F.col(c) for name, c in models.items()}
    wide = oof.select(key, F.col(y).alias("actual"), *[c.alias(n) for n, c in cols.items()])
    return wide.unpivot([key, "actual"], list(models), "model", "predicted").select(
        "model", key, "actual", "predicted")


def sample_index(oof: DataFrame, key: str, fold_col: str = "fold", seed: int = SETTINGS.seed,
                 hex_digits: int = SETTINGS.rank_bucket_hex, out: str = "sample_idx") -> DataFrame:
    """Position in the fold-concatenated order (fold ascending, then
    ``md5(seed:key)`` inside a fold), 0-based, without a global window."""
    ranked = _bucketed_rank(oof, seeded_key(key, seed), [fold_col], hex_digits, "_r")
    sizes = oof.groupBy(fold_col).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    offs = sizes.select(fold_col, F.coalesce(F.sum("_n").over(
        Window.orderBy(fold_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    # at most n_splits rows
    return ranked.join(F.broadcast(offs), fold_col).withColumn(
        out, (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_o", "_r")


def model_comparison_series(oof: DataFrame, key: str, y: str, models: Mapping[str, str],
                            fold_col: str = "fold") -> DataFrame:
    """V4: ``(sample_idx, actual, <model>...)`` in fold-concatenated order."""
    idx = sample_index(oof, key, fold_col)
    return idx.select("sample_idx", F.col(y).alias("actual"), *[F.col(c).alias(n) for n, c in models.items()])
