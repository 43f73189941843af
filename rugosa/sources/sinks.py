"""Report sinks (S4, S5) and the metrics read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

METRIC_NAMES = ("MSE", "RMSE", "RMSE_%", "MAE", "MAE_%", "MBE", "MBE_%", "MAPE", "R2")

METRICS_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType(), False)]
    + [T.StructField(m, T.DoubleType(), True) for m in METRIC_NAMES]
)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a small report table. Reports are parameter-sized (one
    row per model or variable), so a single output file is written."""
    writer = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a metrics report back with an explicit schema."""
    return spark.read.option("header", True).schema(METRICS_SCHEMA).csv(path)
