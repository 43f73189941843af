"""Parquet tables of the driver and the ``runs`` view built on ``lineitem``.

The view maps order lines onto the experiment schema so that every operator
runs on whole driver tables:

    run_id      unique key  orderkey:linenumber:partkey:suppkey:int(quantity)
    Vc          l_quantity            (1..50, positive)
    Fz          l_discount            (0..0.10, contains zeros)
    ap          l_tax + 0.5           (positive)
    Ra          l_extendedprice / 10000
    Ra_planted  a smooth function of (Vc, Fz, ap) plus md5-derived noise,
                rounded to 6 decimals, so that models have a signal to learn
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_unit(s: Column) -> Column:
    """Uniform in [0, 1] from the first 32 bits of md5(s); identical in DuckDB
    as ``('0x' || substr(md5(s), 1, 8))::BIGINT / 4294967295``."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def run_id_expr() -> Column:
    """Unique key of an order line (see module doc)."""
    return F.concat_ws(
        ":",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_quantity").cast("int").cast("string"),
    )


def runs_from_lineitem(lineitem: DataFrame) -> DataFrame:
    run_id = run_id_expr()
    vc, fz = F.col("l_quantity"), F.col("l_discount")
    ap = F.col("l_tax") + F.lit(0.5)
    u = md5_unit(F.col("run_id"))
    planted = (
        F.lit(0.2)
        + F.lit(0.02) * F.col("Vc")
        + F.lit(3.0) * F.col("Fz") * F.col("ap")
        + F.lit(0.15) * F.sin(F.col("Vc") / F.lit(8.0))
        + F.lit(0.1) * (u - F.lit(0.5))
    )
    return (
        lineitem.select(
            run_id.alias("run_id"),
            vc.alias("Vc"),
            fz.alias("Fz"),
            ap.alias("ap"),
            (F.col("l_extendedprice") / F.lit(10000.0)).alias("Ra"),
        )
        .withColumn("Ra_planted", F.round(planted, 6))
    )


def load_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from_lineitem(load_table(spark, sf_dir, "lineitem"))


def continuous_inputs(runs: DataFrame) -> DataFrame:
    """The runs with inputs that (nearly) no two rows share: each base input is moved
    by a uniform number from its own digits of the key's md5."""
    def unit(first: int) -> Column:
        return F.conv(F.substring(F.md5("run_id"), first, 8), 16, 10).cast("double") / F.lit(4294967295.0)

    return runs.withColumns({
        "Vc": F.col("Vc") + unit(9),
        "Fz": F.col("Fz") + F.lit(0.01) * unit(17) + F.lit(0.001),
        "ap": F.col("ap") + F.lit(0.1) * unit(25),
    })
