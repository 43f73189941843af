"""Shared building blocks of the registered queries.

Computed floating outputs are rounded to 6 decimals so that results compare
across engines (sums in a different order differ in the last bits); values
that are pure pass-through or a single IEEE operation of pass-through values
are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rugosa.functions.features import add_engineered_features
from rugosa.operators.folds import assign_folds
from rugosa.operators.scorers import oof_base_predictions
from rugosa.session import stored
from rugosa.sources.tables import load_runs, load_table

TARGET = "Ra_planted"


def r6(c: Column | str) -> Column:
    """6-decimal rounding written as ``round(x * 1e6) / 1e6`` so that a tie is
    decided on the same binary product in every engine."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x * F.lit(1e6), 0) / F.lit(1e6)


def round_all(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[
        r6(c).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes
    ])


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return load_runs(spark, sf)


def features(spark: SparkSession, sf: str, guard_eps: float | None = 1e-9) -> DataFrame:
    return add_engineered_features(runs(spark, sf), guard_eps)


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with bins and folds, written once to the checkpoint folder: every
    later operator (scorers, models, plot data) reads the pinned table."""
    return stored(assign_folds(runs(spark, sf), "run_id", TARGET), "folded")


def oof(spark: SparkSession, sf: str) -> DataFrame:
    """The out-of-fold table, pinned: blending, stacking and metrics each run
    small aggregates over it."""
    # the target has 6 decimals: group sums are exact integer micro-unit sums
    return stored(oof_base_predictions(folded(spark, sf), TARGET, decimals=6), "oof")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "events")
