"""Experiment-table scan and cleaning (CSV with a header).

Semantics follow a lenient numeric parse: anything that is not a plain
decimal / scientific literal (or inf / nan) becomes missing, and rows with a
missing value are dropped. ``inf`` survives cleaning; model fits reject it
later with :func:`assert_finite`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rugosa.settings import SETTINGS

# fixed values: accepted numeric text, one optional sign, digits with an
# optional fraction (or a bare fraction), an optional exponent; or inf/nan.
NUMERIC_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*)|(\.[0-9]+))([eE][+-]?[0-9]+)?$"
SPECIAL_PATTERN = r"^(?i)[+-]?(inf|infinity|nan)$"


def load_experiments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column read as STRING (no schema inference)."""
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def normalize_columns(df: DataFrame) -> DataFrame:
    """S2 + S3: strip column names; rename ``Ax`` to ``ap`` only when ``ap``
    is absent."""
    stripped = df.toDF(*[c.strip() for c in df.columns])
    if "Ax" in stripped.columns and "ap" not in stripped.columns:
        stripped = stripped.withColumnRenamed("Ax", "ap")
    return stripped


def select_required(df: DataFrame, required: Sequence[str] = SETTINGS.required_columns,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Keep the required columns (plus pass-through ``keep`` columns),
    raising when one is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*keep, *required)


def lenient_double(c: Column | str) -> Column:
    """Text -> DOUBLE, NULL for anything that is not a numeric literal.

    ``try_cast`` alone would accept Java-style suffixes such as ``1.0d``, so a
    pattern guard decides first. Numeric inputs pass through unchanged.
    """
    col = F.col(c) if isinstance(c, str) else c
    text = F.trim(col.cast("string"))
    ok = text.rlike(NUMERIC_PATTERN) | text.rlike(SPECIAL_PATTERN)
    return F.when(ok, text.try_cast("double"))


def clean_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """P2 + P3: lenient cast of every data column, then drop rows where any is
    NULL or NaN (Infinity is kept, as in the reference)."""
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in keep]
    typed = df.select(
        *keep,
        *[
            (F.col(c) if dict(df.dtypes)[c] == "double" else lenient_double(c)).alias(c)
            for c in cols
        ],
    )
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return typed.filter(cond)


def load_experiments(spark: SparkSession, path: str) -> DataFrame:
    """S1-S3 + P1-P3 composed: the cleaned ``Vc, Fz, ap, Ra`` table."""
    raw = normalize_columns(load_experiments_csv(spark, path))
    return clean_numeric(select_required(raw))


def assert_finite(df: DataFrame, columns: Sequence[str]) -> None:
    """Reject +-Infinity before a model fit (one tiny aggregate)."""
    bad = df.select(
        *[F.sum(F.when(F.abs(F.col(c)) == float("inf"), 1).otherwise(0)).alias(c) for c in columns]
    ).first()
    offenders = {c: bad[c] for c in columns if bad[c]}
    if offenders:
        raise ValueError(f"non-finite values in {offenders}")
