"""Integer forms of the rows of an embeddings table, shared by the vector operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a component per unit.
STEPS = 256


def _array_column(vectors: DataFrame) -> str:
    """The vector column: ``embedding``, else the first array of numbers."""
    arrays = [c for c, kind in vectors.dtypes if kind in ("array<float>", "array<double>")]
    named = [c for c in arrays if c.lower() == "embedding"]
    if not arrays:
        raise ValueError("the table has no array<float> or array<double> column")
    return (named or arrays)[0]


def integer_vectors(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """``vec_id`` and ``x``, an array<bigint> of floor(256 * component), of the rows
    whose vector has no null or non-finite component (and ``size`` of them, if given;
    a vector without components is none). Other columns never travel."""
    from rugosa.llm.common import quoted

    v = F.col(quoted(_array_column(vectors))).cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sized = F.size("v") == size if size is not None else F.size("v") > 0
    kept = kept.where(F.col("v").isNotNull() & sized & F.forall("v", _finite))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * STEPS)).alias("x"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
