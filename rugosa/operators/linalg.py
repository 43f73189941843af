"""Distributed partial sums.

Pattern used by every model operator: ``mapInPandas`` turns each partition
into a few rows ``(key INT, vec BINARY)`` of partial sums; a two-level
grouped element-wise sum (first by ``(key, task % fanin)``, then by ``key``)
reduces them, so no reducer ever sees more than ``fanin`` (first level) or
``#tasks / fanin`` (second level) vectors of a key. Only the reduced vectors
-- fixed size, independent of the row count -- are collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: ``vec`` holds doubles, as bytes: long vectors never become Python lists.
PARTIAL_SCHEMA = "key int, vec binary"


@pandas_udf(T.BinaryType())
def vsum(v: pd.Series) -> bytes:
    """Element-wise sum of equal-length vectors (grouped aggregate)."""
    total = np.frombuffer(v.iloc[0], dtype=np.float64).copy()
    for part in v.iloc[1:]:
        total += np.frombuffer(part, dtype=np.float64)
    return total.tobytes()


def reduced(partials: DataFrame, fanin: int = 64) -> DataFrame:
    """Sum ``(key, vec)`` rows per key."""
    from rugosa.session import ship_package

    ship_package(partials.sparkSession)
    lvl1 = partials.groupBy("key", (F.abs(F.hash(F.spark_partition_id())) % fanin).alias("_t")).agg(
        vsum("vec").alias("vec"))
    return lvl1.groupBy("key").agg(vsum("vec").alias("vec"))


def gathered(it: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Arrow batches put together until they hold ``rows`` rows."""
    held, n = [], 0
    for pdf in it:
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def partial_sums(df: DataFrame, fn: Callable[[pd.DataFrame], dict[int, np.ndarray]],
                 fanin: int = 64, rows: int = 1) -> dict[int, np.ndarray]:
    """Run ``fn`` on every Arrow batch of ``df`` (it returns ``{key: vector}``
    partial sums), accumulate per partition, then reduce across the cluster;
    returns driver arrays. Batches are put together until they hold ``rows`` rows."""
    return {int(r["key"]): np.frombuffer(r["vec"], dtype=np.float64) for r in summed(df, fn, fanin, rows).collect()}


def summed(df: DataFrame, fn: Callable[[pd.DataFrame], dict[int, np.ndarray]], fanin: int = 64, rows: int = 1) -> DataFrame:
    """As :func:`partial_sums`, but the sums stay in a table ``(key, vec)``."""

    def per_partition(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in gathered(it, rows):
            if len(pdf) == 0:
                continue
            for k, v in fn(pdf).items():
                acc[k] = acc[k] + v if k in acc else np.asarray(v, dtype=np.float64).copy()
        if acc:
            yield pd.DataFrame({"key": list(acc.keys()), "vec": [a.tobytes() for a in acc.values()]})

    return reduced(df.mapInPandas(per_partition, PARTIAL_SCHEMA), fanin)
