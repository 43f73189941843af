"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rugosa.session import ensure_checkpoint_dir, ship_package

#: Rows handled at a time inside one Arrow batch; bounds the Python objects.
SLICE_ROWS = 256
#: Words of a broadcast filter (64 bits each, 2 MB in all).
FILTER_WORDS = 1 << 17


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rugosa-{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/rugosa-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def possibly_among(rows: DataFrame, column: str, wanted: DataFrame, label: str) -> DataFrame:
    """The rows whose ``column``, a hash of 64 bits, may be among the values of the one
    column of ``wanted``: all that are, and few others while the filter of FILTER_WORDS
    words has room. It is broadcast; an exact join has to follow."""
    word = lambda c: F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(FILTER_WORDS - 1))
    own = F.col(wanted.columns[0])
    bit = F.shiftrightunsigned(own, 40).bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.groupBy(word(own).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    marks = F.broadcast(store(marks, label))  # at most FILTER_WORDS rows
    bit = F.shiftrightunsigned(F.col(column), 40).bitwiseAND(F.lit(63)).cast("int")
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return rows.join(marks, word(F.col(column)) == F.col("_word")).where(hit).select(*rows.columns)


class Remembered:
    """Values of recent keys, bounded by bytes. Keys live in two generations: when the
    younger one has used its half of the bound it becomes the older one, and the
    older one goes; a key that is asked for moves to the younger one, so frequent keys
    stay. Keys of more than ``longest`` characters are never kept."""

    #: Bytes of a dictionary entry and its two objects besides their contents.
    ENTRY = 200

    def __init__(self, bound: int, longest: int = 64):
        self.half, self.longest = bound // 2, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def values(self, keys: list[list[str]], learn: Callable[[list[str]], list[bytes]]) -> list[list[bytes]]:
        """The value of every key; ``learn`` is asked for unknown ones, once each."""
        young, before = self.young, self.old.get
        fresh: dict[str, bytes] = {}
        unknown = []
        for k in [k for k in dict.fromkeys(chain.from_iterable(keys)) if k not in young]:
            if (v := before(k)) is None:
                unknown.append(k)
            else:
                fresh[k] = v
        if unknown:
            fresh.update(zip(unknown, learn(unknown), strict=True))
        young.update(fresh)
        out = [list(map(young.__getitem__, own)) for own in keys]
        for k in [k for k in fresh if len(k) > self.longest]:
            del young[k], fresh[k]
        self.used += self.ENTRY * len(fresh) + 2 * sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if self.used > self.half:
            self.old, self.young, self.used = self.young, {}, 0
        return out


#: Letters, and the rest from a punctuation mark or line end on.
HEAD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~\n].*)", re.DOTALL)


def learn_in_parts(
    fresh: list[str], known: Remembered, learn: Callable[[list[str]], list[bytes]], learn_rest: Callable[[list[str]], list[bytes]]
) -> list[bytes]:
    """Values of new keys where that of letters before a punctuation mark does not depend
    on what follows: words are learned once, whatever stands behind them."""
    cut = [(m[1], m[2]) if (m := HEAD.fullmatch(k)) else (k, "") for k in fresh]
    heads = {h: known.young.get(h) or known.old.get(h) for h, _ in cut}
    new = [h for h, v in heads.items() if v is None]
    heads.update(zip(new, learn(new) if new else [], strict=True))
    rests = list(dict.fromkeys(r for _, r in cut if r))
    values = dict(zip(rests, learn_rest(rests) if rests else [], strict=True)) | {"": b""}
    return [heads[h] + values[r] for h, r in cut]


def joined_values(
    cut: pa.ListArray, known: Remembered, learn: Callable[[list[str]], list[bytes]], kind: str
) -> tuple[np.ndarray, np.ndarray]:
    """The values (numbers of ``kind``) of the keys of all lists, one list after another,
    and where each list starts among them and the last one ends. Arrow numbers the
    different keys, so only those become Python objects."""
    coded = cut.flatten().dictionary_encode()
    values = known.values([coded.dictionary.to_pylist()], learn)[0]
    table = np.frombuffer(b"".join(values), dtype=kind)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // table.itemsize
    codes = coded.indices.to_numpy(zero_copy_only=False)
    own = sizes[codes]
    ends = np.cumsum(own)
    at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - own), own)
    at += np.arange(len(at))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    return table[at], np.concatenate([[0], ends])[offsets - offsets[0]]


_kept: dict[tuple, object] = {}


def worker_object(key: tuple, make: Callable[[], object]) -> object:
    """An object that this Python worker keeps for later tasks, one at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def drop_worker_object() -> None:
    """Python workers outlive a stage: tasks that need no such object free what
    another operator's tasks have left in the worker."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:   # freed pages stay with the process otherwise (glibc)
            trim(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that starts no column name of ``df``."""
    name = "_" + stem
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns never clash or travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def arrow_rows(
    df: DataFrame, schema: str, columns: list[str], make: Callable[[], Callable[[list], list]], keeps: bool = False
) -> DataFrame:
    """``mapInArrow`` over slices of rows. ``make()`` runs once per task and
    returns a function from a list of input rows (tuples in the order of
    ``df.columns``) to a list of output rows (tuples in the order of ``columns``);
    ``keeps`` tells whether it uses :func:`worker_object`."""
    ship_package(df.sparkSession)
    empty = df.sparkSession.createDataFrame([], schema)
    arrow_schema = _arrow(empty)
    assert arrow_schema.names == columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_worker_object()
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                out = fn(rows)
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(cols, arrow_schema, strict=True)],
                        schema=arrow_schema,
                    )

    return df.mapInArrow(run, schema)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
