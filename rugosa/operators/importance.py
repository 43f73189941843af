"""Permutation importance and importance tables.

A permutation of a whole column, without a global sort: every row has two exact
ranks, one by ``md5(seed:key)`` (the receiver's) and one by
``md5(seed:repeat:key)`` (the donor's), both by the two-stage rank of
``operators/folds.py``; the row of receiver rank r gets the values of the row of
donor rank r. That is a uniformly random permutation of all rows, the same on
any cluster. One repeat moves whole rows once, for all features: each feature is
then swapped alone in the scoring expression, so a repeat costs one join on a
dense integer, whatever the number of features.

For importances that join is made chunk by chunk (:func:`aligned_chunks`): counts per
hash prefix say beforehand which ranks a prefix holds, so a task that reads rows sends
every one, once for each repeat, straight to the chunk of ranks it will have, packed by
chunk; receivers and donors meet there, and no second shuffle is needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rugosa.functions.features import BASE_INPUTS
from rugosa.operators.folds import _bucketed_rank, seeded_key
from rugosa.settings import SETTINGS

Scorer = Callable[[Mapping[str, Column]], Column]


def _donor_key(seed: int, repeat: Column, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), repeat.cast("string"), F.lit(":"), F.col(key).cast("string")))


def permute_column(df: DataFrame, key: str, column: str, repeat: int = 0,
                   seed: int = SETTINGS.seed, out: str | None = None) -> DataFrame:
    """Add ``out`` (default ``<column>_perm``): the column's values,
    permuted over all rows for the given repeat."""
    out = out or f"{column}_perm"
    receivers = _bucketed_rank(df, seeded_key(key, seed), [], SETTINGS.rank_bucket_hex, "_r")
    donors = _bucketed_rank(df.select(key, F.col(column).alias(out)), _donor_key(seed, F.lit(repeat), key), [],
                            SETTINGS.rank_bucket_hex, "_r").select("_r", out)
    return receivers.join(donors, "_r").drop("_r")


def permutation_pairs(df: DataFrame, key: str, features: Sequence[str], target: str,
                      n_repeats: int = SETTINGS.permutation_repeats, seed: int = SETTINGS.seed) -> DataFrame:
    """W4 for every repeat: ``(rep, <key>, <features>, <target>, _pv)`` where the
    struct ``_pv`` holds the donor row's value of every feature."""
    feats = list(features)
    receivers = _bucketed_rank(df.select(key, *feats, target), seeded_key(key, seed), [],
                               SETTINGS.rank_bucket_hex, "_r")
    donors = df.select(key, F.struct(*[F.col(f).alias(f"p{j}") for j, f in enumerate(feats)]).alias("_pv")).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("rep"), key, "_pv")
    donors = _bucketed_rank(donors, _donor_key(seed, F.col("rep"), key), ["rep"], SETTINGS.rank_bucket_hex, "_r")
    return receivers.join(donors.select("rep", "_r", "_pv"), "_r").drop("_r")


#: Ranks of a chunk, at most, and rows that a task packs at once with ten repeats (more
#: rows with fewer).
CHUNK_RANKS, PACK_ROWS = 65_536, 200_000
#: Bits of the hash whose counts fix the ranks beforehand.
PREFIX_BITS = 16
#: Bits of a hash that travel: its distance from the first prefix of its chunk.
KEY_BITS = 48
#: What stands for NULL among doubles that travel as bytes.
_NULL = np.uint64(0x7FF8_0000_6E75_6C6C)


def _bits(column: pa.Array) -> np.ndarray:
    """Doubles as their bits, NULL as one of its own."""
    out = column.to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64).copy()
    if column.null_count:
        out[column.is_null().to_numpy(zero_copy_only=False)] = _NULL
    return out


def _digests(column: pa.Array) -> np.ndarray:
    """The first 64 bits of 16-byte digests."""
    raw = np.frombuffer(b"".join(column.to_pylist()) if column.offset else column.buffers()[2], np.uint8)[:16 * len(column)].reshape(-1, 16)
    return raw[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _packed_columns(columns: list[np.ndarray]) -> tuple[np.ndarray | None, list[np.ndarray], list[np.ndarray | None]]:
    """One code of two bytes for the columns of few values, together; their values, or
    the bits themselves of a column that the code has no room for and None."""
    joint, room, data, values = None, 1 << 16, [], []
    for bits in columns:
        own, codes = np.unique(bits, return_inverse=True)
        fits = 0 < len(own) <= room
        data.append(own if fits else bits)
        values.append(own if fits else None)
        if fits:
            room //= len(own)
            codes = codes.ravel().astype(np.uint16)
            joint = codes if joint is None else joint * np.uint16(len(own)) + codes
    return joint, data, values


def aligned_chunks(df: DataFrame, key: str, carry: Sequence[str], target: str, fn, schema: str,
                   repeats: Sequence[int] = range(SETTINGS.permutation_repeats), seed: int = SETTINGS.seed,
                   most: int = CHUNK_RANKS) -> DataFrame:
    """W4 for the repeats given: ``fn(own, y, donors)`` of every chunk of receiver ranks, a
    table of ``schema``. ``own`` (columns x ranks) and ``donors[i]`` hold the bits of
    the ``carry`` columns, ``y`` those of the target; rank by rank they are a receiver
    and the donors of its repeats. Rows without a key take no part. The order is that
    of the first 48 bits and more of the hashes, the more the more rows there are (55 for
    200 million rows): what counts inside a chunk is the distance from its first prefix.
    Where these bits are equal the values decide."""
    from rugosa.operators.linalg import PARTIAL_SCHEMA, reduced

    spark = df.sparkSession
    every, cols = len(repeats) + 1, list(carry)
    hashes = [seeded_key(key, seed), *[_donor_key(seed, F.lit(int(r)), key) for r in repeats]]
    rows = df.where(F.col(key).isNotNull()).select(
        *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], F.col(target).cast("double").alias("y"),
        *[F.unhex(h).alias(f"h{i}") for i, h in enumerate(hashes)])
    shift = np.uint64(64 - PREFIX_BITS)

    def count(batches):
        acc = np.zeros((every, 1 << PREFIX_BITS))
        for b in batches:
            for h in range(every if b.num_rows else 0):
                acc[h] += np.bincount((_digests(b.column(h)) >> shift).astype(np.int64), minlength=1 << PREFIX_BITS)
        yield pa.RecordBatch.from_pydict({"key": pa.array([0], pa.int32()), "vec": [acc.tobytes()]})

    got = reduced(rows.select(*[f"h{i}" for i in range(every)]).mapInArrow(count, PARTIAL_SCHEMA)).collect()
    counts = (np.frombuffer(got[0]["vec"]).reshape(every, -1) if got else np.zeros((every, 1 << PREFIX_BITS))).astype(np.int64)
    total = int(counts[0].sum())
    tasks = 2 * spark.sparkContext.defaultParallelism
    size = int(min(most, max(4096, -(-total // tasks))))
    off = np.cumsum(counts, axis=1) - counts
    first, last = (off // size).astype(np.int32), (np.maximum(off + counts - 1, off) // size).astype(np.int32)
    # the first prefix of every chunk, and how many bits after the prefix have room
    chunks = int(last.max()) + 1
    base = np.stack([np.searchsorted(last[h], np.arange(chunks)) for h in range(every)]).astype(np.uint64)
    top = np.stack([np.searchsorted(first[h], np.arange(chunks), "right") for h in range(every)]).astype(np.uint64)
    left = np.uint64(KEY_BITS - int((top - base).max()).bit_length())
    room = PACK_ROWS * (SETTINGS.permutation_repeats + 1) // every

    def pack(batches):
        for table in _gathered(batches, room):
            code, packed, values = _packed_columns([_bits(table.column(i).combine_chunks()) for i in range(len(cols))])
            y = _bits(table.column(len(cols)).combine_chunks())
            chunk, which, row, near = [], [], [], []
            for h in range(every):
                hi = _digests(table.column(len(cols) + 1 + h).combine_chunks())
                rest = (hi << np.uint64(PREFIX_BITS)) >> (np.uint64(64) - left)
                prefix = (hi >> shift).astype(np.int64)
                at, end, who = first[h][prefix], last[h][prefix], np.arange(len(hi), dtype=np.int32)
                while len(who):
                    chunk.append(at)
                    which.append(np.full(len(who), h, np.uint8))
                    row.append(who)
                    near.append(((prefix[who].astype(np.uint64) - base[h][at]) << left) | rest[who])
                    on = at < end   # a prefix whose ranks lie in several chunks goes to all of them
                    at, end, who = at[on] + 1, end[on], who[on]
            chunk, which, row, near = (np.concatenate(v) for v in (chunk, which, row, near))
            order = np.argsort(chunk, kind="stable")   # by chunk, then hash, as they were put in
            chunk, which, row, near = chunk[order], which[order], row[order], near[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
            out = {"chunk": [], "n": [], "high": [], "more": [], "y": [], "code": [], **{f"{x}{i}": [] for i in range(len(cols)) for x in "cv"}}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = np.bincount(which[a:b], minlength=every).astype(np.int32)
                out["chunk"].append(int(chunk[a]))
                out["n"].append(n.tobytes())
                out["high"].append((near[a:b] >> np.uint64(32)).astype(np.uint16).tobytes())
                out["more"].append(near[a:b].astype(np.uint32).tobytes())
                out["y"].append(y[row[a:a + n[0]]].tobytes())
                out["code"].append(None if code is None else code[row[a:b]].tobytes())
                for i in range(len(cols)):
                    out[f"c{i}"].append(packed[i][row[a:b]].tobytes() if values[i] is None else None)
                    out[f"v{i}"].append(None if values[i] is None else values[i].tobytes())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "chunk" else pa.binary()) for k, v in out.items()})

    def meet(table: pa.Table) -> pa.Table:
        parts = table.to_pydict()
        low = parts["chunk"][0] * size
        ranks = min(size, total - low)
        held = [[] for _ in range(every)]
        ys = []
        for j in range(table.num_rows):
            n = np.frombuffer(parts["n"][j], np.int32)
            cut = np.concatenate([[0], np.cumsum(n)])
            near = np.frombuffer(parts["high"][j], np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(parts["more"][j], np.uint32)
            code = parts["code"][j] and np.frombuffer(parts["code"][j], np.uint16)
            data = [None] * len(cols)
            for i in reversed(range(len(cols))):   # the last column has the lowest part of the code
                if parts[f"v{i}"][j] is None:
                    data[i] = np.frombuffer(parts[f"c{i}"][j], np.uint64)
                else:
                    values = np.frombuffer(parts[f"v{i}"][j], np.uint64)
                    data[i], code = values[code % len(values)], code // len(values)
            data = np.stack(data)
            ys.append(np.frombuffer(parts["y"][j], np.uint64))
            for h in range(every):
                if n[h]:
                    held[h].append((near[cut[h]:cut[h + 1]], data[:, cut[h]:cut[h + 1]]))
        y = np.concatenate(ys)

        def ranked(h: int) -> tuple[np.ndarray, np.ndarray]:
            near, data = np.concatenate([p[0] for p in held[h]]), np.concatenate([p[1] for p in held[h]], axis=1)
            order = np.argsort(near)
            if (near[order[1:]] == near[order[:-1]]).any():
                order = np.lexsort((*data, *([] if h else [y]), near))
            # complete prefixes, so ranks are positions
            start = low - int(off[h][int(near[order[0]] >> left) + int(base[h][parts["chunk"][0]])])
            order = order[start:start + ranks]
            return order, data[:, order]

        order, own = ranked(0)
        return fn(own, y[order], [ranked(h)[1] for h in range(1, every)])

    from rugosa.session import ship_package

    ship_package(spark)
    schema_of = "chunk int, n binary, high binary, more binary, y binary, code binary" + "".join(f", c{i} binary, v{i} binary" for i in range(len(cols)))
    parts = rows.mapInArrow(pack, schema_of).repartition(max(tasks, -(-total // (8 * size))), "chunk")
    return parts.groupBy("chunk").applyInArrow(meet, schema)


def _doubles(bits: np.ndarray) -> pa.Array:
    return pa.array(bits.view(np.float64), mask=bits == _NULL, from_pandas=False)


def permutation_rows(df: DataFrame, key: str, carry: Sequence[str], target: str,
                     n_repeats: int = SETTINGS.permutation_repeats, seed: int = SETTINGS.seed) -> DataFrame:
    """W4 for every repeat: ``(rep, o0, .., p0, .., y)``: the receiver's ``carry``
    columns, the donor's, and the receiver's target."""
    names = [f"{x}{i}" for x in "op" for i in range(len(carry))]

    def meet(own, y, donors):
        parts = [pa.table([pa.array(np.full(len(y), r, np.int32)), *[_doubles(v) for v in (*own, *d)], _doubles(y)], names=["rep", *names, "y"])
                 for r, d in enumerate(donors)]
        return pa.concat_tables(parts)

    schema = "rep int, " + ", ".join(f"{c} double" for c in names) + ", y double"
    return aligned_chunks(df, key, carry, target, meet, schema, range(n_repeats), seed)


def _summarise(per_rep: DataFrame, feats: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in feats])
    return per_rep.groupBy("method", "feat").agg(
        F.avg("d").alias("importance"), F.stddev_pop("d").alias("std")
    ).select("method", F.element_at(names, F.col("feat") + 1).alias("feature"), "importance", "std")


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], target: str,
                           scorers: Mapping[str, Scorer], n_repeats: int = SETTINGS.permutation_repeats,
                           seed: int = SETTINGS.seed, carry: Sequence[str] | None = None,
                           derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """I1 + I2: ``(method, feature, importance, std)`` where importance is the
    mean over repeats of ``MSE(permuted) - MSE(base)`` (score = -MSE) and std
    the population deviation over repeats. ``scorers`` maps a method name to
    a function from feature columns to a prediction column (JVM-side). Where all
    features follow from a few columns, ``carry`` names these and ``derive`` adds the
    features to a table that has them: then only those travel."""
    feats = list(features)
    base_cols = {f: F.col(f) for f in feats}
    y = F.col(target)
    moved = feats if carry is None else list(carry)
    derive = derive or (lambda d: d)
    pairs = permutation_rows(df, key, moved, target, n_repeats, seed)
    given = derive(pairs.select("rep", F.col("y").alias("_y"), *[F.col(f"o{i}").alias(c) for i, c in enumerate(moved)],
                                *[f"p{i}" for i in range(len(moved))]))
    given = given.select("rep", "_y", F.struct(*[F.col(f).alias(f"p{j}") for j, f in enumerate(feats)]).alias("_own"),
                         *[F.col(f"p{i}").alias(c) for i, c in enumerate(moved)])
    paired = derive(given).select("rep", "_own", F.struct(*[F.col(f).alias(f"p{j}") for j, f in enumerate(feats)]).alias("_pv"), "_y")
    own_cols = {f: F.col(f"_own.p{j}") for j, f in enumerate(feats)}
    per_rep_aggs, base_aggs = [], []
    for i, fn in enumerate(scorers.values()):
        db = fn(base_cols) - y
        base_aggs.append(F.avg(db * db).alias(f"_b{i}"))
        for j, f in enumerate(feats):
            dp = fn({**own_cols, f: F.col(f"_pv.p{j}")}) - F.col("_y")
            per_rep_aggs.append(F.avg(dp * dp).alias(f"_m{i}_{j}"))
    wide = paired.groupBy("rep").agg(*per_rep_aggs)
    per_rep = wide.select("rep", F.inline(F.array(*[
        F.struct(F.lit(j).alias("feat"), *[F.col(f"_m{i}_{j}").alias(f"_m{i}") for i in range(len(scorers))])
        for j in range(len(feats))])))
    baseline = df.agg(*base_aggs).select(F.struct(*[f"_b{i}" for i in range(len(scorers))])).scalar()
    diffs = per_rep.select(
        "rep", "feat",
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("method"), (F.col(f"_m{i}") - baseline[f"_b{i}"]).alias("d"))
            for i, name in enumerate(scorers)
        ])),
    )
    return _summarise(diffs, feats)


#: Ranks of a chunk where a model is evaluated: the more, the more rows share a value.
MODEL_CHUNK_RANKS = 262_144
#: Rows up to which a model takes all repeats at once; repeats at once beyond.
WHOLE_ROWS, REPEATS_AT_ONCE = 2_000_000, 3
#: Cells of the table of values of a feature (own inputs x values put in), at most.
VALUE_CELLS = 8_000_000


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a table of bits, and which of them every column is."""
    code = np.zeros(columns.shape[1], np.int64)
    for v in columns:
        values, own = np.unique(v, return_inverse=True)
        _, code = np.unique(code * len(values) + own.ravel(), return_inverse=True)
        code = code.ravel()
    _, at = np.unique(code, return_index=True)
    return columns[:, at], code


#: Predictions that a worker remembers over its chunks, at most.
KNOWN_CELLS = 1 << 24


class _Scores:
    """Predictions of a model with one input changed, by own inputs and value put in, over
    all chunks that a worker meets; none are kept where there are more than KNOWN_CELLS."""

    def __init__(self, features: int):
        self.inputs: dict[bytes, int] = {}
        self.values: list[dict[float, int]] = [{} for _ in range(features)]
        self.tables: list[np.ndarray] = [np.empty((0, 0)) for _ in range(features)]

    @staticmethod
    def _numbers(known: dict, keys) -> np.ndarray:
        return np.array([known.setdefault(k, len(known)) for k in keys], np.int64)

    def of(self, own: np.ndarray, x: np.ndarray, score):
        """``(j, rows, values, which) -> predictions`` for one chunk: ``own`` are the bits
        of its inputs, ``values`` the different values of feature j, ``which`` the one put
        into a row."""
        most = [len(k) + len(np.unique(v)) for k, v in zip(self.values, x.T, strict=True)]
        if (len(self.inputs) + own.shape[1]) * max(1, sum(most)) > 4 * KNOWN_CELLS:
            return lambda j, rows, values, which: score(j, rows, values[which])
        at = self._numbers(self.inputs, (c.tobytes() for c in np.ascontiguousarray(own.T)))

        def run(j: int, rows: np.ndarray, values: np.ndarray, which: np.ndarray) -> np.ndarray:
            column = self._numbers(self.values[j], values.tolist())
            shape = (len(self.inputs), len(self.values[j]))
            table = self.tables[j]
            if table.shape != shape:
                if sum(t.size for t in self.tables) - table.size + shape[0] * shape[1] > KNOWN_CELLS:
                    return score(j, rows, values[which])
                grown = np.full(shape, np.nan)
                grown[:table.shape[0], :table.shape[1]] = table
                self.tables[j] = table = grown
            cell = at[rows] * shape[1] + column[which]
            got = table.reshape(-1)[cell]
            miss = np.flatnonzero(np.isnan(got))
            if len(miss):
                got[miss] = score(j, rows[miss], values[which[miss]])
                table.reshape(-1)[cell[miss]] = got[miss]
            return got

        return run


_scores: dict[str, _Scores] = {}


def _scores_of(model: str, features: int) -> _Scores:
    """What this worker remembers of a model, one at a time."""
    if model not in _scores:
        _scores.clear()
        _scores[model] = _Scores(features)
    return _scores[model]


def model_permutation_importance(df: DataFrame, key: str, features: Sequence[str], target: str,
                                 predict, method: str, n_repeats: int = SETTINGS.permutation_repeats,
                                 seed: int = SETTINGS.seed, carry: Sequence[str] | None = None,
                                 derive=None, swapped=None) -> DataFrame:
    """I1 + I2 for a fitted model: ``predict(matrix) -> predictions`` is a
    numpy function of the feature matrix (columns in ``features`` order), applied in
    tasks to the permuted copies: rows with equal own inputs and equal values put in share
    one evaluation, over the repeats of a chunk of ranks and over the chunks that a worker
    meets, as far as it can remember them. Where all features
    follow from a few columns, ``carry`` names these and ``derive`` is the numpy
    function to the features. ``swapped(matrix)`` may give a function ``(j, rows,
    values) -> predictions`` that evaluates one changed feature at less cost.
    Per-(repeat, feature) squared errors are partial sums; the baseline is one more
    pass. What the repeats shuffle is many times the table, so on large tables they are taken
    a few at a time, and the shuffle of the last ones goes before the next."""
    import pandas as pd

    from rugosa.session import drop_shuffles, ship_package

    ship_package(df.sparkSession)
    feats = list(features)
    moved = feats if carry is None else list(carry)
    derive = derive or (lambda x: x)

    def one_changed(x: np.ndarray):
        def run(j, rows, values):
            changed = x[rows]
            changed[:, j] = values
            return predict(changed)
        return run

    make = swapped or one_changed
    token = uuid.uuid4().hex

    def plain(bits: np.ndarray) -> np.ndarray:
        return np.where(bits == _NULL, np.nan, bits.view(np.float64))

    def meet(own, y, donors):
        n, y = len(y), plain(y)
        inputs, code = _distinct(np.concatenate([own, *donors], axis=1))
        x = derive(plain(inputs).T)
        at, mine = np.unique(code[:n], return_inverse=True)
        mine, given = mine.ravel().astype(np.int64), code[n:].reshape(len(donors), n)
        from rugosa.operators.importance import _scores_of   # the worker's own, not a copy

        score = _scores_of(token, x.shape[1]).of(inputs[:, at], x, make(x[at]))
        out = []   # repeats are numbered from 0 in every round
        for j in range(x.shape[1]):
            values, of = np.unique(x[:, j], return_inverse=True)
            pair = mine[None, :] * len(values) + of.ravel()[given]
            cells = len(at) * len(values)
            if cells <= VALUE_CELLS:
                met = np.zeros(cells, bool)
                met[pair] = True
                asked = np.flatnonzero(met)
                got = np.empty(cells)
                got[asked] = score(j, asked // len(values), values, asked % len(values))
                got = got[pair]
            else:
                asked, where = np.unique(pair, return_inverse=True)
                got = score(j, asked // len(values), values, asked % len(values))[where.reshape(pair.shape)]
            se = ((got - y[None, :]) ** 2).sum(axis=1)
            out += [(r, j, float(se[r]), n) for r in range(len(donors))]
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["rep", "feat", "se", "n"])

    def base_score(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = pdf[moved].to_numpy(np.float64)
            u, inv = np.unique(x, axis=0, return_inverse=True)
            err = (predict(derive(u))[inv.ravel()] - pdf[target].to_numpy(np.float64)) ** 2
            yield pd.DataFrame({"se": [float(err.sum())], "n": [len(err)]})

    spark = df.sparkSession
    base, total = df.select(*moved, target).mapInPandas(base_score, "se double, n long").agg(
        (F.sum("se") / F.sum("n")).alias("b"), F.sum("n").alias("n")).first()
    rounds = 1 if (total or 0) <= WHOLE_ROWS else -(-n_repeats // REPEATS_AT_ONCE)
    rows = []
    for some in np.array_split(np.arange(n_repeats), rounds):
        drop_shuffles(spark)
        chunks = aligned_chunks(df, key, moved, target, meet, "rep int, feat int, se double, n long", some.tolist(), seed, MODEL_CHUNK_RANKS)
        got = chunks.groupBy("rep", "feat").agg((F.sum("se") / F.sum("n")).alias("mse")).collect()
        rows += [(int(some[r["rep"]]), r["feat"], method, None if base is None or r["mse"] is None else r["mse"] - base) for r in got]
        del chunks, got
    drop_shuffles(spark)
    return _summarise(spark.createDataFrame(rows, "rep int, feat int, method string, d double"), feats)


# --------------------------------------------------------------------------
# feature -> base-variable mapping (I4) and normalisation
# --------------------------------------------------------------------------

def lineage_mapping(features: Sequence[str], bases: Sequence[str] = BASE_INPUTS) -> list[tuple[str, str]]:
    """A feature counts toward every base variable it is built from (by
    name tokens: ``Vc_Fz_ratio`` -> Vc, Fz; ``Vc/ap`` -> Vc, ap)."""
    pairs = []
    for f in features:
        tokens = set(f.replace("/", "_").replace("^", "_").replace(" ", "_").split("_"))
        for b in bases:
            if b in tokens or f"{b}2" in tokens or f == b:
                pairs.append((f, b))
    return pairs


def literal_mapping(features: Sequence[str], bases: Sequence[str] = BASE_INPUTS) -> list[tuple[str, str]]:
    """The substring rule as the reference codes it: features are renamed
    ``x0..x{n-1}``; base i takes every feature whose generated name contains
    its own name or ``x{i}`` (so ``x1`` also catches ``x10`` and ``x11``)."""
    gen = [f"x{i}" for i in range(len(features))]
    pairs = []
    for i, b in enumerate(bases):
        for f, g in zip(features, gen):
            if b in g or f"x{i}" in g:
                pairs.append((f, b))
    return pairs


def group_importance(imp: DataFrame, mapping: Sequence[tuple[str, str]],
                     bases: Sequence[str] = BASE_INPUTS) -> DataFrame:
    """I4 + I5: ``(method, variable, importance, std)``: the sum of the mapped
    features' importances and the mean of their stds (no feature -> 0). One aggregate,
    so that what ``imp`` costs is paid once."""
    of = {b: [f for f, v in mapping if v == b] for b in bases}
    per_method = imp.groupBy("method").agg(*[
        agg(F.when(F.col("feature").isin(of[b]), F.col(c))).alias(f"_{c}{i}")
        for i, b in enumerate(bases) for c, agg in (("importance", F.sum), ("std", F.avg))])
    return per_method.select("method", F.inline(F.array(*[
        F.struct(F.lit(b).alias("variable"), F.coalesce(f"_importance{i}", F.lit(0.0)).alias("importance"),
                 F.coalesce(f"_std{i}", F.lit(0.0)).alias("std")) for i, b in enumerate(bases)])))


def normalize_importance(grouped: DataFrame, only_positive: bool = True) -> DataFrame:
    """Divide by the per-method sum. ``only_positive`` keeps raw values
    when the sum is not positive; otherwise a zero sum gives zeros."""
    w = Window.partitionBy("method")
    tot = F.sum("importance").over(w)
    if only_positive:
        val = F.when(tot > 0, F.col("importance") / tot).otherwise(F.col("importance"))
    else:
        val = F.when(tot != 0, F.col("importance") / tot).otherwise(F.lit(0.0))
    return grouped.withColumn("importance", val)


def importance_table(normalized: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Variable x method (one column per method)."""
    return normalized.groupBy("variable").pivot("method", list(methods)).agg(F.first("importance"))


def sensitivity_mean(normalized: DataFrame) -> DataFrame:
    """Mean importance over methods, per variable."""
    return normalized.groupBy("variable").agg(F.avg("importance").alias("mean_importance"))
