"""Near-duplicate documents by b-bit MinHash and a multi-index Hamming join.

1. Shingles: five consecutive words, lower-cased A-Z, hashed to 64 bits; a
   document's signature holds ``CHUNKS * WIDTH`` positions, each the low 16
   bits of one MinHash.
2. Documents with equal shingle sets form one class, which has a number of its
   own: a doc_id may stand on rows of several classes.
3. Two classes whose signatures differ in at most ``2 * CHUNKS - 1`` positions
   differ in at most one position of some chunk (pigeonhole). Each class
   therefore files itself, for every chunk, under the chunk with each one
   position left out: every pair under the signature-distance threshold shares
   a key. At a Jaccard similarity of 0.85 a position differs with probability
   0.15, so a pair differs in more than 25 of 65 positions about once in a
   million.
4. Inside a key, a representative is compared with all members; the members that
   do not join its component are then compared with all others, chunk by chunk.
   Counts per hash block, without the shingles that one member alone holds, bound
   how much two sets share; pairs that cannot be similar are not made. No link
   between components is lost, and a hot key costs rows in proportion to its size
   as long as its members are alike.
5. A compared pair is kept when its signature distance is within the threshold
   and its full shingle sets confirm 100 * intersection >= 85 * union.

Defined results: a document without words (null or empty text) has no shingles
and is its own component; a shorter one is one shingle; repeated rows of a
doc_id share its class; extra columns are ignored; an empty table gives an empty
result; a null doc_id takes part only as a text: its row gets the component of
its class, and a null component if it is alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import SLICE_ROWS, drop_worker_object, id_text, possibly_among, release, store
from rugosa.llm.components import CHUNK, FULL, link_members, packed, shared_members
from rugosa.session import ship_package

#: Words of a shingle.
SHINGLE = 5
#: Least similarity in hundredths.
LEAST = 85
#: Chunks of the signature, and positions of a chunk.
CHUNKS, WIDTH = 13, 5
POSITIONS = CHUNKS * WIDTH
#: Pigeonhole: within this distance some chunk has at most one error.
DISTANCE = 2 * CHUNKS - 1
#: Hash blocks of the counts that bound how much two sets share.
BLOCKS = 32
#: Hashes whose holders a task counts at once, about.
COUNTED = 1 << 18
#: Words a worker remembers the hash of before it starts anew.
CACHE_WORDS = 400_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_STREAM = _mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * _ODD)
_XOR, _MUL = _STREAM[:POSITIONS], _STREAM[POSITIONS:] | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known = _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.split() cuts at \x09-\x0D and \x20, and at nothing else
        words = (text or "").encode().translate(_LOWER).split()
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        w = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=n)
        m = min(n, self.size)
        h = np.full(n - m + 1, m, dtype=np.uint64)
        for i in range(m):
            h = h * _ODD + w[i : n - m + 1 + i]
        return np.unique(_mix(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of POSITIONS 16-bit values for each non-empty set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = np.concatenate(sets)
    out = np.empty((len(sets), POSITIONS), dtype=np.uint16)
    for k in range(POSITIONS):
        out[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts).astype(np.uint16)
    return out


def sign(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (128 bits; a private one without
    shingles) and signature of every document."""
    ship_package(docs.sparkSession)

    def run(batches):
        drop_worker_object()
        shingler = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = part.column(0).to_pylist()
                sets = [shingler(t) for t in part.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(
                            [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else f"empty {d}".encode() for d, s in zip(ids, sets, strict=True)],
                            pa.binary(),
                        ),
                        pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_hash", "signature"],
                )

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, signature binary")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: the hash tells texts apart that share a doc_id."""
    return id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def index_keys(classes: DataFrame) -> DataFrame:
    """``key, id``: each chunk with each one position left out."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(n, POSITIONS)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in range(CHUNKS):
                chunk = sig[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
                for out in range(WIDTH):
                    key = np.full(n, c * WIDTH + out + 1, dtype=np.uint64)
                    for i in range(WIDTH):
                        if i != out:
                            key = _mix(key * _ODD + chunk[:, i])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures are within DISTANCE."""
    side = classes.select("id", "signature")
    both = pairs.join(side.toDF("a", "sig_a"), "a").join(side.toDF("b", "sig_b"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS) for i in (4, 5)
                )
                near = pa.array((a != b).sum(axis=1) <= DISTANCE)
                yield batch.select(["a", "b", "ca", "cb"]).filter(near)

    return both.select("a", "b", "ca", "cb", "sig_a", "sig_b").mapInArrow(run, "a long, b long, ca long, cb long")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Component edges of the pairs whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches):
        for batch in batches:
            ca, cb, sa, sb = (c.to_pylist() for c in batch.columns)
            u, v = [], []
            for x, y, p, q in zip(ca, cb, sa, sb, strict=True):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= least * (len(p) + len(q) - common):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.select("ca", "cb", "set_a", "set_b").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``id, set`` (sorted hashes) of the listed classes. Most texts of no class are
    left where they are: a filter of fixed size goes before the exact join."""

    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = [shingler(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    row = ["doc_id", "text_hash"]
    found = possibly_among(_hashed(docs), "text_hash", classes.select("text_hash"), "near-filter")
    wanted = found.join(classes.select("id", *row), row).dropDuplicates(row)
    return wanted.select("id", "text").mapInArrow(run, "id long, set binary")


def _as_set(member: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def held_profile(sets: DataFrame, elements: Callable[[int, object], np.ndarray] = _as_set) -> DataFrame:
    """``id, size, w0, ...``: elements of each set, and per hash block those that
    another set holds too. ``elements`` makes the hashes of a set from the id and the
    second column of ``sets`` (``id, set``); a third one, ``number``, names a set in
    the shuffle of all elements, where a small number takes less room than a hash."""
    number = sets.columns[2] if len(sets.columns) > 2 else "id"

    def run(batches):
        for batch in batches:
            sets, ids, held = [], [], 0
            for at, (i, s, own) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
                sets.append(elements(i, s).view(np.int64))
                ids.append(own)
                held += len(sets[-1])
                if held >= COUNTED or at == batch.num_rows:
                    # a hash goes on once for each run of sets, however many hold it
                    h, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
                    owner = np.repeat(np.array(ids, dtype=np.int64), list(map(len, sets)))[first]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(owner), pa.array(n.astype(np.int64))], names=["h", "number", "n"])
                    sets, ids, held = [], [], 0

    # dealt by hash first: hardly any row would be merged before the shuffle
    rows = sets.select("id", sets.columns[1], F.col(number).alias("number"))
    held = rows.mapInArrow(run, "h long, number long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n"), F.min("number").alias("number"))
    block = F.pmod(F.col("h"), F.lit(BLOCKS)).cast("int")
    own = held.where("n = 1").groupBy("number").agg(*[F.count(F.when(block == i, 1)).cast("int").alias(f"o{i}") for i in range(BLOCKS)])

    def count(batches):
        for batch in batches:
            ids, data, _ = (c.to_pylist() for c in batch.columns)
            rows = [np.bincount(elements(i, s).view(np.int64) % BLOCKS, minlength=BLOCKS).astype(np.int32) for i, s in zip(ids, data, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([int(r.sum()) for r in rows], pa.int64()), pa.array(rows, pa.list_(pa.int32())), batch.column(2)],
                names=["id", "size", "every", "number"],
            )

    sized = rows.mapInArrow(count, "id long, size long, every array<int>, number long")
    left = [F.col("every")[i] - F.coalesce(F.col(f"o{i}"), F.lit(0)) for i in range(BLOCKS)]
    return sized.join(own, "number", "left").select("id", "size", *packed(left))


def compared_in_chunks(left: DataFrame, right: DataFrame, n_words: int, least: int) -> DataFrame:
    """Like ``joined_pairs``: members are gathered in chunks of about CHUNK rows of
    a key, and each pair of chunks is compared as two small matrices."""
    columns = ["id", "component", "size", *[f"w{i}" for i in range(n_words)]]

    def chunked(df, prefix):
        chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).alias("chunk")
        rows = df.select("key", chunk, F.struct(*columns).alias("m")).groupBy("key", "chunk").agg(F.collect_list("m").alias("m"))
        return rows.select("key", *[F.col(f"m.{c}").alias(prefix + c) for c in columns])

    both = chunked(left, "l").join(chunked(right, "r"), "key").drop("key")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns]
                l, r = lists[: len(columns)], lists[len(columns) :]
                counts_l, counts_r = (np.stack(x[3:], axis=1).astype("<i8").view("<u2") for x in (l, r))
                for at in range(0, len(l[0]), 64):
                    own = slice(at, at + 64)
                    shared = np.minimum(counts_l[own, None, :], counts_r[None, :, :]).sum(axis=2, dtype=np.int64)
                    size_l, size_r = l[2][own, None], r[2][None, :]
                    near = ((100 + least) * shared >= least * (size_l + size_r)) | ((size_l > FULL) & (size_r > FULL))
                    a, b = np.nonzero(near & (l[1][own, None] != r[1][None, :]))
                    if len(a):
                        a = a + at
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x) for x in (l[0][a], l[1][a], r[0][b], r[1][b])], names=["id", "component", "pid", "pcomponent"]
                        )

    return both.mapInArrow(run, "id long, component long, pid long, pcomponent long")


def link_classes(docs: DataFrame, classes: DataFrame, least: int = LEAST, size: int = SHINGLE) -> DataFrame:
    """``id, component`` of every class (``id, doc_id, text_hash, signature``) that
    shares a key."""
    members = shared_members(index_keys(classes), "near")
    signed = store(classes.join(members.select("id").distinct(), "id", "left_semi"), "near-signed")
    sets = store(_sets(docs, signed, size), "near-sets")
    profile = store(held_profile(sets), "near-profile")
    linked = link_members(members, profile, BLOCKS // 4, least, lambda pairs: _confirmed(_near(pairs, signed), sets, least), "near", compared_in_chunks)
    for done in (members, signed, sets):
        release(done)
    return linked


def near_duplicates(docs: DataFrame, least: int = LEAST, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = store(sign(docs, size), "near-signatures")
    # the class of a null doc_id is represented by another document or by none
    classes = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.any_value("signature").alias("signature"))
    )
    classes = store(classes.select(F.monotonically_increasing_id().alias("id"), "set_hash", "row.*", "signature"), "near-classes")
    linked = link_classes(docs, classes, least, size)
    named = classes.select("id", "set_hash", "doc_id").join(linked, "id", "left")
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("first"))
    final = named.join(lowest, "component", "left").select("set_hash", F.coalesce("first", "doc_id").alias("component"))
    component = F.coalesce("component", "doc_id")
    return signed.join(final, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
