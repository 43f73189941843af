"""Removal of repeated passages by a suffix array of many documents: every byte
that a 200-byte string covers, which starts somewhere else too, is removed.

Method. The Burrows-Wheeler transform and the common prefixes of a collection of
strings are built column by column (:func:`collection_repeats`): each round puts
one more symbol in front of every string, finds where the longer suffixes belong
from the transform of the round before, and reads and writes transform and common
prefixes in sequence. A suffix that shares 200 bytes with a neighbour in the final
order starts a repeated string.

At scale the collection is dealt out first, without losing a repeat:

* Every 200-byte window owns an *anchor*: the ``ANCHOR`` bytes in it whose hash is
  least, the leftmost of equals. It depends on the window alone, so equal windows
  own equal anchors at equal offsets. The windows of one anchor in a document are
  neighbours and form one *fragment*.
* Anchors are counted; those that occur once own no repeated window and are gone.
  Equal fragments of one anchor are counted once, with their number of places, so
  copies collapse before anything is compared.
* The different fragments of an anchor meet in one collection. The fragments of an
  anchor with more than ``GROUP`` of them are cut by the offset of the anchor in the
  window and meet by all the bytes that their windows share; at the finest cut that
  is the window itself. So no key gathers more than ``GROUP`` fragments.

The symbols of a collection are words of ``WORD`` bytes, numbered in byte order;
each fragment enters as ``WORD`` strings, one for each phase. The files that the
rounds read and write are arrays of one task, as a collection is bounded by
``COLLECTION`` bytes and one group; between steps tables lie in the shared folder.

Hashes are of 64 bits: two anchors that share a hash by chance are compared to no
effect. Fragments *of the same anchor* that share a 64-bit hash count as equal.

Defined results: null text is empty; texts under 200 bytes lose nothing; equal texts
and rows that repeat a doc_id are each other's copies and lose what they share
(all of it from 200 bytes on); a null doc_id is a row like any other; columns besides
doc_id and text are ignored; an empty table gives an empty result. A removed run
may end inside a character, since texts are bytes here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import id_text, release, store
from rugosa.session import ship_package

WINDOW = 200
#: Bytes of an anchor.
ANCHOR = 64
#: Different fragments that one anchor may bring into one collection.
GROUP = 256
#: Offsets of an anchor that share a cut of a crowded anchor's fragments.
CUT = 16
#: Bytes after which a collection is closed (at the end of a group).
COLLECTION = 60_000
WORD = 8
#: Bytes that are hashed at a time; positions in a block must fit its 20 bits.
BLOCK = 1 << 20
#: Bytes of removed runs that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_SPAN = WINDOW - ANCHOR + 1
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(BLOCK - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of all substrings of a block, from prefix sums of ``table[byte] *
    base^position`` (modulo 2^64) times the inverse power of the start."""

    def __init__(self):
        self.table = np.random.default_rng(12).integers(0, 2**64, 256, dtype=np.uint64)
        one = np.ones(1, np.uint64)
        powers = lambda b: np.cumprod(np.concatenate([one, np.full(BLOCK, np.uint64(b))]))
        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 2**64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[start])


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(key) - width + 1
    rows = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def fragments(hashes: _Hashes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts ``data[start:end]``: for every fragment the text's number, the
    position of the anchor in ``data``, the least and largest offset of the anchor in
    a window, the anchor's hash and the fragment's."""
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < WINDOW:
        return nothing
    sums = hashes.sums(data)
    n = len(data) - ANCHOR + 1
    at = np.arange(n)
    h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * hashes.down[:n])
    pick = (_least((h & ~_LOW) | at.astype(np.uint64), _SPAN) & _LOW).astype(np.int64)
    change = np.zeros(len(pick) + 1, np.int64)
    long = ends - starts >= WINDOW
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - WINDOW + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    first = valid.copy()
    first[1:] &= (pick[1:] != pick[:-1]) | ~valid[:-1]
    first[starts[long]] = True
    begin = np.flatnonzero(first)
    if not len(begin):
        return nothing
    of = np.searchsorted(starts, begin, "right") - 1   # texts of no bytes share a start with the next; the last of them owns it
    stop = np.minimum(np.append(begin[1:], len(pick)), ends[of] - WINDOW + 1)   # windows of a text are neighbours
    p = pick[begin]
    lo, hi = p - (stop - 1), p - begin
    f = _mix(hashes.of(sums, begin, stop - 1 + WINDOW) + (lo * 256 + hi).astype(np.uint64))
    return of, p, lo, hi, h[p], f


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each begins."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_ANCHORS = pa.schema([("digest", pa.binary()), ("place", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()), ("h", pa.int64()), ("f", pa.int64())])


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Blocks ``(from, to, [(row, from, to)])`` of at most BLOCK bytes. A text that
    is longer is cut so that every window lies in exactly one block."""
    begin, parts = 0, []
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        if b - a < WINDOW:
            continue
        while True:
            if parts and min(b, a + BLOCK) - begin > BLOCK:
                yield begin, parts[-1][2], parts
                parts = []
            if not parts:
                begin = a
            cut = min(b, a + BLOCK)
            parts.append((row, a, cut))
            if cut == b:
                break
            a = cut - WINDOW + 1
    if parts:
        yield begin, parts[-1][2], parts


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        data, offsets = _bytes_of(batch.column(1))
        for begin, end, parts in _blocks(offsets):
            # pieces of one text overlap, so each is handled in a block of its own
            rows, a, b = (np.array(x, np.int64) for x in zip(*parts, strict=True))
            of, p, lo, hi, h, f = fragments(hashes, data[begin:end], a - begin, b - begin)
            for i in range(0, len(p), 100_000):
                s = slice(i, i + 100_000)
                row = rows[of[s]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)).cast(pa.binary()), pa.array(p[s] + begin - offsets[row]), pa.array(lo[s].astype(np.int16)), pa.array(hi[s].astype(np.int16)), pa.array(h[s].view(np.int64)), pa.array(f[s].view(np.int64))],
                    schema=_ANCHORS,
                )


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable order of numbers; digits of 16 bits are sorted by counting."""
    low = np.argsort(symbols.astype(np.uint16), kind="stable")
    high = symbols >> 16
    return low[np.argsort(high[low].astype(np.uint16), kind="stable")] if high.any() else low


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _range_least(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least of ``values[after + 1 : to + 1]`` for ascending, disjoint or equal
    ranges of each symbol; taken from the end so that no gap is read."""
    if not len(after):
        return np.zeros(0, values.dtype)
    back = np.argsort(-after, kind="stable")
    pairs = np.column_stack([after[back] + 1, to[back] + 1]).ravel()
    padded = np.append(values, values[-1])
    out = np.empty(len(after), values.dtype)
    out[back] = np.minimum.reduceat(padded, pairs)[::2]
    return out


def collection_transform(strings: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of strings of symbols from 1 on (0 ends each; the
    ends are ordered as the strings are) and, for each suffix, the symbols that it
    shares with the one before (``depth`` at most), built column by column: round j
    puts the suffixes of length j where the transform of round j - 1 says."""
    m = len(strings)
    length = np.array([len(s) for s in strings])
    flat = np.concatenate(strings).astype(np.uint32) if m else np.zeros(0, np.uint32)
    end = np.cumsum(length)

    def before(which, j):
        """The symbol in front of the suffix of length j."""
        has = length[which] > j
        out = np.zeros(len(which), np.uint32)
        out[has] = flat[end[which[has]] - j - 1]
        return out

    which = np.arange(m)
    bwt, lcp, at = before(which, 0), np.zeros(m, np.uint8), which
    for j in range(1, int(length.max(initial=0)) + 1):
        keep = length[which] >= j
        which, at = which[keep], at[keep]
        order = _order(bwt)
        q = _inverse(order)[at]
        c = bwt[at]
        # the neighbours among the suffixes that get the same symbol in front
        left = order[np.maximum(q - 1, 0)]
        same_left = (q > 0) & (bwt[left] == c)
        right = order[np.minimum(q + 1, len(order) - 1)]
        same_right = (q + 1 < len(order)) & (bwt[right] == c)
        shared = np.zeros(len(at), np.uint8)
        shared[same_left] = np.minimum(_range_least(lcp, left[same_left], at[same_left]) + 1, depth)
        follows = np.minimum(_range_least(lcp, at[same_right], right[same_right]) + 1, depth)
        to = m + q - np.count_nonzero(bwt == 0)
        old = np.ones(len(bwt) + len(at), bool)
        old[to] = False
        grown, prefixes = np.empty(len(old), np.uint32), np.empty(len(old), np.uint8)
        grown[old], grown[to] = bwt, before(which, j)
        prefixes[old], prefixes[to] = lcp, shared
        prefixes[to[same_right] + 1] = follows
        bwt, lcp, at = grown, prefixes, to
    return bwt, lcp


def collection_repeats(texts: list[bytes]) -> list[np.ndarray]:
    """For each text (of WINDOW bytes at least) whether the window at each start has
    an equal elsewhere in the collection."""
    if len(texts) < 2:
        return [np.zeros(len(t) - WINDOW + 1, bool) for t in texts]
    data = np.frombuffer(b"".join(texts) + bytes(WORD), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    words = np.ndarray(len(data) - WORD, ">u8", data, 0, (1,)).astype(np.uint64)
    symbols = (np.unique(words, return_inverse=True)[1] + 1).astype(np.uint32)
    strings, starts = [], []
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        for phase in range(WORD):
            count = (n - phase) // WORD
            strings.append(symbols[b + phase : b + phase + count * WORD : WORD])
            starts.append(b + phase)
    depth = WINDOW // WORD
    bwt, lcp = collection_transform(strings, depth)
    # walk back through the transform: the place of every suffix, from the ends on
    nearest = np.maximum(lcp, np.append(lcp[1:], 0)) >= depth
    step = _inverse(_order(bwt)) + len(strings) - np.count_nonzero(bwt == 0)
    found = np.zeros(len(data), bool)
    length = np.array([len(s) for s in strings])
    start, at, which = np.array(starts), np.arange(len(strings)), np.arange(len(strings))
    for j in range(1, int(length.max()) + 1):
        keep = length[which] >= j
        which, at = which[keep], step[at[keep]]
        if j >= depth:
            hit = which[nearest[at]]
            found[start[hit] + (length[hit] - j) * WORD] = True
    return [found[b : b + n - WINDOW + 1] for b, n in zip(begin, size, strict=True)]


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of marks."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


_VERDICTS = pa.schema([("h", pa.binary()), ("f", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments (key, id, hi, body) sorted by key and id -> runs (key, id, a, b) of
    starts, counted from the anchor, whose window has an equal in the key's group.
    A fragment that was fetched twice is taken once."""
    group: list[tuple] = []
    open_: list[tuple] = []
    size = 0

    def close():
        found = collection_repeats([r[3] for r in open_])
        out = ([], [], [], [])
        for (key, ident, hi, _), marks in zip(open_, found, strict=True):
            for a, b in zip(*_runs(marks), strict=True):
                for column, value in zip(out, (key, ident, int(a) - hi, int(b) - hi), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _VERDICTS.types, strict=True)], schema=_VERDICTS)

    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and row[:2] == last[:2]:
                continue
            if last is not None and row[0] != last[0]:
                open_ += group
                size += sum(len(r[3]) for r in group)
                group = []
                if size > COLLECTION:
                    yield close()
                    open_, size = [], 0
            group.append(row)
            last = row
    open_ += group
    if open_:
        yield close()


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, hi, body), by key."""
    rows = rows.select("key", "id", "hi", "body").repartition("key").sortWithinPartitions("key", "id")
    return rows.mapInArrow(_judge, "key binary, id binary, a int, b int")


_CUT = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()), ("places", pa.int64()), ("crowd", pa.int64()), ("body", pa.binary())])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted fragments) -> the fragments' bytes."""
    for batch in batches:
        data, offsets = _bytes_of(batch.column(0))
        wanted = batch.column(1)
        of = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
        parts = wanted.flatten()
        place, lo, hi = (parts.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("place", "lo", "hi"))
        begin = offsets[of] + place - hi
        stop = offsets[of] + place - lo + WINDOW
        view = memoryview(data)
        for i in range(0, len(begin), 10_000):
            s = slice(i, i + 10_000)
            body = pa.array([bytes(view[x:y]) for x, y in zip(begin[s].tolist(), stop[s].tolist(), strict=True)], pa.binary())
            part = parts.slice(i, 10_000)
            yield pa.RecordBatch.from_arrays([part.field(n) for n in _CUT.names[:-1]] + [body], schema=_CUT)


_FINER = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("key", pa.binary()), ("id", pa.binary()), ("lo", pa.int16()), ("hi", pa.int16()), ("places", pa.int64()), ("body", pa.binary())])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of crowded anchors, cut by the offset of the anchor in the window.
    The key of a part is what every window with such an offset holds, whichever of
    the offsets a fragment has."""
    for batch in batches:
        out = tuple([] for _ in _FINER.names)
        for h, f, lo, hi, places, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for a in range(lo // CUT * CUT, hi + 1, CUT):
                low, high = max(a, lo), min(a + CUT - 1, hi)
                core = body[hi - a : hi - a - CUT + 1 + WINDOW]
                part = body[hi - high : hi - low + WINDOW]
                key = hashlib.md5(bytes([a]) + core).digest()
                ident = hashlib.md5(bytes([low, high]) + part).digest()
                for column, value in zip(out, (h, f, key, ident, low, high, places, part), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _FINER.types, strict=True)], schema=_FINER)


def _crowded(parts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Runs (id, a, b) of the fragments of crowded anchors; also the tables to release."""
    parts = store(parts, "repeats-parts")
    unique = parts.groupBy("key", "id").agg(F.sum("places").alias("places"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("body").alias("body"))
    unique = store(unique, "repeats-unique")
    crowd = unique.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"))
    rows = unique.join(crowd.where(F.col("crowd").between(2, GROUP)).select("key"), "key", "left_semi")
    runs = _judged(rows).select("id", "a", "b").unionByName(_throughout(unique.where("places > 1")))
    runs = parts.select(_name("h", "f").alias("of"), "id").join(runs, "id").select(F.col("of").alias("id"), "a", "b")
    # what is crowded even so is compared window by window
    single = parts.join(crowd.where(F.col("crowd") > GROUP).select("key"), "key", "left_semi")
    single = single.select(_name("h", "f").alias("id"), "key", "hi", "places", "body", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("o"))
    single = single.select("id", "o", "places", F.unhex(F.md5(F.concat("key", F.expr("substring(body, hi - o + 1, %d)" % WINDOW)))).alias("w"))
    again = single.groupBy("w", "o").agg(F.sum("places").alias("n")).where("n > 1").select("w", "o")
    single = single.join(again, ["w", "o"], "left_semi").select("id", (-F.col("o")).alias("a"), (-F.col("o")).alias("b"))
    return runs.unionByName(single), [parts, unique]


def _name(h: str, f: str):
    """(anchor, fragment) as 16 bytes."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (h, f))))


def _throughout(rows: DataFrame) -> DataFrame:
    """Runs of fragments that stand in several places: all of their windows."""
    return rows.select("id", (-F.col("hi")).cast("int").alias("a"), (-F.col("lo")).cast("int").alias("b"))


def _removed(docs: DataFrame) -> DataFrame:
    """(digest of a text, ranges of its bytes that repeated windows cover)."""
    ship_package(docs.sparkSession)
    texts = docs.select("digest", "text")
    anchors = texts.where(F.octet_length("text") >= WINDOW).mapInArrow(_anchor_rows, "digest binary, place long, lo short, hi short, h long, f long")
    anchors = store(anchors, "repeats-anchors")
    # both sides of the join lie in tables, so that adaptive execution may split a hot anchor
    often = store(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeats-often")
    places = store(anchors.join(often.hint("shuffle_hash"), "h", "left_semi"), "repeats-places")
    release(anchors)
    release(often)
    each = places.groupBy("h", "f").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("digest", "place", "lo", "hi")).alias("at"))
    each = store(each.select("h", "f", "places", "at.*"), "repeats-fragments")
    crowd = each.groupBy("h").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    wanted = each.join(crowd, "h").groupBy("digest").agg(F.collect_list(F.struct("h", "f", "lo", "hi", "places", "crowd", "place")).alias("wanted"))
    cut = texts.join(wanted, "digest").select("text", "wanted")
    cut = store(cut.mapInArrow(_cut_out, "h long, f long, lo short, hi short, places long, crowd long, body binary"), "repeats-bodies")
    used = [places, each, cut]
    few = cut.where(F.col("crowd") <= GROUP)
    few = few.select(F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("key"), _name("h", "f").alias("id"), "hi", "body")
    runs = _judged(few).select("id", "a", "b").unionByName(_throughout(each.where("places > 1").select(_name("h", "f").alias("id"), "lo", "hi")))
    many = cut.where(F.col("crowd") > GROUP)
    if not many.isEmpty():
        many = many.dropDuplicates(["h", "f"]).select("h", "f", "lo", "hi", "places", "body")
        more, tables = _crowded(many.mapInArrow(_finer, "h long, f long, key binary, id binary, lo short, hi short, places long, body binary"))
        runs = runs.unionByName(more)
        used += tables
    where = places.select(_name("h", "f").alias("id"), "digest", "place").join(runs, "id")
    covered = F.struct((F.col("place") + F.col("a")).alias("a"), (F.col("place") + F.col("b") + WINDOW).alias("b"))
    out = store(where.groupBy("digest").agg(F.collect_set(covered).alias("ranges")), "repeats-ranges")
    for table in used:
        release(table)
    return out


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _bytes_of(batch.column(1))
        ranges = batch.column(2).to_pylist()
        kept, spans = [], []
        for row, found in enumerate(ranges):
            text = data[offsets[row] : offsets[row + 1]]
            edges: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in found or ()):
                if edges and a <= edges[-1][1]:
                    edges[-1][1] = max(b, edges[-1][1])
                else:
                    edges.append([a, b])
            mask = np.ones(len(text), bool)
            for a, b in edges:
                mask[a:b] = False
            kept.append((text[mask] if edges else text).tobytes())
            spans.append([{"start": a, "end": b} for a, b in edges])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, _OUT.field("spans").type), pa.array(kept, pa.binary())], schema=_OUT
        )


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start and end of every run of
    bytes removed) and kept (the other bytes)."""
    docs = id_text(docs).withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    gone = _removed(docs)
    size = gone.agg(F.sum(F.size("ranges") * 32 + 64)).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    rows = docs.join(gone, "digest", "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(_take_out, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept."""
    rows = remove_repeats(docs)
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
