"""Token-id files: canonical length-limited Huffman codes from global counts.

1. Every text is encoded by the tokenizers library (distinct space-separated
   segments of a worker once; a segment begins at a single space between two
   characters that no pre-token of a byte-level vocabulary joins).
2. Ids are counted over all documents; package-merge gives optimal code
   lengths of at most ``MAX_BITS`` bits, and lengths alone fix the canonical
   code.
3. Each document becomes a byte-aligned run of code words with the bit offset
   of every ``STEP``-th id; documents are dealt by doc_id range, sorted, and
   packed into blocks of whole documents. A block is decoded without any other.
4. Decoding looks up ``MAX_BITS`` bits at a time in one table, for all
   checkpoints of a batch of blocks side by side.

A folder holds ``codebook`` (id, bits) and ``blocks`` (one row per block, in
ascending doc_id order through the part files).

Defined results: null and empty texts hold the end id alone; repeated rows with
one doc_id stay rows of their own, side by side; an empty table gives empty
files; extra columns are ignored; a null doc_id sorts first.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rugosa.llm.common import HEAD, SLICE_ROWS, Remembered, fresh_path, id_text, joined_values, learn_in_parts, release, store, worker_object
from rugosa.session import ship_package

#: Longest code word; one decoding table has 2**MAX_BITS entries.
MAX_BITS = 20
#: Ids between two checkpoints.
STEP = 1024
#: A block is closed when it holds this many ids.
BLOCK_IDS = 1 << 16
#: Blocks decoded side by side.
LANES = 128
#: Bytes of texts that are cut into segments at once, about.
TEXT_BYTES = 6 << 20
#: Bytes of segments and their ids that a worker remembers, at most.
CACHE_BYTES = 96 << 20

# A single space between two of these characters always starts a pre-token.
_SAFE = "!-~¡-¬®-ɏ"
_OTHER = re.compile(f"[^ {_SAFE}]")
_CUT = re.compile(f"(?<=[{_SAFE}]) (?=[{_SAFE}])")
#: Segments that one call of the library encodes as one text.
JOINED = 64


def plain(text: str) -> bool:
    """Whether every space of the text is safe to cut at."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return False
    return not any(f" {c}" in text or f"{c} " in text for c in set(_OTHER.findall(text)))


def segments(text: str) -> list[str]:
    """The text cut before safe single spaces; each later segment lost its space."""
    return text.split(" ") if plain(text) else _CUT.split(text)


def cut_texts(texts: list[str]) -> tuple[list[str], pa.ListArray]:
    """The first segment of each text, and its later ones; Arrow cuts the texts in which
    every space cuts."""
    if all(" " in t and plain(t) for t in texts):
        heads, _, tails = zip(*(t.partition(" ") for t in texts), strict=True) if texts else ((), (), ())
        return list(heads), pc.split_pattern(pa.array(tails, pa.string()), " ")
    cut = [segments(t) for t in texts]
    return [c[0] for c in cut], pa.array([c[1:] for c in cut], pa.list_(pa.string()))


class SegmentEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        # a byte-level vocabulary writes each byte as one character
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(added[i].encode()) if i in added else len(token)
        #: whether no added token begins with letters before a punctuation mark; no
        #: pre-token of a byte-level vocabulary joins the two
        self.in_parts = not any(HEAD.match(t.lstrip()) for t in added.values())
        self.known = Remembered(CACHE_BYTES)
        self.width = 4

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        kind = "I" if self.width == 4 else "H"
        return [array(kind, e.ids).tobytes() for e in got]

    def learn(self, fresh: list[str]) -> list[bytes]:
        """Ids of new segments."""
        return learn_in_parts(fresh, self.known, self.spaced, self.whole) if self.in_parts else self.spaced(fresh)

    def spaced(self, fresh: list[str]) -> list[bytes]:
        """Encode new segments, many in one text, and cut their ids apart: a
        byte-level vocabulary loses no byte, so byte lengths tell where."""
        spaced = [" " + s for s in fresh]
        data = b"".join(self.whole(["".join(spaced[i : i + JOINED]) for i in range(0, len(spaced), JOINED)]))
        read = np.cumsum(self.n_bytes[np.frombuffer(data, dtype=f"<u{self.width}")])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, spaced)), dtype=np.int64, count=len(spaced)))
        last = np.searchsorted(read, ends)
        if read[-1] != ends[-1] or (read[last] != ends).any():
            raise AssertionError("the tokenizer joined bytes of two segments")
        cuts = (last + 1) * self.width
        ends = cuts.tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str], width: int = 4) -> list[bytes]:
        if width != self.width:
            self.known, self.width = Remembered(CACHE_BYTES), width
        heads, later = cut_texts(texts)
        every, bounds = joined_values(later, self.known, self.learn, f"<u{width}")
        bounds = bounds.tolist()
        return [f + every[a:b].tobytes() for f, a, b in zip(self.whole(heads), bounds, bounds[1:], strict=False)]


def worker_encoder(tokenizer_file: str) -> SegmentEncoder:
    """The encoder of this Python worker; it outlives a task."""
    return worker_object((SegmentEncoder, tokenizer_file), lambda: SegmentEncoder(tokenizer_file))


def id_bytes(tokenizer_file: str, end_id: int) -> int:
    """Bytes that hold any id: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id + 1, Tokenizer.from_file(tokenizer_file).get_vocab_size()) <= 1 << 16 else 4


def text_slices(batch: pa.RecordBatch, most: int = 8 * SLICE_ROWS, n_bytes: int = TEXT_BYTES):
    """Parts of a batch (doc_id, text) of at most ``most`` rows; a part ends with the row
    that brings its texts to ``n_bytes``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < batch.num_rows:
        end = min(int(np.searchsorted(ends, done + n_bytes)) + 1, at + most, batch.num_rows)
        yield batch.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int, width: int = 4) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, ``width`` bytes each) of every
    document, with the end id."""
    ship_package(docs.sparkSession)

    def run(batches):
        encoder = worker_encoder(tokenizer_file)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        for batch in batches:
            for part in text_slices(batch):
                ids = [x + end for x in encoder.encode([t or "" for t in part.column(1).to_pylist()], width)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame, width: int) -> DataFrame:
    """id and its number of occurrences over all documents; a task sends at most
    one row per id of the vocabulary."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                data = b"".join(batch.column(0).slice(at, SLICE_ROWS).to_pylist())
                got = np.bincount(np.frombuffer(data, dtype=f"<u{width}"))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(weights: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits (package-merge)."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    rank = np.argsort(weights, kind="stable")
    leaves = weights[rank].astype(np.float64)
    levels = []  # per level, whether each item of the sorted list is a leaf
    items = leaves
    is_leaf = np.ones(n, dtype=bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        items, is_leaf = both[at], at < n
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, dtype=np.int64)
    out[rank] = lengths
    return out


class Codebook:
    """The canonical code that code lengths fix: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        at = np.lexsort((ids, bits))
        self.symbols, self.lengths = ids[at].astype(np.int64), bits[at].astype(np.int64)
        size = int(self.symbols.max()) + 1 if len(at) else 1
        self.bits = np.zeros(size, dtype=np.uint64)
        self.code = np.zeros(size, dtype=np.uint64)
        # a code word of b bits covers 2**(MAX_BITS-b) values of the next MAX_BITS bits
        spans = np.left_shift(1, MAX_BITS - self.lengths)
        starts = np.cumsum(spans) - spans
        self.bits[self.symbols] = self.lengths
        self.code[self.symbols] = starts >> (MAX_BITS - self.lengths)
        self.spans = spans

    def table(self) -> np.ndarray:
        """For each value of MAX_BITS bits: the symbol times 32, plus its bits."""
        out = np.zeros(1 << MAX_BITS, dtype=np.uint32)
        filled = np.repeat((self.symbols << 5 | self.lengths).astype(np.uint32), self.spans)
        out[: len(filled)] = filled
        return out

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Code words of documents of ``sizes`` ids each (at least one), every
        document from a byte of its own on, and the bit offsets of every STEP-th
        id of a document."""
        bits = self.bits[ids].astype(np.int64)
        ends = np.cumsum(bits)
        last = np.cumsum(sizes)
        doc_bits = np.diff(ends[last - 1], prepend=0)
        doc_bytes = (doc_bits + 7) // 8
        doc_end = np.cumsum(doc_bytes)
        # bits that alignment has put before each document
        shift = (doc_end - doc_bytes) * 8 - (np.cumsum(doc_bits) - doc_bits)
        inside = ends - bits + np.repeat(shift, sizes)
        word = inside >> 5
        placed = self.code[ids] << (64 - (inside & 31) - bits).astype(np.uint64)
        n_words = int(word[-1]) + 2
        # the bits of two ids never overlap, so sums below 2**32 are exact in doubles
        packed = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=n_words)
        packed += np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words)
        data = packed.astype(">u4").tobytes()
        payloads, points = [], []
        for a, b, first, n in zip((doc_end - doc_bytes).tolist(), doc_end.tolist(), (last - sizes).tolist(), sizes.tolist(), strict=True):
            payloads.append(data[a:b])
            points.append(inside[first : first + n : STEP] - 8 * a)
        return payloads, points


def decode_lanes(payload: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of all lanes, one after another. A lane starts at a checkpoint's bit
    offset in ``payload`` and holds ``counts`` ids, at most STEP."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    b = np.concatenate([payload, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    rows = np.zeros((int(counts.max()), len(starts)), dtype=np.uint32)
    last = len(window) - 1
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    for i in range(len(rows)):
        live = int(np.searchsorted(-left, -i, side="left"))  # lanes with more than i ids
        here = at[:live]
        value = window[np.minimum(here >> 3, last)] << (here & 7).astype(np.uint32)
        entry = table[value >> np.uint32(32 - MAX_BITS)]
        rows[i, :live] = entry >> np.uint32(5)
        here += entry & np.uint32(31)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    by_lane = rows.T[back]
    return by_lane[np.arange(len(rows)) < counts[:, None]]


BLOCKS = (
    "part int, part_start long, doc_ids array<long>, n_tokens array<long>, n_bytes array<long>, checkpoints array<long>, payload binary"
)


def write_files(tokens: DataFrame, path: str, width: int = 4) -> None:
    """Write ``codebook`` and ``blocks`` under ``path``, and delete ``tokens``, a
    stored table, as soon as it is coded. The driver holds one count per id of the
    vocabulary (bounded by MAX_BITS) and nothing else."""
    spark = tokens.sparkSession
    ship_package(spark)
    counted = count_ids(tokens, width).orderBy("id").collect()
    ids = np.array([r["id"] for r in counted], dtype=np.int64)
    bits = code_lengths(np.array([r["n"] for r in counted], dtype=np.int64))
    rows = [(int(i), int(b)) for i, b in zip(ids, bits, strict=True)]
    spark.createDataFrame(rows, "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((ids, bits))  # at most 2**MAX_BITS pairs

    def encode(batches):
        code = Codebook(*book.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                data = part.column(2).to_pylist()
                sizes = np.array([len(x) // width for x in data], dtype=np.int64)
                payloads, points = code.encode(np.frombuffer(b"".join(data), dtype=f"<u{width}"), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(points, pa.list_(pa.int64())),
                        pa.array(payloads, pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "checkpoints", "payload"],
                )

    def pack(batches):
        docs: list[tuple] = []
        held = done = 0
        part = TaskContext.get().partitionId()

        def block():
            ids, counts, points, payloads = zip(*docs, strict=True)
            sizes = [len(p) for p in payloads]
            starts = np.cumsum([0, *sizes[:-1]]) * 8
            offsets = np.concatenate([np.asarray(c, dtype=np.int64) + s for c, s in zip(points, starts, strict=True)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([done], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([b"".join(payloads)], pa.binary()),
                ],
                names=["part", "part_start", "doc_ids", "n_tokens", "n_bytes", "checkpoints", "payload"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs.append(row)
                held += row[1]
                if held >= BLOCK_IDS:
                    yield block()
                    done += held
                    docs, held = [], 0
        if docs:
            yield block()

    # stored, as dealing by range reads it twice
    coded = store(tokens.mapInArrow(encode, "doc_id long, n_tokens long, checkpoints array<long>, payload binary"), "token-codes")
    release(tokens)
    (
        coded.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(pack, BLOCKS)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/blocks")
    )
    release(coded)


def read_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (and
    the ids themselves) of every document."""
    ship_package(spark)
    book = spark.read.schema("id long, bits int").parquet(f"{path}/codebook").collect()  # at most 2**MAX_BITS rows
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # parts are doc_id ranges in order; a row per part reaches the driver
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before, total = {}, 0
    for r in sorted(sizes.collect()):
        before[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast(
        (np.array([r["id"] for r in book], dtype=np.int64), np.array([r["bits"] for r in book], dtype=np.int64), before)
    )
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if ids else 4]

    def run(batches):
        symbols, bits, base_of = shared.value
        table = Codebook(symbols, bits).table() if len(symbols) else None
        for batch in batches:
            for at in range(0, batch.num_rows, LANES):
                own = batch.slice(at, LANES)
                part, part_start, doc_ids, counts, _, points, payloads = (c.to_pylist() for c in own.columns)
                base = np.cumsum([0] + [len(p) for p in payloads[:-1]]) * 8
                starts = np.concatenate([np.asarray(p, dtype=np.int64) + b for p, b in zip(points, base, strict=True)])
                per_doc = np.concatenate([np.asarray(c, dtype=np.int64) for c in counts])
                lanes = -(-per_doc // STEP)
                per_lane = np.full(len(starts), STEP, dtype=np.int64)
                per_lane[np.cumsum(lanes) - 1] = per_doc - (lanes - 1) * STEP
                payload = np.frombuffer(b"".join(payloads), dtype=np.uint8)
                out = decode_lanes(payload, starts, per_lane, table).astype("<u4")
                ends = np.cumsum(per_doc)
                docs = [out[e - n : e] for e, n in zip(ends.tolist(), per_doc.tolist(), strict=True)]
                first = [base_of[p] + s + np.cumsum([0, *c[:-1]]) for p, s, c in zip(part, part_start, counts, strict=True)]
                cols = [
                    pa.array([d for x in doc_ids for d in x], pa.int64()),
                    pa.array(np.concatenate(first).astype(np.int64)),
                    pa.array(per_doc),
                    pa.array([zlib.crc32(x.tobytes()) for x in docs], pa.int64()),
                ]
                if ids:
                    cols.append(pa.array(docs, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return blocks.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encode, write and read back: doc_id, start, n_tokens, ids_crc32."""
    path = path or fresh_path(docs.sparkSession, "token-files")
    width = id_bytes(tokenizer_file, end_id)
    write_files(store(tokenise(docs, tokenizer_file, end_id, width), "tokens"), path, width)
    return read_files(docs.sparkSession, path)
