"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words, every window of ``WINDOW`` consecutive
words (or the whole of a shorter item) is a pattern, and each document's
normalised text is scanned once by the automaton of all patterns. Matches are
mapped back to words and to code-point offsets of the original text.

Words: A-Z lower-cased, then runs of characters other than ASCII ones that are
neither digits nor letters. In UTF-8 that is a byte table, so the scan runs
over bytes.

The patterns of a benchmark beyond ``BLOCK_CHARS`` are dealt into blocks of
items. Documents are then written once with a key for every row and scanned once
per block; a block's rows are on the driver, and its broadcast alive, only while it
is scanned. The hit words of a row are united by its key, so results do not depend
on the number of blocks.

Defined results: null or empty texts have no words and no hits; items without
words have no window; an empty benchmark leaves every document clean; every row is
judged by itself, also rows that share a doc_id or have none; extra columns are
ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import arrow_rows, id_text, store

#: Words of a window.
WINDOW = 13
#: Characters of patterns that one automaton holds at most (a larger single item is a block of its own).
BLOCK_CHARS = 8_000_000
#: A document is contaminated when this share of its words, or more, is hit (1/20).
SHARE = 20

_NORMAL = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: ``hits``: position, start and end of every hit word.
SCHEMA = "row long, doc_id long, n_words long, items array<string>, hits array<struct<at:int,start:long,end:long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    w = words(text)
    if not w:
        return []
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]


class Scanner:
    """The automaton of all windows of some (item_id, text) rows."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, own in owners.items():
            # one character per byte, with the spaces around it
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w), tuple(own)))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, sorted positions of hit words, items that occur."""
        w = words(text)
        if not w or not self.any:
            return len(w), np.zeros(0, dtype=np.int64), set()
        found = list(self.automaton.iter(f" {b' '.join(w).decode('latin-1')} "))
        if not found:
            return len(w), np.zeros(0, dtype=np.int64), set()
        sizes = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1
        ends = np.cumsum(sizes)  # offset of the space after each word
        last = np.searchsorted(ends, np.array([at for at, _ in found]))
        first = np.searchsorted(ends, np.array([at - n for at, (n, _) in found]), side="right")
        marks = np.zeros(len(w) + 1, dtype=np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, last + 1, -1)
        return len(w), np.flatnonzero(np.cumsum(marks[:-1]) > 0), {i for _, (_, own) in found for i in own}


def places(text: str, hit: np.ndarray) -> list[dict]:
    """Position and code-point span of the hit words in the original text."""
    wanted = set(hit.tolist())
    found = enumerate(_WORD.finditer(text))
    return [{"at": i, "start": m.start(), "end": m.end()} for i, m in found if i in wanted]


def _spans(hits: Column) -> Column:
    """Spans of runs of neighbouring words."""
    at = lambda i: F.get(hits, i)["at"]
    starts = F.filter(hits, lambda x, i: (i == 0) | (at(i - 1) != x["at"] - 1))
    ends = F.filter(hits, lambda x, i: (i == F.size(hits) - 1) | (at(i + 1) != x["at"] + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s["start"].alias("start"), e["end"].alias("end")))


def _blocks(benchmark: DataFrame) -> DataFrame:
    """Items with a block number; whole items, about BLOCK_CHARS patterns each."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    # a window is at most as long as the text between its first and last word:
    # WINDOW patterns cover each character
    cost = F.length("text") * WINDOW
    total = items.agg(F.sum(cost)).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_CHARS))
    return items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans, contaminated per document."""
    spark = docs.sparkSession
    blocked = store(_blocks(benchmark), "benchmark")
    blocks = [r[0] for r in blocked.select("_block").distinct().orderBy("_block").collect()] or [0]
    keyed = id_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if len(blocks) > 1:
        keyed = store(keyed, "keyed-documents")  # the keys stay as they are

    def scan(block):
        # bounded by BLOCK_CHARS, see _blocks
        rows = [(r["item_id"], r["text"]) for r in blocked.where(F.col("_block") == block).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def make():
            scanner = Scanner(shared.value, size)

            def fn(part):
                out = []
                for row, d, text in part:
                    n, hit, items = scanner.scan(text)
                    if not len(hit) and block != blocks[0]:
                        continue  # the first block tells of every row
                    out.append((row, d, n, sorted(items), places(text, hit) if len(hit) else []))
                return out

            return fn

        return arrow_rows(keyed, SCHEMA, "row doc_id n_words items hits".split(), make), shared

    if len(blocks) == 1:
        out, _ = scan(blocks[0])
    else:
        parts = []
        for block in blocks:
            part, shared = scan(block)
            parts.append(store(part, "block-hits"))
            shared.destroy()
        out = (
            reduce(DataFrame.unionByName, parts)
            .groupBy("row")
            .agg(
                F.max("doc_id").alias("doc_id"),
                F.max("n_words").alias("n_words"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            )
        )
    sized = out.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        _spans(F.col("hits")).alias("spans"),
    )
    return sized.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The per-document report with a digest of the item ids."""
    return hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
