"""Quality rules of a document, with cross-document line frequency per host.

Base rules count words, symbols, repeated lines and repeated three-word windows
of every whole text. The method then hashes each normalised line (A-Z
lower-cased, digits read as 0, white space collapsed), counts in how many
different documents of one host it stands, and removes the lines above the limit
(:func:`without_boilerplate`). A document that these lines make up, nearly whole,
is depleted and rejected; n_boilerplate_words counts the words removed.

Copies of a document are no evidence of boilerplate. What is counted is hence
not rows but different documents, told apart by a digest of the whole set of
their line hashes: exact copies, and those that differ in case, digits, white
space or the order of lines, count once; documents that differ in any other line
count each, however many lines of a template they share.

Counts are pre-aggregated before each shuffle; the join of lines with frequent
lines is one that adaptive execution splits at hot lines. The limit is a share
of the host's documents with a floor, so it behaves alike at every size.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; a null host is a host of its own (a table
without the host column is an error; ``host`` names another one); repeated rows are copies; an empty
table gives an empty result. Every row loses the lines that its own text holds,
whatever rows share its doc_id. ``quality_rules`` ignores extra columns,
``without_boilerplate`` keeps them as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import arrow_rows, free_name, quoted, store
from rugosa.session import ship_package

#: Fewest words of a document.
MIN_WORDS = 50
#: A line is boilerplate of its host above this share of the host's different documents (1/SHARE) ...
SHARE = 200
#: ... and in more of them than this.
FLOOR = 20
#: A document is depleted when boilerplate leaves less than this share of its words (in hundredths).
LEFT = 20

_LINE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_SYMBOLS = re.compile(r"[#*$%&|<>]")
COLUMNS = "doc_id host n_words word_chars n_symbols n_dup_lines n_repeat_words lines line_words".split()
SCHEMA = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<long>, line_words array<int>"
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def repeat_words(words: list) -> int:
    """Words inside three-word windows that stand twice or more in the list."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    size = len(number)
    pair = w[:-1] * size + w[1:]  # exact: texts have fewer than 2**31 words
    pair = np.unique(pair, return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * size + w[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    hit = np.zeros(len(words), dtype=bool)
    for i in range(3):
        hit[i : i + n] |= twice
    return int(hit.sum())


def line_key(words: list[bytes]) -> int:
    """Hash of a normalised line, given its words."""
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words).translate(_LINE)))


def without_lines(text: str, gone: set) -> str:
    """The text without the lines whose hash is in ``gone``."""
    kept = []
    for raw in text.split("\n"):
        own = raw.encode().split()
        if not own or line_key(own) not in gone:
            kept.append(raw)
    return "\n".join(kept)


def measure(text: str | None) -> tuple:
    """Base counts, and per distinct normalised line its hash and its words."""
    text = text or ""
    seen: set[bytes] = set()
    per_line: dict[int, int] = {}
    words: list[bytes] = []
    dup = 0
    data = text.encode()
    for raw in data.split(b"\n"):
        own = raw.split()  # cuts at \x09-\x0D and \x20 only
        if not own:
            continue
        if raw in seen:
            dup += 1
        seen.add(raw)
        words += own
        key = line_key(own)
        per_line[key] = per_line.get(key, 0) + len(own)
    # code points in words: bytes that start a character
    chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    return (
        len(words), chars, len(_SYMBOLS.findall(text)), dup, repeat_words(words), list(per_line), list(per_line.values()),
    )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base counts and line hashes of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.col("text").cast("string").alias("text"),
    )
    return arrow_rows(rows, SCHEMA, COLUMNS, lambda: lambda part: [(d, h, *measure(t)) for d, h, t in part])


def boilerplate(lines: DataFrame, share: int = SHARE, floor: int = FLOOR) -> DataFrame:
    """``host, line`` above the limit, from ``host, line, document`` rows."""
    # different documents of a host, copies counted once
    counted = lines.select("host", "line", "document").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = lines.select("host", "document").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    limit = (F.col("n") > floor) & (share * F.col("n") > F.col("total"))
    # hosts may be many; equal_null keeps the null host
    return counted.where(F.col("n") > floor).join(sizes, F.equal_null(counted["host"], sizes["host"])).where(limit).select(counted["host"], "line")


def above_limit(base: DataFrame, share: int = SHARE, floor: int = FLOOR) -> DataFrame:
    """``doc_id, host, gone``: hashes of the lines above the limit, for documents
    that hold any; from the rows of :func:`measured`."""
    lines = base.where("size(lines) > 0").select(
        "doc_id", "host", F.xxhash64(F.array_sort("lines")).alias("document"), F.explode("lines").alias("line")
    )
    frequent = boilerplate(lines, share, floor)
    found = lines.alias("l").join(
        frequent.alias("f"), (F.col("l.line") == F.col("f.line")) & F.equal_null(F.col("l.host"), F.col("f.host"))
    )
    # at most the lines above the limit of one host
    return found.select("l.doc_id", "l.host", "l.line").groupBy("doc_id", "host").agg(F.collect_set("line").alias("gone"))


def verdicts(base: DataFrame, gone: DataFrame, left: int = LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_boilerplate_words of every row
    of :func:`measured`, given the lines of :func:`above_limit`."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # the words of the row's own lines that go
    own = F.filter(F.arrays_zip("b.lines", "b.line_words"), lambda x: F.array_contains(F.col("p.gone"), x["lines"]))
    removed = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["line_words"])
    rows = base.alias("b").join(
        gone.alias("p"), F.equal_null(F.col("b.doc_id"), F.col("p.doc_id")) & F.equal_null(F.col("b.host"), F.col("p.host")), "left"
    )
    rows = rows.select("b.*", F.when(F.col("p.gone").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("n_boilerplate_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_boilerplate_words")) < left * F.col("n_words")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_boilerplate_words",
    )


def quality_rules(docs: DataFrame, host: str = "source", share: int = SHARE, floor: int = FLOOR, left: int = LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_boilerplate_words."""
    base = store(measured(docs, host), "line-rules")
    return verdicts(base, above_limit(base, share, floor), left)


def without_boilerplate(
    docs: DataFrame, gone: DataFrame | None = None, host: str = "source", share: int = SHARE, floor: int = FLOOR
) -> DataFrame:
    """The documents without the lines above the limit, all other columns as they
    were; a document that loses every line with a word is left out. ``gone`` may be
    given where :func:`above_limit` of these documents is known."""
    if gone is None:
        gone = above_limit(store(measured(docs, host), "line-rules"), share, floor)
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(text: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_lines(t, set(own)) for t, own in zip(text, lines, strict=True)], dtype=object)

    # other columns may have any name
    own = {c: F.col(f"d.{quoted(c)}") for c in docs.columns}
    new_text = free_name(docs, "text")
    text, some = own["text"].cast("string"), F.col("g.gone").isNotNull()
    joined = docs.alias("d").join(
        gone.alias("g"), F.equal_null(own["doc_id"].cast("long"), F.col("g.doc_id")) & F.equal_null(own[host].cast("string"), F.col("g.host")), "left"
    )
    # only texts that hold such a line travel to Python
    out = joined.select(*own.values(), cut(F.when(some, text), F.col("g.gone")).alias(new_text), some.alias(new_text + "_cut"))
    lost = F.col(new_text + "_cut") & F.col("text").rlike(r"[^\x20\x09-\x0D]") & ~F.col(new_text).rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(lost, F.lit(False)))
    new = F.when(F.col(new_text + "_cut"), F.col(new_text)).otherwise(F.col("text"))
    return out.select(*[new.alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns])
