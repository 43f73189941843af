"""Secret scan: fixed patterns, and character Markov models for the rest.

Base spans come from three patterns (``assign``, ``access``, ``hex``). Further
candidates are runs of at least ``MIN_RUN`` characters of secret alphabets
outside base spans (a run that a base span cuts is judged piece by piece); one is a secret (kind ``random``) when its character
transitions are likelier under a Markov model of random strings than under one
of ordinary identifiers, by a log-likelihood ratio of at least ``THRESHOLD``.

Both models are trained from labelled samples: strings that the base patterns
caught, and other words and identifiers, of a bounded sample of documents
(``TRAIN_DOCS``, those with the smallest id hashes). A run without a letter is a
number, and no candidate. The driver gets one row per
pair of characters and label. Everything runs as DataFrame functions.

Positions: ``regexp_extract_all`` anchored at the end of the last match gives
the gap before each match and the match, and their running lengths are the
spans, in code points.

Defined results: a null text is scanned as empty; without any labelled string of
a class its model is uniform; repeated rows are scanned alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group that holds the secret, least length of that group.
PATTERNS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: Patterns that match wherever a match of the pattern above is long enough, and seldom else.
HINTS = [PATTERNS[0][1], r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}"]
METHOD = "random"
#: Characters that the models know; others end a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 16
#: Documents that training reads, about (bound of the sample).
TRAIN_DOCS = 4000
#: Log odds that the transitions of a secret must show.
THRESHOLD = 10.0
#: Added to the count of every transition.
SMOOTH = 0.5

RUN = f"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
WORD = r"[A-Za-z][A-Za-z0-9_-]{4,}"
SPAN = "struct<start:bigint,order:int,kind:string,end:bigint,value:string>"


def _spans(text: Column, kind: str, order: int, pattern: str, hint: str, group: int, least: int) -> Column:
    """Sorted spans of all matches whose ``group`` is long enough."""
    anchored = F.lit(rf"\G(?s)(.*?)({pattern})")
    gaps = F.regexp_extract_all(text, anchored, F.lit(1))
    found = F.regexp_extract_all(text, anchored, F.lit(2))
    value = F.regexp_extract_all(text, anchored, F.lit(2 + group)) if group else found
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
    # the running end of what was read so far travels with the spans
    step = F.aggregate(
        zipped,
        F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["found"])).cast("long").alias("at"),
            F.when(
                F.length(x["value"]) >= least,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["gap"])).cast("long").alias("start"),
                            F.lit(order).alias("order"),
                            F.lit(kind).alias("kind"),
                            (acc["at"] + F.length(x["gap"]) + F.length(x["found"])).cast("long").alias("end"),
                            x["value"].alias("value"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return F.when(text.rlike(hint), step["spans"]).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text, and an array of spans per base kind."""
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    for order, ((kind, pattern, group, least), hint) in enumerate(zip(PATTERNS, HINTS, strict=True)):
        out = out.withColumn(kind, _spans(F.col("text"), kind, order, pattern, hint, group, least))
    return out


def labelled_strings(docs: DataFrame) -> DataFrame:
    """``string, random``: what base patterns caught, and other words."""
    based = with_base(docs)
    base = F.concat(*[F.col(k) for k, *_ in PATTERNS])
    caught = based.select(F.explode(F.transform(base, lambda s: s["value"])).alias("string"), F.lit(True).alias("random"))
    # words begin with a letter, so numbers train neither model
    rest = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    secret = F.transform(base, lambda s: s["value"])
    words = based.select(F.explode(F.array_except(rest, secret)).alias("string"), F.lit(False).alias("random"))
    # a word that is part of a caught value (its hex run, say) is no identifier
    return caught.unionByName(words.where(f"not string rlike '{HINTS[2]}|{HINTS[1]}'"))


def transition_counts(strings: DataFrame) -> DataFrame:
    """``random, pair, n`` over two-character transitions inside the alphabet."""
    pairs = strings.where("length(string) > 1").select(
        "random", F.explode(F.expr("transform(sequence(1, length(string) - 1), i -> substring(string, i, 2))")).alias("pair")
    )
    return pairs.where(F.length(F.translate("pair", ALPHABET, "")) == 0).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(counts: dict[tuple[bool, str], int]) -> list[float]:
    """Log likelihood ratio of each transition, by number of first and second character."""
    size = len(ALPHABET)

    def model(random: bool) -> list[float]:
        out = []
        for a in ALPHABET:
            row = [counts.get((random, a + b), 0) + SMOOTH for b in ALPHABET]
            out += [math.log(x / sum(row)) for x in row]
        return out

    if not counts:
        return [0.0] * size * size
    return [r - o for r, o in zip(model(True), model(False), strict=True)]


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> list[float]:
    total = docs.count()
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    some = docs.where(chance < min(1.0, max_docs / max(1, total)))
    # at most two rows per pair of alphabet characters
    found = transition_counts(labelled_strings(some)).collect()
    return log_ratios({(r["random"], r["pair"]): r["n"] for r in found})


def ratio(value: Column, ratios: list[float]) -> Column:
    """Sum of the log ratios of a string's transitions."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded into one constant
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    inside = lambda s: F.when((s >= 0), F.get(table, s.cast("int"))).otherwise(F.lit(0.0))
    return F.aggregate(
        codes,
        F.struct(F.lit(-1).cast("int").alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(
            c.cast("int").alias("last"), (acc["sum"] + inside(F.when(acc["last"] >= 0, acc["last"] * size + c).otherwise(-1))).alias("sum")
        ),
    )["sum"]


def _outside(run: Column, base: Column) -> Column:
    """The pieces of a run that no base span covers and that are long enough."""
    over = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    starts = F.array_distinct(F.concat(F.array(run["start"]), F.transform(over, lambda b: b["end"])))
    free = F.filter(starts, lambda x: (x < run["end"]) & ~F.exists(over, lambda b: (b["start"] <= x) & (x < b["end"])))

    def piece(x: Column) -> Column:
        next_ = F.array_min(F.transform(F.filter(over, lambda b: b["start"] >= x), lambda b: b["start"]))
        end = F.least(run["end"], F.coalesce(next_, run["end"]))
        value = run["value"].substr((x - run["start"] + 1).cast("int"), (end - x).cast("int"))
        return F.struct(x.alias("start"), run["order"].alias("order"), run["kind"].alias("kind"), end.alias("end"), value.alias("value"))

    pieces = F.filter(F.transform(free, piece), lambda p: p["end"] - p["start"] >= MIN_RUN)
    return F.when(F.size(over) == 0, F.array(run)).otherwise(pieces)


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, an array of spans per base kind, and ``random``, the method's."""
    rows = with_base(docs)
    rows = rows.withColumn("_run", _spans(F.col("text"), METHOD, len(PATTERNS), RUN, RUN, 0, MIN_RUN))
    base = F.concat(*[F.col(k) for k, *_ in PATTERNS])
    rows = rows.withColumn("_fresh", F.flatten(F.transform("_run", lambda r: _outside(r, base))))
    # a number alone is no secret
    random = F.filter("_fresh", lambda r: r["value"].rlike("[A-Za-z]") & (ratio(r["value"], ratios) >= threshold))
    return rows.select("doc_id", *[k for k, *_ in PATTERNS], random.alias(METHOD))


def digest(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """Counts per base kind, digest of base spans, and all spans as text."""
    found = scan(docs, train(docs) if ratios is None else ratios)
    kinds = [k for k, *_ in PATTERNS]

    def listed(*columns: str) -> Column:
        return F.array_join(
            F.transform(
                F.array_sort(F.concat(*[F.col(c) for c in columns])),
                lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(listed(*kinds), 256).alias("base_sha256"),
        listed(*kinds, METHOD).alias("spans"),
    )
