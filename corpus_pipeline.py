"""The training-text pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns their tokens. Between stages the
documents are written to the shared folder and read back.

No single SQL statement expresses the fuzzy stages, so ``ORACLE_SQL`` is None;
the stages are tested against brute force.

Defined results: rows are told apart by doc_id (rows that repeat a doc_id are one
document and share its fate; a null doc_id counts as one more id); null and empty
texts fail the quality rules; an empty table passes through; columns besides
doc_id, text, source and n_chars are carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rugosa.llm.common import read, store
from rugosa.llm.contamination import hits
from rugosa.llm.line_dedup import without_repeated_lines
from rugosa.llm.line_rules import above_limit, measured, verdicts, without_boilerplate
from rugosa.llm.near_duplicates import near_duplicates
from rugosa.llm.piece_bpe import digest_documents
from rugosa.llm.queries import tokenizer


#: Ids that a broadcast may hold (8 bytes each); beyond, ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _only(docs: DataFrame, judged: DataFrame, verdict: Column) -> DataFrame:
    """The documents of which some row of ``judged`` has the verdict. The ids of the
    others are counted first: while they are few they are broadcast, and the texts
    stay where they are."""
    rest = judged.groupBy("doc_id").agg(F.max(verdict).alias("stays")).where("not stays").select("doc_id")
    rest = store(rest, "rejected")
    rest = F.broadcast(rest) if rest.count() <= BROADCAST_IDS else rest
    return docs.alias("d").join(rest.alias("r"), F.equal_null(F.col("d.doc_id").cast("long"), F.col("r.doc_id")), "left_anti")


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines
    (operator 9); n_chars follows the text."""
    base = store(measured(docs), "line-rules")
    gone = store(above_limit(base), "boilerplate")
    return _sized(without_boilerplate(_only(docs, verdicts(base, gone), F.col("kept")), gone))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another document, or an earlier line,
    holds too (operator 5); n_chars follows the text."""
    return _sized(without_repeated_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 1)."""
    return _only(docs, near_duplicates(docs), F.col("kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate (operator 2)."""
    return _only(docs, hits(docs, read(spark, sf_dir, "benchmark")), ~F.col("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text that
    they decode to (operator 3)."""
    return digest_documents(docs, tokenizer("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near),
    ("decontamination", clean),
    ("sentencepiece", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
