"""Registered queries of the text operators, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rugosa.llm.clustering_sql import centroid_clustering_sql
from rugosa.llm.common import read
from rugosa.llm.sql import url_filter_sql

#: The id that ends a document in token files.
END_ID = 2


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.near_duplicates import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.contamination import digest

    return digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.piece_bpe import digest_documents

    return digest_documents(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.token_files import token_files

    return token_files(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END_ID)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.line_dedup import report

    return report(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from rugosa.llm.rule_ensemble import classify

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = classify(read(spark, sf_dir, "documents"), labels.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.secret_scan import digest

    return digest(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.url_filter import filter_urls

    return filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.line_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from rugosa.llm.language_id import identify

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    out = identify(docs, docs.where(~held_out), tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.centroid_clustering import cluster

    return cluster(read(spark, sf_dir, "embeddings"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.repeated_bytes import digest

    return digest(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rugosa.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_decontamination": op2_decontamination,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_files": op4_token_files,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_repeated_bytes": op12_repeated_bytes,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op8_url_filter": url_filter_sql(),
    "op11_centroid_clustering": centroid_clustering_sql(),
}
