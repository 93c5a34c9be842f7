"""A corpus pipeline of training-data operators; each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rhoscape.llm import decontamination, language_id, near_dedup, piece_tokens, secret_scan
from rhoscape.llm.common import Lease, Scratch, table
from rhoscape.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty text, or no letter in it) go; all others stay, repeated rows as well."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays.

    Of rows with one doc_id one stays; rows with a null doc_id stay; texts without words have no duplicates.
    """
    return near_dedup.drop_duplicates(docs, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none; an empty benchmark drops nothing."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a placeholder and n_chars counted again; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text, a row a document; null texts count as empty."""
    return piece_tokens.encode_decode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("piece_tokens", encode_pieces),
]

#: Language models, MinHash and piece encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to shared storage and read by the next.

    A stage's intermediate tables and its input go once its output stands. Empty tables pass through; columns of any
    name are handed on by all stages but the last.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = Scratch(spark)
        with Lease(spark):
            docs = after.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.release()
        before = after
    before.leave()
    return STAGES[-1][1](spark, docs, sf_dir)
