"""A corpus pipeline: five operators in turn, each stage written as Parquet and read again by the next.

language   documents whose language the context trees cannot determine go
lines      repeated lines go; documents of which nothing is left go
near       one document of each group of near-duplicates stays
mix        documents are held as often as their source's target weight asks
tokens     byte-level BPE ids and decoded text of what is left, as digests
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import langid, lines, mixing, near, triebpe
from sparquill.plans.stage import materialize, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnt = docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return langid.accepted(docs, langid.fit(learnt))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return triebpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", repeated_lines), ("near", near_copies), ("mix", mix), ("tokens", tokens)]

#: Context trees, SimHash, ProbMinHash and BPE are not for SQL; tests/llm holds each stage against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; the last one's result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
