"""The corpus pipeline: toxic documents, repeated lines, near-duplicates and benchmark leaks go; the rest is tokenised.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame; all but the
last return the columns of `documents`. `run` writes each stage's result as Parquet to the shared checkpoint folder
and reads it again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bpe, decontaminate, line_dedup, near_documents, toxicity
from fathom.llm.common import documents, scratch, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts have no hits, and rows are judged each by its own text."""
    small_batches(spark)
    return toxicity.clean(docs, toxicity.fitted(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents that lose all their words by it; null, empty and wordless texts stay."""
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id: 0.8 or more of five-word shingles shared.

    SimHash finds the near pairs, their shingles confirm them; an exact join finds those whose fingerprints lie too far apart.
    Null, empty and wordless texts are one group. Unlike texts of one id are documents of their own.
    """
    small_batches(spark)
    return near_documents.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and wordless texts hold none."""
    small_batches(spark)
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, for every row; a null text is empty."""
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("bpe", tokenise),
]

#: SQL can't express the learned model of the first stage; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
