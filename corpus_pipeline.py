"""The corpus pipeline: five stages of the training-data operators, each over all that the one before kept.

Rows are told apart by their place, so in every stage a null identifier is a row like any other, rows
that repeat are judged one by one, and rows of one identifier may hold different texts. Further columns
are kept up to the last stage; an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from marlow.llm.queries import tokenizer_path
from marlow.llm.store import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A null or empty text has the score of a document without passages; without labels of both classes
    nothing is told apart, and all or none are kept by the share of good labels (all where there are none).
    """
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, net)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group with equal normalised texts: the longest, then the smallest identifier; null and empty texts are equal."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a shingle similarity of 0.8 or more: the smallest identifier; rows without a word all stay."""
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; without items, or with none long enough, all stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to; a null or empty text has no ids."""
    return bpe.bpe_both(docs, tokenizer_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontaminate", benchmark_leaks),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the similarity join and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
