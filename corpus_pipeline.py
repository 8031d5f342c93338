"""A corpus pipeline of five stages, each one operator of ``tremolo.llm`` over all rows that the stage before kept.

Quality, near duplicates and decontamination remove rows, mixing repeats and removes them, and the last stage writes
what is left as token ids and returns one row per document read back from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremolo.llm import decontam, mixing, near, quality, tokens
from tremolo.llm.common import discard, stage, staging


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.fitted(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id."""
    return near.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as directly addressable codes and read back."""
    return tokens.token_table(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("mixing", mixed), ("token_ids", token_ids)]
#: SQL cannot express the classifier and the tokenizer: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents table. What a stage wrote for itself is removed when its result is
    written, and that result when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        with staging() as made:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            made[:] = [t for t in made if t is not docs]
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
