"""Sinks: messages by tag, archives of records, digests of what was written."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_messages(df: DataFrame, path: str, tag: str) -> None:
    """Messages of every tag in its own folder. Spark's committer renames files when all tasks are done."""
    df.write.mode("errorifexists").partitionBy(tag).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def append_archive(df: DataFrame, path: str, column: str = "record") -> None:
    """Records as received, appended; the order inside a partition is kept."""
    df.select(column).write.mode("append").parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of every file at ``path``, for a provenance table beside the outputs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def dump_text(records: DataFrame) -> DataFrame:
    """One line a decoded record: station, start, rate, samples and what is wrong with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("station", "channel", "start_us", "rate", "n_samples", "encoding", "reason")))
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, r)).strip() for r in rows], pa.string())], ["line"])

    return records.mapInArrow(run, "line string")
