"""Ordered folds over streams: the step functions of :mod:`tremolo.operators.fold` with their state kept by Spark.

Rows of a key are put in order inside each micro-batch and the state goes on in the next one. As in any stream, rows
that belong before a batch that is already done come too late to be sorted in; steps that mind look at the order
themselves (the reorder buffer does).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tremolo.sources.shared import shared_folder


def stateful(df: DataFrame, on: list[str], order: list[str], step: Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame | None]], schema: str) -> DataFrame:
    """``step(state, rows)`` for the rows of each key of a stream; returns state and output."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")  # of one key in one micro-batch
        state, out = step(pickle.loads(held.get[0]) if held.exists else None, rows)
        held.update((pickle.dumps(state),))
        if out is not None and len(out):
            yield out

    return df.groupBy(*on).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_table(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A table's files as a stream, at most ``files`` a micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path if "*" in path else path[:-1] + "[" + path[-1] + "]")


def replayed(df: DataFrame, order: str, pieces: int, name: str, close: DataFrame | None = None) -> DataFrame:
    """A table as a stream of ``pieces`` micro-batches in ``order`` (a number): its files are written one after another,
    and after them those of ``close``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    edges = df.stat.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.01) if pieces > 1 else []
    edges = [None, *sorted(set(edges)), None]
    for low, high in zip(edges, edges[1:]):
        piece = df.where((F.lit(low is None) | (F.col(order) > F.lit(low))) & (F.lit(high is None) | (F.col(order) <= F.lit(high))))
        piece.coalesce(1).write.mode("append").parquet(path)
    if close is not None:
        close.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """All that a stream gives for what is there now, through a file sink in the shared folder, read back as a table.
    With the ``path`` of a run before it goes on from there."""
    path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, rocks)  # typed state and timers need it
    try:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
