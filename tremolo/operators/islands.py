"""Runs, gaps and sets of intervals by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_intervals(spans: DataFrame, low: str, high: str, on: list[str] | None = None, slack: int = 0) -> DataFrame:
    """Union of intervals per key: ``low``, ``high`` and how many it is made of. Touching ones are joined."""
    on = on or []
    w = W.partitionBy(*on).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col(low) <= before + F.lit(slack), 0).otherwise(1)
    island = F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = spans.withColumn("__new", new).withColumn("__island", island)
    return marked.groupBy(*on, "__island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("pieces")).drop("__island")


def coverage(spans: DataFrame, low: str, high: str, on: list[str], width: int) -> DataFrame:
    """Length and number of merged intervals per key: ``covered`` and ``spans``. Touching ones are joined; rows without
    a start or an end count for nothing.

    Rows are ordered inside time buckets of ``width`` only. What reaches into a bucket is the furthest end of those
    before it, from one row per key and bucket, so a task holds a bucket of a key and not the whole key.
    """
    bucket = F.floor(F.col(low) / width).cast("long")
    known = spans.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    rows = known.select(F.struct(*on).alias("key"), bucket.alias("bucket"), F.col(low).alias("low"), F.col(high).alias("high"))
    ends = rows.groupBy("key", "bucket").agg(F.max("high").alias("end"))
    reach = F.max("end").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    here = rows.join(ends.select("key", "bucket", reach.alias("reach")), ["key", "bucket"])
    inside = F.max("high").over(W.partitionBy("key", "bucket").orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1))
    here = here.withColumn("before", F.greatest(inside, "reach"))
    added = F.greatest(F.col("high") - F.greatest("low", "before"), F.lit(0))
    new = F.when(F.col("low") <= F.col("before"), 0).otherwise(1)
    return here.groupBy("key").agg(F.sum(added).alias("covered"), F.sum(new).alias("spans")).select("key.*", "covered", "spans")


def complement(points: DataFrame, at: str, guard: int, least: int, on: list[str] | None = None) -> DataFrame:
    """Quiet spans between consecutive points: ``guard`` away from both, at least ``least`` long."""
    on = on or []
    following = F.lead(at).over(W.partitionBy(*on).orderBy(at))
    quiet = points.select(*on, (F.col(at) + guard).alias("low"), (following - guard).alias("high"))
    return quiet.where(F.col("high") - F.col("low") >= least)


def gaps(records: DataFrame, start: str, end: str, on: list[str], least: int = 0) -> DataFrame:
    """Gaps between a channel's records in start order: (keys, gap_start, gap_end) of more than ``least``."""
    following = F.lead(start).over(W.partitionBy(*on).orderBy(start, end))
    return records.select(*on, F.col(end).alias("gap_start"), following.alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") > least)


def arrival_gaps(records: DataFrame, start: str, end: str, order: list[str], on: list[str]) -> DataFrame:
    """Records in arrival order with ``front`` (the furthest end before), ``stale`` (nothing new in it) and ``gap``
    (samples missing between the front and its start): a reorder buffer that waits for nothing."""
    before = F.max(end).over(W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return (
        records.withColumn("front", before)
        .withColumn("stale", F.coalesce(F.col(end) <= F.col("front"), F.lit(False)))
        .withColumn("gap", F.when(F.col(start) > F.col("front"), F.col(start) - F.col("front")).otherwise(F.lit(0)))
    )


def runs(df: DataFrame, flag: Column, order: list[str], on: list[str]) -> DataFrame:
    """Rows inside runs of consecutive true flags, with ``run`` (number of the run in its key)."""
    w = W.partitionBy(*on).orderBy(*order)
    marked = df.withColumn("__flag", flag)
    start = F.when(F.col("__flag") & ~F.coalesce(F.lag("__flag").over(w), F.lit(False)), 1).otherwise(0)
    marked = marked.withColumn("__start", start).withColumn("run", F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where("__flag").drop("__flag", "__start")


def hysteresis(df: DataFrame, value: str, on_level: float, off_level: float, order: list[str], on: list[str]) -> DataFrame:
    """Rows that fire: the first at or above ``on_level`` since the last below ``off_level`` (or since the start)."""
    w = W.partitionBy(*on).orderBy(*order)
    event = F.when(F.col(value) >= on_level, F.lit("on")).when(F.col(value) < off_level, F.lit("off"))
    last = F.last("__event", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__event", event).withColumn("__last", last)
    return marked.where((F.col("__event") == "on") & (F.coalesce("__last", F.lit("off")) == "off")).drop("__event", "__last")


def persistence_runs(df: DataFrame, value: str, level: float, instant: float, least: int, order: list[str], on: list[str]) -> DataFrame:
    """Runs of values >= ``level`` that last ``least`` rows or hold a value >= ``instant``: one row per run."""
    r = runs(df, F.col(value) >= level, order, on)
    first = order[0]
    per = r.groupBy(*on, "run").agg(F.min(first).alias("first"), F.max(first).alias("last"), F.count("*").alias("n"), F.max(value).alias("peak"))
    return per.where((F.col("n") >= least) | (F.col("peak") >= instant))


def bursts(df: DataFrame, at: str, gap: int, on: list[str]) -> DataFrame:
    """Sessions whose rows follow within ``gap`` of the row before: start, end, n."""
    w = W.partitionBy(*on).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__burst", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*on, "__burst").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("__burst")
