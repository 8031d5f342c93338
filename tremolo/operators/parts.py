"""Cuts of a key's time line where a fold remembers nothing, so that the parts are folded in parallel.

A fold with a memory of ``memory`` (a reorder buffer's patience, a trigger's dead time) has the same state after a
silence longer than that, whatever came before, but for the furthest end. Silences are looked for between buckets of
``width`` of the order of arrival: one row per key and bucket is windowed, never the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_parts(df: DataFrame, on: list[str], at: str, low: str, high: str, memory: int, width: int, part: str = "part", before: str = "before") -> DataFrame:
    """``df`` with the number of its ``part`` of the key and the furthest end ``before`` it (null in the first).

    ``at`` orders the rows (a number); ``low`` and ``high`` are a row's ends. A part begins with a bucket if every row
    from there on begins more than ``memory`` after the end of every row before. Null keys are a key; rows without
    an order or ends belong to the first part.
    """
    bucket = F.floor(F.col(at) / width).cast("long")
    whole = F.struct(*on)
    ends = df.where(F.col(at).isNotNull()).groupBy(whole.alias("__key"), bucket.alias("__bucket")).agg(F.min(low).alias("__low"), F.max(high).alias("__high"))
    order = W.partitionBy("__key").orderBy("__bucket")
    behind = F.max("__high").over(order.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.min("__low").over(order.rowsBetween(0, W.unboundedFollowing))
    ends = ends.withColumn("__behind", behind).withColumn("__new", F.coalesce(ahead - behind > memory, F.lit(False)).cast("int"))
    ends = ends.withColumn(part, F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    begin = F.first("__behind").over(W.partitionBy("__key", part).orderBy("__bucket"))
    ends = ends.select("__key", "__bucket", part, begin.alias(before))
    rows = df.withColumn("__key", whole).withColumn("__bucket", bucket)
    out = rows.join(ends, ["__key", "__bucket"], "left").drop("__key", "__bucket")
    return out.withColumn(part, F.coalesce(part, F.lit(0)).cast("long"))
