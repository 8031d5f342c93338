"""Rates of two detectors over the same windows: exact and resampled intervals of their ratio."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions import inference

#: P(X <= k) of the Poisson distribution with mean 1 for k = 0 to 7; more is a draw in ten million.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]

RATES = "hours double, a bigint, b bigint, a_per_day double, b_per_day double, ratio double, low double, high double, p double"


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [inference.poisson_ratio(int(a), h, int(b), h) if h > 0 else (float("nan"),) * 4 for a, b, h in zip(rows["a"], rows["b"], rows["hours"])]
        yield rows.assign(**{c: [x[k] for x in found] for k, c in enumerate(("ratio", "low", "high", "p"))})


def compare_rates(windows: DataFrame, on: list[str], resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """One row per group: counts and rates a day of both detectors, their ratio with its exact interval and the exact p of
    equal rates, and the resampled intervals of both rates and the ratio.

    ``windows``: ``on``, window, hours, a, b; rows of one window are added up first and null counts are none. A window's
    weight in a resample is a Poisson count from a hash of window and resample, the same for both detectors and in every
    run. A ratio over no alarm is infinite; a resample without any window in it is left out. An empty table gives no row.
    """
    w = windows.groupBy(*on, "window").agg(F.sum("hours").alias("hours"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in "ab"])
    total = w.groupBy(*on).agg(F.sum("hours").alias("hours"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    day = lambda c: F.try_divide(24 * F.col(c), F.col("hours").cast("double")).alias(f"{c}_per_day")
    total = total.withColumn("hours", F.coalesce(F.col("hours").cast("double"), F.lit(0.0))).select(*on, "hours", "a", "b", day("a"), day("b"))
    kinds = {f.name: f.dataType.simpleString() for f in total.schema.fields}
    exact = total.mapInPandas(_exact, ", ".join([*(f"`{c}` {kinds[c]}" for c in on), RATES]))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("window").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    weight = sum((u >= F.lit(p)).cast("int") for p in POISSON)
    drawn = w.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("k", weight).where("k > 0")
    sums = drawn.groupBy(*on, "draw").agg(*[F.sum(F.col("k") * F.col(c)).alias(c) for c in ("hours", "a", "b")]).where("hours > 0")
    ratio = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(F.lit(float("inf")))
    sums = sums.select(*on, day("a"), day("b"), ratio.alias("ratio"))
    at = lambda c, q: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.lit(q) * (F.count("*") - 1)) + 1).cast("int"))  # noqa: E731  a group has ``resamples`` rows at most
    tail = (1 - level) / 2
    boot = sums.groupBy(*on).agg(*[at(c, q).alias(f"{c}_{n}") for c in ("a_per_day", "b_per_day", "ratio") for n, q in (("low", tail), ("high", 1 - tail))])
    for c in on:
        boot = boot.withColumnRenamed(c, f"__{c}")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return exact.join(boot, same, "left").drop(*[f"__{c}" for c in on]) if on else exact.crossJoin(F.broadcast(boot))
