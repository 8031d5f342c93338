"""Ranks, quantiles and weights of unbounded groups: values are counted first, so a window sees distinct values only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.sources.shared import staged


def value_counts(df: DataFrame, value: str, on: list[str] | None = None) -> DataFrame:
    """Distinct values per key with ``n`` rows, ``below`` rows of smaller values and ``total``.

    Values are dealt into ranges of the order (keys, value), so that a key with very many distinct values, or a table
    without keys, is summed by many tasks: inside the ranges first, then over the ranges' totals. Counts are staged, so that
    ``df`` is read once."""
    on = on or []
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count("*").alias("n")), "counts")
    dealt = in_ranges(counts, [*on, value])
    inner = F.sum("n").over(W.partitionBy(*on, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    sums = dealt.groupBy(*on, "__range").agg(F.sum("n").alias("__n"))
    of_key = W.partitionBy(*on)
    before = F.coalesce(F.sum("__n").over(of_key.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("__range").alias("__r"), before.alias("__before"), F.sum("__n").over(of_key).alias("total"))
    same = F.col("__range") == F.col("__r")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return dealt.withColumn("__inner", inner).join(sums, same).select(*on, value, "n", (F.col("__inner") + F.col("__before")).alias("below"), "total")


def in_ranges(df: DataFrame, order: list[str], name: str = "__range") -> DataFrame:
    """``df`` with the number of the range of the order that each row lies in. The ranges' bounds come from a sample of
    rows whose size follows from the number of partitions, not of rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, df.count() // (50 * parts))
    sample = sorted(tuple(r) for r in df.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).dropna().collect())
    bounds = [sample[i] for i in range(len(sample) // parts, len(sample), max(1, len(sample) // parts))]
    kinds = [df.schema[c].dataType for c in order]
    here = F.struct(*order)
    literal = lambda b: F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in zip(order, b, kinds)])
    below = lambda array: F.size(F.filter(array, lambda b: b <= here))
    if not bounds:
        return df.withColumn(name, F.lit(0))
    # first the block of bounds, then the place in it: a row meets some of them only
    block = math.isqrt(len(bounds) - 1) + 1
    blocks = [F.array(*map(literal, bounds[i : i + block])) for i in range(0, len(bounds), block)]
    heads = below(F.array(*map(literal, bounds[::block])))
    return df.withColumn(name, F.when(heads == 0, 0).otherwise((heads - 1) * block + below(F.element_at(F.array(*blocks), F.greatest(heads, F.lit(1))))))


def interpolated(df: DataFrame, value: str, q: float, on: list[str] | None = None) -> DataFrame:
    """Quantiles between the two values around place ``q (n - 1)``, from counts of distinct values."""
    return interpolated_all(df, value, {"quantile": q}, on)


def interpolated_all(df: DataFrame, value: str, places: dict[str, float], on: list[str] | None = None) -> DataFrame:
    """Several quantiles by name, from the same counts: no group's values are held together."""
    return places_all(df, value, {name: (q, "between") for name, q in places.items()}, on)


def places_all(df: DataFrame, value: str, places: dict[str, tuple[float, str]], on: list[str] | None = None) -> DataFrame:
    """Several (q, way) by name, from the same counts: values at place ``q (n - 1)``, ``between`` the two around it, or at its
    ``floor`` or the nearest place, halves to ``even``."""
    on = on or []

    def quantile(q, way):
        at = F.lit(q) * (F.col("total") - 1)
        value_at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))
        if way != "between":
            return value_at(F.floor(at) if way == "floor" else F.bround(at).cast("long"))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        return low + (high - low) * F.max(at - F.floor(at))

    return value_counts(df, value, on).groupBy(*on).agg(*[quantile(*place).alias(name) for name, place in places.items()])


def mean_ranks(df: DataFrame, value: str, on: list[str] | None = None) -> DataFrame:
    """Distinct values with their rank; ties share the mean of their places."""
    return value_counts(df, value, on).withColumn("rank", F.col("below") + (F.col("n") + 1) / F.lit(2.0))


def quantile_at(df: DataFrame, value: str, q: float, on: list[str] | None = None, rounding: str = "floor") -> DataFrame:
    """The value at index ``floor(q (n - 1))`` of the sorted group (``rounding`` = even: to the nearest, halves to even)."""
    on = on or []
    at = F.lit(q) * (F.col("total") - 1)
    at = F.floor(at) if rounding == "floor" else F.bround(at).cast("long")
    return value_counts(df, value, on).where((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select(*on, F.col(value).alias("at_index"))


def weighted_median(df: DataFrame, value: str, weight: Column, on: list[str]) -> DataFrame:
    """The smallest value at which half of the weight is reached."""
    sums = df.groupBy(*on, value).agg(F.sum(weight).alias("__w"))
    reached = F.sum("__w").over(W.partitionBy(*on).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    marked = sums.withColumn("__reached", reached).withColumn("__all", F.sum("__w").over(W.partitionBy(*on)))
    return marked.where(F.col("__reached") * 2 >= F.col("__all")).groupBy(*on).agg(F.min(value).alias("weighted_median"))


def bands(x: Column, edges: list[float]) -> Column:
    """Number of the half-open band that ``x`` lies in: 0 below the first edge."""
    return sum(((x >= F.lit(e)).cast("int") for e in edges[1:]), (x >= F.lit(edges[0])).cast("int"))


def row_numbers(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Every row with its place, from 1, in the order of ``order`` (unique together), nulls first.

    Rows are dealt into ranges of the whole order, bounded by sampled rows, and numbered inside their range after the
    rows of the ranges before, so that no task holds all rows.
    """
    dealt = in_ranges(df, order)
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__range", before.alias("__before"))
    numbered = dealt.withColumn("__k", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return numbered.join(F.broadcast(counts), "__range").withColumn(name, (F.col("__k") + F.col("__before")).cast("long")).drop("__range", "__k", "__before")
