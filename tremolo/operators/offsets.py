"""Offsets between rows of two kinds that lie close in time: sums and order statistics over all pairs, of which none is made.

Rows are sorted inside spans of time, so that the pairs of a row within any offset are a slice of the others: its length
and its sums follow from two places and running sums. Work grows with the rows, whatever their density."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.sources.shared import staged

#: Length of a span, in times the tolerance; bounds of an order statistic that are looked at together.
SPANS, BOUNDS = 6, 16


def spans_of(base: DataFrame, rows: DataFrame, tolerance: int, on: str) -> DataFrame:
    """``base`` (at) and ``rows`` (``on``, at) as sorted lists by span of time and key, staged once: a row of ``base`` is in one
    span, others in all from which it can be reached."""
    width = SPANS * tolerance
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    listed = lambda name: F.array_sort(F.collect_list("at")).alias(name)
    b = base.where("at is not null").groupBy(bucket(F.col("at")).alias("span")).agg(listed("base"))
    r = rows.where("at is not null").withColumn("span", F.explode(F.sequence(bucket(F.col("at") - tolerance), bucket(F.col("at") + tolerance))))
    return staged(r.groupBy("span", on).agg(listed("rows")).join(b, "span").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "offsets")


def _by_span(spans: DataFrame, on: str, look: Callable, names: list[str], kinds: list[str]) -> DataFrame:
    """Columns ``names`` of every span and key from ``look(key, base, rows)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [(key, *look(key, np.asarray(base), np.asarray(rows))) for key, base, rows in zip(part[on], part["base"], part["rows"])]
            yield pd.DataFrame(out, columns=[on, *names])

    kind = spans.schema[on].dataType.simpleString()
    return spans.select(on, "base", "rows").mapInPandas(run, f"`{on}` {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _reached(base: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Of every row of ``base`` the number of rows at ``most`` or less from it."""
    return np.searchsorted(rows, base + most, side="right") - np.searchsorted(rows, base - most)


def sums(spans: DataFrame, on: str, tolerance: int, within: int) -> DataFrame:
    """By key, over the pairs within ``tolerance``: n, ``total`` and ``size`` (sums of offsets and of absolute ones, exact),
    ``square`` and ``inside`` (pairs within ``within``)."""

    def look(key, base, rows):
        start = base[0]
        base, rows = base - start, rows - start
        up = np.r_[0, np.cumsum(rows)]
        seconds = rows / 1e6
        up2 = np.r_[0.0, np.cumsum(seconds * seconds)]
        low, mid, high = np.searchsorted(rows, base - tolerance), np.searchsorted(rows, base), np.searchsorted(rows, base + tolerance, side="right")
        after, before = up[high] - up[mid] - (high - mid) * base, up[mid] - up[low] - (mid - low) * base
        b = base / 1e6
        square = (up2[high] - up2[low]) - 2 * b * (up[high] - up[low]) / 1e6 + (high - low) * b * b
        return int((high - low).sum()), int(after.sum() + before.sum()), int(after.sum() - before.sum()), float(square.sum()), int(_reached(base, rows, within).sum())

    names = ["n", "total", "size", "square", "inside"]
    each = _by_span(spans, on, look, names, ["bigint", "bigint", "bigint", "double", "bigint"])
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "size")]
    return each.groupBy(on).agg(F.sum("n").alias("n"), *whole, F.sum("square").alias("square"), F.sum("inside").alias("inside"))


def middle(spans: DataFrame, on: str, tolerance: int, counts: dict) -> dict:
    """By key the two middle absolute offsets (one twice where ``counts`` is odd), exact: bounds are drawn closer by counting
    the pairs below ``BOUNDS`` places between them. Only these counts, a few a key, come to the driver."""
    ranks = {(key, k): [-1, tolerance] for key, n in counts.items() for k in ((n - 1) // 2, n // 2)}
    while True:
        at = {}
        for (key, _), (low, high) in ranks.items():
            if high - low > 1:
                at.setdefault(key, set()).update(low + (high - low) * i // (BOUNDS + 1) for i in range(1, BOUNDS + 1))
        at = {key: sorted(x for x in places if x >= 0) for key, places in at.items()}
        if not at:
            return {key: (ranks[key, (n - 1) // 2][1], ranks[key, n // 2][1]) for key, n in counts.items()}

        def look(key, base, rows, at=at):
            return ([int(_reached(base, rows, x).sum()) for x in at.get(key, ())],)

        found = _by_span(spans, on, look, ["below"], ["array<bigint>"]).select(on, F.posexplode("below").alias("k", "n")).groupBy(on, "k").agg(F.sum("n").alias("n"))
        below = {(r[0], at[r[0]][r[1]]): r[2] for r in found.collect()}
        for (key, k), bounds in ranks.items():
            for x in at.get(key, ()):
                if bounds[0] < x < bounds[1]:
                    if below[key, x] <= k:
                        bounds[0] = x
                    else:
                        bounds[1] = x
