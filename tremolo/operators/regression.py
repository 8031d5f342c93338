"""Weighted least squares with one term per station, by aggregates.

The terms are eliminated station by station: what a station's rows say about the common coefficients is their weighted
covariance around the station's own means. The sums of these over all stations are one small matrix, whatever the number
of stations, and every station's term follows from its means. The terms add up to zero, the constant is what they left.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def station_fit(df: DataFrame, station: str, y: str, xs: list[str], weight: str | None = None) -> tuple[dict[str, float], DataFrame]:
    """Coefficients by name (``constant`` too) and one row per station: ``station``, n, term.

    Rows with a null or not finite number, a null station or a weight of zero or less take no part. Of columns that do
    not vary inside stations, or vary together, the solution of least length is taken. Without rows coefficients are
    NaN and there are no terms. Means are subtracted before products are summed, so that large values lose nothing.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(station).alias("station"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)], w.alias("w"))
    names = [f"x{i}" for i in range(len(xs))]
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (*names, "y", "w")])
    rows = rows.where(fine & (F.col("w") > 0) & F.col("station").isNotNull())
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m_{c}")
    means = rows.groupBy("station").agg(F.count("*").alias("n"), *[mean(c) for c in (*names, "y")])
    off = rows.join(means, "station").select("w", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in (*names, "y")])
    pairs = [(a, b) for i, a in enumerate(names) for b in (*names[i:], "y")]
    got = off.agg(*[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).first()
    if got[0] is None:
        solved = np.full(len(names), np.nan)
    else:
        solved = np.linalg.lstsq(_square(got, names), np.array([got[f"{a}_y"] for a in names]), rcond=None)[0]
    level = reduce(lambda a, b: a - b, [F.lit(float(c)) * F.col(f"m_{n}") for c, n in zip(solved, names)], F.col("m_y"))
    levels = means.select("station", "n", level.alias("level"))
    constant = levels.agg(F.avg("level")).first()[0]
    terms = levels.select(F.col("station").alias(station), "n", (F.col("level") - F.lit(constant)).alias("term"))
    return {"constant": float("nan") if constant is None else constant, **dict(zip(xs, map(float, solved)))}, terms


def _square(sums, names: list[str]) -> np.ndarray:
    out = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            out[i, j] = out[j, i] = sums[f"{a}_{b}"]
    return out
