"""Linear relations from values of which some are only upper bounds, by maximum likelihood over all rows.

With the inverse deviation and the coefficients divided by the deviation as parameters the likelihood has one maximum, and
Newton's steps find it. Each step is one Spark job: tasks return sums over their rows, of a size that depends on the number
of coefficients alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.operators.locate import log_normal_cdf


@dataclass
class Relation:
    coefficients: list[float]
    sigma: float
    rows: int
    censored: int
    steps: int
    converged: bool


def likelihood(x: np.ndarray, y: np.ndarray, censored: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log likelihood, its gradient and its second derivatives at ``at`` (scaled coefficients, inverse deviation), flat."""
    z = y * at[-1] - x @ at[:-1]
    d = np.column_stack([-x, y])  # of z
    cdf = log_normal_cdf(z)
    hazard = np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - cdf)
    value = np.where(censored, cdf, math.log(at[-1]) - 0.5 * z * z - 0.5 * math.log(2 * math.pi))
    first = np.where(censored, hazard, -z) * weight
    second = np.where(censored, -hazard * (z + hazard), -1.0) * weight
    gradient, curve = d.T @ first, (d * second[:, None]).T @ d
    seen = float(weight[~censored].sum())
    gradient[-1] += seen / at[-1]
    curve[-1, -1] -= seen / at[-1] ** 2
    return np.concatenate([[float(value @ weight), len(y), censored.sum()], gradient, curve.ravel()])


def fit_censored(df: DataFrame, y: str, features: list[str], censored: str, weight: str | None = None, most_steps: int = 40, tolerance: float = 1e-9) -> Relation:
    """``y`` as a linear function of ``features`` with normal errors; where ``censored``, ``y`` is an upper bound.

    Rows with a null are left out. A column of ones is a feature if there is to be a constant. Features that depend on each
    other give the solution of least norm. Needs an uncensored row."""
    p = len(features) + 1
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(y).cast("double").alias("y"), F.col(censored).cast("boolean").alias("c"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()

    def sums(at: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(3 + p + p * p)
            for b in batches:
                total += likelihood(b[[f"x{i}" for i in range(p - 1)]].to_numpy(), b["y"].to_numpy(), b["c"].to_numpy(bool), b["w"].to_numpy(), at)
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        found = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        return found.set_index("k")["v"].reindex(range(3 + p + p * p), fill_value=0.0).to_numpy()

    spread = rows.agg(F.stddev("y")).first()[0]
    at = np.zeros(p)
    at[-1] = 1 / spread if spread else 1.0
    now = sums(at)
    if now[1] == now[2]:
        raise ValueError("every value is an upper bound")
    for n in range(1, most_steps + 1):
        gradient, curve = now[3 : 3 + p], now[3 + p :].reshape(p, p)
        step = np.linalg.lstsq(-curve, gradient, rcond=1e-12)[0]
        if abs(float(gradient @ step)) < tolerance * max(1.0, now[1]):
            return _relation(at, now, n, True)
        size = 1.0 if step[-1] >= 0 else min(1.0, -0.9 * at[-1] / step[-1])  # the deviation stays positive
        while size > 1e-6 and (then := sums(at + size * step))[0] < now[0]:
            size /= 2
        if size <= 1e-6:
            break
        at, now = at + size * step, then
    return _relation(at, now, most_steps, False)


def _relation(at: np.ndarray, now: np.ndarray, steps: int, converged: bool) -> Relation:
    return Relation((at[:-1] / at[-1]).tolist(), float(1 / at[-1]), int(now[1]), int(now[2]), steps, converged)
