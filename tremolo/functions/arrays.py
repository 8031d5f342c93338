"""Signal operators on array columns: higher-order functions, which stay inside the JVM, and recursions by Arrow batch.

Recursions over records longer than one array are folds: :mod:`tremolo.operators.picker` runs them per gap-free run.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 2.2250738585072014e-308  # the least normal number: a long average that is never zero

def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it in its lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def demean(x: Column) -> Column:
    return let(x, lambda y: let(mean(y), lambda m: F.transform(y, lambda v: v - m)))


def line(x: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line over t = (i + 1) / n."""
    n = F.size(x).cast("double")
    t_mean = (n + 1) / (2 * n)
    sxy = F.aggregate(F.transform(x, lambda v, i: v * ((i + 1) / n - t_mean)), F.lit(0.0).cast("double"), lambda a, v: a + v)
    sxx = (n * n - 1) / (12 * n)
    slope = F.when(sxx > 0, sxy / sxx).otherwise(F.lit(0.0))
    return slope, mean(x) - slope * t_mean


def detrend(x: Column) -> Column:
    def without(y):
        slope, intercept = line(y)
        fit = F.struct(slope.alias("slope"), intercept.alias("intercept"), F.size(y).cast("double").alias("n"))
        return let(fit, lambda p: F.transform(y, lambda v, i: v - (p["slope"] * ((i + 1) / p["n"]) + p["intercept"])))

    return let(x, without)


def taper(x: Column, share: float = 0.05) -> Column:
    """Halves of a Hann window over the first and last ``share`` of the samples."""
    n = F.size(x)
    k = F.floor(n * F.lit(share)).cast("int")

    def weight(i):
        edge = F.when(i < k, i).when(i >= n - k, n - 1 - i)
        return F.when(edge.isNull() | (k < 1), F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * edge / (2 * k - 1)))

    return F.transform(x, lambda v, i: v * weight(i))  # cheap per sample: sizes and comparisons


def standardize(x: Column, least: float = 1e-12) -> Column:
    def scaled(y):
        m = mean(y)
        var = F.aggregate(y, F.lit(0.0).cast("double"), lambda a, v: a + v * v) / F.size(y) - m * m
        sd = F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(least))
        return let(F.struct(m.alias("m"), sd.alias("sd")), lambda p: F.transform(y, lambda v: (v - p["m"]) / p["sd"]))

    return let(x, scaled)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0).cast("double"), lambda a, v: a + v) / F.size(x))


def asinh_scale(x: Column, scale: Column) -> Column:
    return let(scale, lambda s: F.transform(x, lambda v: F.asinh(v / s)))


def by_matrix(x: Column, f) -> Column:
    """``f`` of many rows' samples at once: for every length in an Arrow batch a matrix of (rows, samples) in and out. What
    depends on the sample before is then a loop over columns, of a cost that grows with the samples alone. Null arrays stay
    null, null samples become NaN. Put the result into a column before another higher-order function takes it."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(s)
        for n, part in s.reset_index(drop=True).groupby(np.array([-1 if v is None else len(v) for v in s], int)):
            if n >= 0:
                for i, row in zip(part.index, f(np.array(part.tolist(), float).reshape(len(part), n)).tolist()):
                    out[i] = row
        return pd.Series(out, dtype=object)

    return run(x)


def prefix_sum(x: Column) -> Column:
    """Running sums."""
    return by_matrix(x, lambda m: np.cumsum(m, axis=1))


def integrate(differences: Column, first: Column, last: Column) -> Column:
    """Samples of first differences, whole numbers below 2^53, whose first entry is skipped; null where the last sample
    disagrees."""
    samples = prefix_sum(F.concat(F.array(first), F.slice(differences, 2, F.greatest(F.size(differences) - 1, F.lit(0)))).cast("array<double>")).cast("array<bigint>")
    return let(samples, lambda y: F.when(F.element_at(y, -1) == last, y))


Section = tuple[tuple[float, float, float], tuple[float, float]]


def cascade(x: np.ndarray, sections: list[Section], first: np.ndarray | float = 0.0) -> np.ndarray:
    """Rows of a matrix through second-order sections after each other, in transposed direct form. ``first`` is the level
    that every row is taken to have had before; 0 is rest."""
    level = np.broadcast_to(np.asarray(first, float), len(x))
    for (b0, b1, b2), (a1, a2) in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        p, q, y = level * (gain - b0), level * (b2 - a2 * gain), np.empty_like(x)
        for k in range(x.shape[1]):
            v = x[:, k]
            y[:, k] = v * b0 + p
            p, q = v * b1 - y[:, k] * a1 + q, v * b2 - y[:, k] * a2
        x, level = y, level * gain
    return x


def biquads(x: Column, sections: list[Section]) -> Column:
    """Samples through second-order sections, from rest."""
    return by_matrix(x, lambda m: cascade(m, sections))


def butterworth(kind: str, corner: float, rate: float) -> list[Section]:
    """Two sections of a fourth-order low or high pass, by the bilinear transform with a prewarped corner."""
    k = math.tan(math.pi * corner / rate)
    out = []
    for i in (0, 1):
        q = 1 / (2 * math.cos(math.pi * (2 * i + 1) / 8))
        norm = 1 / (1 + k / q + k * k)
        if kind == "low":
            b = (k * k * norm, 2 * k * k * norm, k * k * norm)
        else:
            b = (norm, -2 * norm, norm)
        out.append((b, (2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm)))
    return out


def both_ways(m: np.ndarray, sections: list[Section], pad: int) -> np.ndarray:
    """Rows forward and backward, over odd extensions of ``pad`` samples at both ends (fewer where there are fewer)."""
    k = min(pad, max(0, m.shape[1] - 1))
    y = np.concatenate([2 * m[:, :1] - m[:, k:0:-1], m, 2 * m[:, -1:] - m[:, -2 : -k - 2 : -1]], axis=1) if k else m
    for _ in range(2):
        y = cascade(y, sections, y[:, 0] if y.shape[1] else 0.0)[:, ::-1]
    return y[:, k : k + m.shape[1]]


def filtfilt(x: Column, sections: list[Section], pad: int) -> Column:
    """Samples without a shift: forward and backward."""
    return by_matrix(x, lambda m: both_ways(m, sections, pad))


def condition(x: Column, sections: list[Section], pad: int, share: float = 0.05) -> Column:
    """The conditioning chain in one pass: line, mean, taper, ``filtfilt``, unit deviation."""

    def chain(m):
        n = m.shape[1]
        if n < 2:
            return np.zeros_like(m)
        t = np.arange(1, n + 1) / n
        t -= t.mean()
        m = m - m.mean(1, keepdims=True)
        m = m - np.outer(m @ t / (t @ t), t)
        k = int(n * share)
        edge = np.minimum(np.arange(n), np.arange(n)[::-1])
        weight = np.where(edge < k, 0.5 - 0.5 * np.cos(2 * np.pi * edge / max(1, 2 * k - 1)), 1.0)
        y = both_ways((m - m.mean(1, keepdims=True)) * weight, sections, pad)
        sd = np.sqrt(np.maximum((y * y).mean(1) - y.mean(1) ** 2, 0.0))
        return (y - y.mean(1, keepdims=True)) / np.maximum(sd, 1e-12)[:, None]

    return by_matrix(x, chain)


def sta_lta(energy: Column, n_sta: int, n_lta: int) -> Column:
    """Recursive short over long average of an energy from the second sample on, 0 for the first ``n_lta`` samples."""

    def ratios(m):
        s, long, out = np.zeros(len(m)), np.full(len(m), LEAST), np.zeros_like(m)
        for k in range(1, m.shape[1]):
            s, long = m[:, k] / n_sta + s * (1 - 1 / n_sta), m[:, k] / n_lta + long * (1 - 1 / n_lta)
            if k >= n_lta:
                out[:, k] = s / long
        return out

    return by_matrix(energy, ratios)


def displacement(x: Column, sections: list[Section], rate: float) -> Column:
    """High pass from the first sample on, running sum over the rate, high pass."""
    return by_matrix(x, lambda m: cascade(np.cumsum(cascade(m - m[:, :1], sections), axis=1) / rate, sections))


def convolve(x: Column, kernel: tuple[float, ...], bias: float) -> Column:
    """Products of a kernel with every place, with zeros beyond the ends."""
    half = len(kernel) // 2
    at = lambda y, i: F.coalesce(F.get(y, i), F.lit(0.0))
    return let(x, lambda y: F.transform(y, lambda v, i: sum((at(y, i + (k - half)) * w for k, w in enumerate(kernel)), F.lit(bias))))


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Weighted sums, one for each row of weights."""
    rows = [F.aggregate(F.zip_with(x, F.lit(w), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v) + b for w, b in zip(weights, bias)]
    return F.array(*rows)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.transform(x, lambda v: 1 / (1 + F.exp(-v)))


def layer_norm(x: Column, gain: float, offset: float, least: float = 1e-5) -> Column:
    def scaled(y):
        m = mean(y)
        var = F.aggregate(y, F.lit(0.0).cast("double"), lambda a, v: a + v * v) / F.size(y) - m * m
        return let(F.struct(m.alias("m"), F.sqrt(var + least).alias("sd")), lambda p: F.transform(y, lambda v: (v - p["m"]) / p["sd"] * gain + offset))

    return let(x, scaled)


def attend(query: Column, keys: Column, values: Column, width: int) -> Column:
    """Mean of the values, weighted by the softmax of the query's products with the keys over the root of ``width``."""
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    weight = F.transform(keys, lambda k: F.exp(product(query, k) / math.sqrt(width)))
    mixed = lambda w: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.zip_with(w, values, lambda p, v: p * F.get(v, i)), F.lit(0.0), lambda s, v: s + v) / total(w))
    return let(weight, mixed)


def lstm(tokens: Column, weights: list[list[float]], recurrent: list[list[float]], bias: list[float]) -> Column:
    """Outputs of a long short-term memory for every token. Rows of the weights are gates of all units in the order input,
    forget, cell, output."""
    h = len(bias) // 4
    start = F.struct(*[F.array_repeat(F.lit(0.0), h).alias(n) for n in ("y", "c")], F.array().cast("array<array<double>>").alias("out"))

    def step(s, x):
        pre = F.zip_with(dense(x, weights, bias), dense(s["y"], recurrent, [0.0] * len(bias)), lambda a, b: a + b)
        unit = F.sequence(F.lit(0), F.lit(h - 1))
        logistic = lambda v: 1 / (1 + F.exp(-v))

        def with_gates(g):
            c = F.transform(unit, lambda i: logistic(F.get(g, i + h)) * F.get(s["c"], i) + logistic(F.get(g, i)) * F.tanh(F.get(g, i + 2 * h)))

            def with_cell(c):
                y = F.transform(unit, lambda i: logistic(F.get(g, i + 3 * h)) * F.tanh(F.get(c, i)))
                return let(y, lambda y: F.struct(y.alias("y"), c.alias("c"), F.concat(s["out"], F.array(y)).alias("out")))

            return let(c, with_cell)

        return let(pre, with_gates)

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def bilstm(tokens: Column, forward: tuple, backward: tuple) -> Column:
    """Outputs of two memories, one from the last token to the first, side by side."""
    return F.zip_with(lstm(tokens, *forward), F.reverse(lstm(F.reverse(tokens), *backward)), lambda a, b: F.concat(a, b))
