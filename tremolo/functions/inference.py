"""Exact tests of counts: small helpers for the few rows that an evaluation ends in."""

from __future__ import annotations

from math import comb, exp, lgamma, log, log1p


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction: its steps grow with the root of the counts."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out, m = d, 1
    while True:
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + top * d) or tiny), (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15 or m > 200_000:
            return min(1.0, front * out)
        m += 1


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    return 0.0 if k < 0 else 1.0 if k >= n else 1.0 - _beta_share(k + 1, n - k, p) if p * n < k else _beta_share(n - k, k + 1, 1 - p)


def mcnemar(b: int, c: int) -> float:
    """Two-sided exact p of ``b`` against ``c`` discordant pairs; 1 where there are none."""
    n = b + c
    if n > 1000:  # whole numbers of that many binary digits are slow
        return min(1.0, 2 * binomial_cdf(min(b, c), n, 0.5))
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def _root(f, low: float, high: float) -> float:
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) > 0 else (low, middle)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a proportion."""
    tail = (1 - level) / 2
    low = 0.0 if k == 0 else _root(lambda p: tail - binomial_cdf(n - k, n, 1 - p), 0.0, 1.0)
    high = 1.0 if k == n else _root(lambda p: binomial_cdf(k, n, p) - tail, 0.0, 1.0)
    return low, high


def poisson_ratio(a: int, hours_a: float, b: int, hours_b: float, level: float = 0.95) -> tuple[float, float, float, float]:
    """Ratio of two rates, its exact interval, and the two-sided p of equal rates, given the total count. The ratio is
    infinite without a count of ``b``, and not a number without any."""
    n, share = a + b, hours_a / (hours_a + hours_b)
    low, high = clopper_pearson(a, n, level) if n else (0.0, 1.0)
    to_ratio = lambda p: float("inf") if p >= 1 else p / (1 - p) * hours_b / hours_a
    tail = min(binomial_cdf(a, n, share), binomial_cdf(b, n, 1 - share)) if n else 0.5
    ratio = (a / hours_a) / (b / hours_b) if b else float("inf") if a else float("nan")
    return ratio, to_ratio(low), to_ratio(high), min(1.0, 2 * tail)
