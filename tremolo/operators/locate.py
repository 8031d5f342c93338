"""Locating one source from a few stations' times and distances, and the size of it, as vectorised grids in numpy.

An event's observations are one small group (its stations); Spark deals the groups out and each is worked on by itself.
Grids are counted in whole steps: a coarse one around the stations' centre, then a fine one around its best node; of equal
nodes the first in order of latitude, then longitude, stands.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EARTH_KM = 6371.0
DEPTH, VP, VS, SIGMA_P = 10.0, 6.0, 3.5, 1.0
COARSE, FINE = (3.0, 0.05), (0.1, 0.005)  # half width and step, in degrees
ONE_SIGMA = 1.15  # of the misfit in two dimensions: 68 %


def km_between(lat: np.ndarray, lon: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """(nodes, stations) great-circle distances."""
    a, b, c, d = (np.radians(np.asarray(x, float)) for x in (lat, lon, lat2, lon2))
    h = np.sin((c[None] - a[:, None]) / 2) ** 2 + np.cos(a)[:, None] * np.cos(c)[None] * np.sin((d[None] - b[:, None]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


@dataclass
class Fit:
    lat: float
    lon: float
    origin: float
    rms: float
    error_km: float
    stations: int
    worst: int  # the station with the largest share of the misfit
    z: float = math.nan  # the largest deviation of a distance, in its standard deviations
    dropped: list = field(default_factory=list)


@dataclass
class Observations:
    """Times at stations, each with its wave speed, and distances with their uncertainty (infinite: none)."""

    lat: np.ndarray
    lon: np.ndarray
    station: np.ndarray
    time: np.ndarray
    speed: np.ndarray
    log_km: np.ndarray
    log_sd: np.ndarray

    def without(self, station) -> Observations:
        on = self.station != station
        return Observations(*(getattr(self, f)[on] for f in self.__dataclass_fields__))

    def parts(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, observations) shares of the misfit and residuals, and the origin of each node."""
        d = km_between(lat, lon, self.lat, self.lon)
        residual = self.time - np.hypot(d, DEPTH) / self.speed
        origin = residual.mean(1)
        residual = residual - origin[:, None]
        off = (np.log(np.maximum(d, 1.0)) - self.log_km) / self.log_sd
        return residual**2 / (2 * SIGMA_P**2) + off**2 / 2, residual, origin


def nodes(lat: float, lon: float, half: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    n = math.floor(2 * half / step + 1e-9) + 1
    at = np.arange(n) * step - half
    return np.repeat(lat + at, n), np.tile(lon + at, n)


def fit(o: Observations, least: int, coarse: tuple[float, float] = COARSE, fine: tuple[float, float] = FINE) -> Fit | None:
    """The best node, or None with fewer than ``least`` stations."""
    names = list(dict.fromkeys(o.station.tolist()))
    if len(names) < least:
        return None
    first = [o.station.tolist().index(s) for s in names]
    lat, lon = float(o.lat[first].mean()), float(o.lon[first].mean())
    wide = None
    for half, step in (coarse, fine):
        la, lo = nodes(lat, lon, half, step)
        j = o.parts(la, lo)[0].sum(1)
        k = int(np.argmin(j))
        if wide is None or j[k] < best:
            best, lat, lon = float(j[k]), float(la[k]), float(lo[k])
        wide = (la, lo, j) if wide is None else wide
    parts, residual, origin = o.parts(np.array([lat]), np.array([lon]))
    near = wide[2] <= parts.sum() + ONE_SIGMA
    cell = float(km_between(np.zeros(1), np.zeros(1), np.zeros(1), np.full(1, coarse[1]))[0, 0]) / 2
    error = max([cell, *km_between(wide[0][near], wide[1][near], np.array([lat]), np.array([lon]))[:, 0].tolist()])
    known = np.isfinite(o.log_sd)
    z = math.nan
    if known.any():
        d = km_between(np.array([lat]), np.array([lon]), o.lat, o.lon)[0]
        z = float(np.abs((np.log(np.maximum(d, 1.0)) - o.log_km) / o.log_sd)[known].max())
    return Fit(lat, lon, float(origin[0]), float(np.sqrt((residual**2).mean())), error, len(names), o.station[int(parts[0].argmax())], z)


def refit(o: Observations, least: int, most_rms: float = 2.0, most_z: float = math.inf) -> Fit | None:
    """``fit`` without the worst station again and again while it fails and more than ``least`` stations are left."""
    dropped = []
    while True:
        found = fit(o, least)
        if found is None or not (found.rms > most_rms or found.z > most_z) or found.stations <= least:
            if found is not None:
                found.dropped = dropped
            return found
        dropped.append(found.worst)
        o = o.without(found.worst)


def picks(rows: pd.DataFrame) -> Observations:
    """First and second arrivals: two times a station."""
    twice = lambda c: np.repeat(rows[c].to_numpy(), 2)
    n = 2 * len(rows)
    time = rows[["p_time", "s_time"]].to_numpy(float).reshape(-1)
    return Observations(twice("lat"), twice("lon"), twice("station"), time, np.tile([VP, VS], len(rows)), np.zeros(n), np.full(n, np.inf))


def geometry(rows: pd.DataFrame) -> Observations:
    """First arrivals with a distance and its uncertainty each."""
    get = lambda c: rows[c].to_numpy(float)
    return Observations(get("lat"), get("lon"), rows["station"].to_numpy(), get("p_time"), np.full(len(rows), VP), get("log_km"), get("log_sd"))


def first_arrivals(rows: pd.DataFrame) -> Observations:
    """First arrivals alone."""
    return geometry(rows.assign(log_km=0.0, log_sd=np.inf))


METHODS: dict[str, tuple[Callable[[pd.DataFrame], Observations], int]] = {"picks": (picks, 2), "geometry": (geometry, 3), "first_arrivals": (first_arrivals, 3)}


def locate(observations: DataFrame, event: str, method: str, most_rms: float = 2.0, most_z: float = math.inf) -> DataFrame:
    """One row per event that has stations enough: its source, and the stations left out of it (comma-joined)."""
    make, least = METHODS[method]
    kind = observations.schema[event].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        f = refit(make(rows.sort_values("station")), least, most_rms, most_z)
        out = [] if f is None else [(rows[event].iloc[0], f.lat, f.lon, f.origin, f.rms, f.error_km, f.stations, ",".join(map(str, f.dropped)))]
        return pd.DataFrame(out, columns=[event, "lat", "lon", "origin", "rms", "error_km", "stations", "dropped"])

    return observations.groupBy(event).applyInPandas(run, f"`{event}` {kind}, lat double, lon double, origin double, rms double, error_km double, stations bigint, dropped string")


def one_source_rms(rows: pd.DataFrame) -> float:
    """The least RMS with which one source fits first arrivals, near the stations."""
    return fit(first_arrivals(rows), 1, (1.0, 0.05), (0.075, 0.005)).rms


# ---- size --------------------------------------------------------------------------------------------------------------

def _scaled_tail() -> np.ndarray:
    """Coefficients, highest first, of the logarithm of exp(x^2) erfc(x) / t for x >= 0 over 2 t - 1, t = 1 / (1 + x / 2)."""
    t = (np.cos((np.arange(400) + 0.5) * np.pi / 400) + 1) / 2
    x = 2 / t - 2
    far = [math.log1p(-1 / (2 * v * v) + 3 / (4 * v**4) - 15 / (8 * v**6) + 105 / (16 * v**8)) - math.log(v * math.sqrt(math.pi)) if v > 20 else v * v + math.log(math.erfc(v)) for v in x.tolist()]
    return np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(2 * t - 1, np.array(far) - np.log(t), 20))[::-1]


_TAIL = _scaled_tail()


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, by a polynomial in the scaled tail."""
    z = np.asarray(z, float)
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    u, tail = 2 * t - 1, np.full_like(x, _TAIL[0])
    for c in _TAIL[1:]:
        tail *= u
        tail += c
    tail += np.log(t) - x * x - math.log(2)
    return np.where(z <= 0, tail, np.log1p(-np.exp(np.minimum(tail, -math.log(2)))))


SIZES = 1.0 + 0.01 * np.arange(751)


def size_posterior(y: np.ndarray, base: np.ndarray, censored: np.ndarray, slope: float = 1.0, sigma: float = 0.3, b_value: float = 1.0, bounds: tuple[float, float] = (4.5, 5.5)) -> tuple[float, float, list[float]] | None:
    """Mean, standard deviation and class shares of the size. A value is ``base + slope * size`` with normal errors; of a
    censored one only an upper bound is known. None where every value is censored."""
    if censored.all():
        return None
    return posterior(log_likelihoods(y, base, censored, slope, sigma), b_value, bounds)


def log_likelihoods(y: np.ndarray, base: np.ndarray, censored: np.ndarray, slope: float = 1.0, sigma: float = 0.3) -> np.ndarray:
    """Logarithm of the observations' likelihood at each of ``SIZES``: a sum over the observations."""
    z = (y[:, None] - base[:, None] - slope * SIZES[None]) / sigma
    return np.where(censored[:, None], log_normal_cdf(z), -0.5 * z * z - math.log(sigma) - 0.5 * math.log(2 * math.pi)).sum(0)


def posterior(log: np.ndarray, b_value: float = 1.0, bounds: tuple[float, float] = (4.5, 5.5)) -> tuple[float, float, list[float]]:
    """Mean, standard deviation and class shares of the size from the logarithm of the likelihood."""
    log = log - b_value * math.log(10) * SIZES
    p = np.exp(log - log.max())
    p /= p.sum()
    mean = float(p @ SIZES)
    at = [round((x - 1.0) / 0.01) for x in bounds]
    return mean, math.sqrt(max(0.0, float(p @ SIZES**2) - mean * mean)), [float(x.sum()) for x in np.split(p, at)]


#: Observations that a task looks at together.
ROWS = 2048


def size_of_events(observations: DataFrame, event: str) -> DataFrame:
    """One row per event with a value above its threshold: n, above, mean, sd, p_small, p_medium, p_large.

    Logarithms of likelihoods are added up by batch in the tasks that read, so that no task holds an event's rows."""
    kind = observations.schema[event].dataType.simpleString()
    nothing = lambda: (0, 0, np.zeros(len(SIZES)))

    def add(batches):
        sums: dict = {}
        for rows in batches:
            for name, part in rows.groupby(event, dropna=False):
                for k in range(0, len(part), ROWS):
                    y, base, censored = (part[c].to_numpy(t)[k : k + ROWS] for c, t in (("y", float), ("base", float), ("censored", bool)))
                    n, above, log = sums.get(name, nothing())
                    sums[name] = n + len(y), above + int((~censored).sum()), log + log_likelihoods(y, base, censored)
        yield pd.DataFrame([(name, n, above, log.tolist()) for name, (n, above, log) in sums.items()], columns=[event, "n", "above", "log"])

    def end(parts: pd.DataFrame) -> pd.DataFrame:
        n, above = int(parts["n"].sum()), int(parts["above"].sum())
        out = []
        if above:
            mean, sd, shares = posterior(np.sum(parts["log"].tolist(), axis=0))
            out = [(parts[event].iloc[0], n, above, mean, sd, *shares)]
        return pd.DataFrame(out, columns=[event, "n", "above", "mean", "sd", "p_small", "p_medium", "p_large"])

    sums = observations.mapInPandas(add, f"`{event}` {kind}, n bigint, above bigint, log array<double>")
    return sums.groupBy(event).applyInPandas(end, f"`{event}` {kind}, n bigint, above bigint, mean double, sd double, p_small double, p_medium double, p_large double")
