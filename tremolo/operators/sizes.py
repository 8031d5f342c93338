"""The size of an event while it goes on, from peaks of its stations' first seconds."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tremolo.operators import fold
from tremolo.operators.locate import EARTH_KM, SIZES, log_normal_cdf


@dataclass(frozen=True)
class Relation:
    """Logarithm of the peak in a window of ``tau`` seconds by size and distance, with hinges above a size and beyond
    distances; peaks below ``least_snr`` times the noise only bound the size from above."""

    tau: float
    constant: float
    slope: float
    log_km: float
    sigma: float = 0.3
    above: float = 0.0
    knot: float = 6.0
    beyond: tuple[tuple[float, float], ...] = ()
    least_snr: float = 3.0
    depth: float = 10.0

    def at(self, km: float) -> float:
        r = math.log10(math.hypot(km, self.depth))
        return self.constant + self.log_km * r + sum(g * max(0.0, r - math.log10(k)) for g, k in self.beyond)


@lru_cache
def _curve(r: Relation) -> np.ndarray:
    """The part of a relation that changes with the size alone."""
    return r.slope * SIZES + r.above * np.maximum(0.0, SIZES - r.knot)


@lru_cache
def _weights(bounds: tuple[float, ...]) -> np.ndarray:
    """Columns whose products with probabilities of ``SIZES`` are mean, mean square and the shares of the classes."""
    at = [0, *(round((b - 1.0) / 0.01) for b in bounds), len(SIZES)]
    place = np.arange(len(SIZES))
    return np.stack([SIZES, SIZES**2, *(((a <= place) & (place < b)).astype(float) for a, b in zip(at, at[1:]))], 1)


def _km(lat: float, lon: float, lat2: float, lon2: float) -> float:
    """``km_between`` of two places."""
    a, c = math.radians(lat), math.radians(lat2)
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin(math.radians(lon2 - lon) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


@dataclass(frozen=True)
class Model:
    """Relations by window, the slope of sizes, and what is known of stations: terms by (station, tau), noise. Stations with
    a term beyond ``most_term`` are left out, and values whose noise is not within a factor of the station's."""

    relations: tuple[Relation, ...]
    b_value: float = 1.0
    terms: dict | None = None
    most_term: float = 0.5
    noise: dict | None = None
    least_noise: float = 0.1
    most_noise: float = 10.0
    bounds: tuple[float, float] = (4.5, 5.5)

    def relation(self, tau: float) -> Relation | None:
        return next((r for r in self.relations if abs(r.tau - tau) < 1e-9), None)

    def likelihood(self, station, tau: float, peak: float, noise: float, km: float) -> tuple[np.ndarray, bool] | None:
        """Logarithms over the sizes, and whether the peak is above the noise; None where the value takes no part."""
        r, term = self.relation(tau), (self.terms or {}).get((station, tau), 0.0)
        usual = (self.noise or {}).get(station)
        if r is None or not noise > 0 or abs(term) > self.most_term or (usual is not None and not usual * self.least_noise <= noise <= usual * self.most_noise):
            return None
        up = peak > 0 and peak >= r.least_snr * noise
        mean = r.at(km) + term + _curve(r)
        z = (math.log10(peak if up else r.least_snr * noise) - mean) / r.sigma
        return (-0.5 * z * z - math.log(r.sigma) - 0.5 * math.log(2 * math.pi) if up else log_normal_cdf(z)), up

    def posterior(self, found: list[tuple[np.ndarray, bool]]) -> tuple | None:
        """mean, sd, shares of the three classes, values, values above the noise; None with none above it."""
        above = sum(up for _, up in found)
        if not above:
            return None
        log = sum((x for x, _ in found), -self.b_value * math.log(10) * SIZES)
        p = np.exp(log - log.max())
        mean, square, *shares = (p @ _weights(self.bounds) / p.sum()).tolist()
        return mean, math.sqrt(max(0.0, square - mean * mean)), *shares, len(found), above


REPORT = "at bigint, mean double, sd double, p_small double, p_medium double, p_large double, stations bigint, above bigint, tau double, distances string, first double, first_at bigint"
_COLUMNS = [x.split()[0] for x in REPORT.split(", ")]


class Report:
    """What is known of one event, and what was said of it last."""

    def __init__(self, model: Model, most_error: float = 20.0, least_change: float = 0.1):
        self.model, self.most_error, self.least_change = model, most_error, least_change
        self.peaks: dict = {}
        self.quiet: dict = {}
        self.km: dict = {}
        self.places: dict = {}
        self.said = self.count = self.first = self.first_at = None
        self.known: dict = {}

    def _place(self) -> tuple[str, tuple | None]:
        """The location unless its error is too large (an unknown one is not), else that of first arrivals with a small one."""
        lat, lon, error = self.places.get("location", (None, None, None))
        if lat is not None and (error is None or error <= self.most_error):
            return "location", (lat, lon)
        lat, lon, error = self.places.get("first_location", (None, None, None))
        if lat is not None and error is not None and error <= self.most_error:
            return "first_location", (lat, lon)
        return "distance", None

    def _value(self, station, value: tuple, place: tuple | None):
        """A station's part of the likelihood, kept until its value or distance changes."""
        tau, peak, noise, lat, lon = value
        km = _km(*place, lat, lon) if place and lat is not None else None if place else self.km.get(station)
        if km is None:
            return None
        key = (tau, peak, noise, km)
        if self.known.get(station, (None,))[0] != key:
            self.known[station] = (key, self.model.likelihood(station, tau, peak, noise, km))
        return self.known[station][1]

    def offer(self, what: str, at: int, station, lat, lon, tau, peak, noise, km, error) -> tuple | None:
        if what == "peak" and None not in (station, tau, peak, noise):
            self.quiet.pop(station, None)
            if station not in self.peaks or tau >= self.peaks[station][0]:
                self.peaks[station] = (tau, peak, noise, lat, lon)
        elif what == "quiet" and None not in (station, tau, peak, noise):
            if station not in self.peaks:
                self.quiet[station] = (tau, peak, noise, lat, lon)
        elif what == "distance" and None not in (station, km):
            self.km[station] = km
            return None
        elif what in ("location", "first_location") and None not in (lat, lon):
            self.places[what] = (lat, lon, error)
        else:
            return None
        return self._report(at) if self.peaks else None

    def _report(self, at: int) -> tuple | None:
        source, place = self._place()
        used = {s: v for s, v in self.peaks.items() if (place and v[3] is not None) or (not place and s in self.km)}
        values = [*used.items(), *(self.quiet.items() if place else ())]
        found = [x for s, v in values if (x := self._value(s, v, place)) is not None]
        size = self.model.posterior(found)
        if size is None:
            return None
        changed = self.said is None or abs(size[0] - self.said) >= self.least_change or size[5] != self.count
        self.count = size[5]
        if self.first is None:
            self.first, self.first_at = size[0], at
        if not changed:
            return None
        self.said = size[0]
        return at, *size, max(v[0] for v in used.values()), source, self.first, self.first_at


#: What is told of an event.
TOLD = ["what", "at", "station", "lat", "lon", "tau", "peak", "noise", "km", "error"]


def report_step(on: str, model: Model, most_error: float = 20.0, least_change: float = 0.1):
    """Step of a fold over what is told of each event in order (``on``, what, at, station, lat, lon, tau, peak, noise, km,
    error): a size whenever it changed by ``least_change`` or the number of values did.

    ``peak``: the longest window of a station counts, of equal ones the later; ``quiet``: a bound by a station without a
    peak, used once there is a place; ``distance``: by the station alone; ``location`` and ``first_location``: places with
    the error in km. Distances are those from the place, once there is one with an error up to ``most_error``. Rows that
    lack what they tell say nothing. An event holds one value a station.
    """

    def step(state, rows):
        state, out = state or Report(model, most_error, least_change), []
        none = lambda c: [None if pd.isna(x) else x for x in rows[c]]
        for row in zip(*(none(c) for c in TOLD)):
            if (said := state.offer(*row)) is not None:
                out.append(said)
        frame = pd.DataFrame(out, columns=_COLUMNS)
        frame.insert(0, on, rows[on].iloc[0])
        return state, frame

    return step


def reports(told: DataFrame, on: str, order: list[str], model: Model, most_error: float = 20.0, least_change: float = 0.1) -> DataFrame:
    """``report_step`` folded over a table: ``on`` and the columns ``REPORT``."""
    kind = told.schema[on].dataType.simpleString()
    return fold.ordered_offers(told, on, order, TOLD, lambda: Report(model, most_error, least_change), f"`{on}` {kind}, {REPORT}")
