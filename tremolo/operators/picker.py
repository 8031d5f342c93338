"""Onsets in continuous samples: a bank of octave bands with adaptive statistics, causal filters and short over long averages.

Each works on gap-free runs of one channel, batch by batch through :func:`tremolo.operators.fold.ordered_fold`: what is kept
between batches is a few filter states and the samples of one trigger window. A run ends where the sample number jumps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd

from tremolo.functions.arrays import butterworth

#: Fixed values of the method: least deviation of a live channel, share of one sign that makes a polarity, least threshold of
#: an onset, level at which a new onset may come, and what a band's period is divided by for the least width of an onset.
LEAST_SD, ONE_SIGN, LEAST_ONSET, QUIET, PERIOD_SHARE = 1e-30, 0.667, 0.5, 2.0, 20.0

PICKS = "time bigint, first bigint, last bigint, accepted bigint, polarity int, weight double, amplitude double, period double"


@dataclass(frozen=True)
class Settings:
    """Seconds, but for the levels: ``level`` starts an onset, ``area`` times the samples of ``within`` accepts it."""

    rate: float = 100.0
    longest: float = 3.0
    memory: float = 5.0
    level: float = 10.0
    area: float = 10.0
    within: float = 0.2

    @property
    def top(self) -> float:
        return 5 * self.level

    @property
    def span(self) -> int:
        """Samples in which an onset must be accepted."""
        return max(1, int(0.5 + self.within * self.rate) + 1)


class Bank:
    """Octave bands of a channel: how many deviations each band's energy is above its decaying mean."""

    def __init__(self, s: Settings):
        n = 1 + max(0, math.ceil(math.log2(max(1, int(s.longest * s.rate + 1e-9)))))
        self.period = 2.0 ** np.arange(n) / s.rate
        window, dt = self.period / (2 * math.pi), 1 / s.rate
        self.high, self.smooth = window / (window + dt), dt / (window + dt)
        self.keep = 1 - dt / s.memory
        self.top, self.most = s.top, s.level / 2
        self.last = None
        self.stage = np.zeros((3, n))  # two high passes and a low pass
        self.mean, self.var, self.ratio = np.zeros(n), np.zeros(n), np.zeros(n)
        self.onset = np.full(n, s.level / 2)  # level at which a band's onset starts

    def push(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(samples, bands): filtered values, ratios, and whether a band's ratio rises through its onset level."""
        low, ratio, rises = np.empty((3, len(x), len(self.period)))
        steps = np.diff(x, prepend=x[0] if self.last is None else self.last)
        self.last = x[-1]
        for i, d in enumerate(steps):
            a, b, c = self.stage
            high = self.high * (a + d)
            again = self.high * (b + high - a)
            self.stage = np.stack([high, again, c + self.smooth * (again - c)])
            energy = self.stage[2] ** 2
            sd = np.sqrt(self.var)
            live = sd > LEAST_SD
            r = np.where(live, (energy - self.mean) / np.where(live, sd, 1.0), 0.0)
            energy = np.where(r > self.top, self.top * sd + self.mean, energy)
            held = np.minimum(r, self.top)
            low[i], ratio[i], rises[i] = self.stage[2], r, (self.ratio < self.onset) & (held >= self.onset)
            self.ratio = held
            self.mean = self.keep * self.mean + (1 - self.keep) * energy
            self.var = self.keep * self.var + (1 - self.keep) * (energy - self.mean) ** 2
            self.onset = np.clip(self.keep * self.onset + (1 - self.keep) * held, LEAST_ONSET, self.most)
        return low, ratio, rises > 0


class Picker:
    """Onsets of one run. A rise of the largest ratio through ``level`` is accepted at the sample at which the ratios summed
    since reach the area, if that is within ``span`` samples; a rise counts only after all
    bands have been quiet since the pick before."""

    def __init__(self, s: Settings):
        self.s, self.bank = s, Bank(s)
        n = len(self.bank.period)
        self.n, self.start = 0, 3 + int(s.memory * s.rate + 1e-9)
        self.armed, self.taken = None, -1
        self.low, self.moved, self.way, self.since = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, int)
        self.kept: dict[str, np.ndarray] | None = None

    def _since_rise(self, low: np.ndarray, rises: np.ndarray) -> dict[str, np.ndarray]:
        """What a band's value moved and the way it went since its last rise, and the sample of that rise."""
        step = np.diff(low, axis=0, prepend=self.low[None])
        at = np.maximum.accumulate(np.where(rises, np.arange(len(low))[:, None], -1), axis=0)
        out = {"since": np.where(at >= 0, self.n + at, self.since[None])}
        for name, v in (("moved", step), ("way", np.abs(step))):
            run = np.cumsum(v, axis=0)
            before = np.take_along_axis(run - v, np.maximum(at, 0), axis=0)
            out[name] = np.where(at >= 0, run - before, getattr(self, name)[None] + run)
            setattr(self, name, out[name][-1])
        self.low, self.since = low[-1], out["since"][-1]
        return out

    def push(self, x: np.ndarray) -> list[tuple]:
        if not len(x):
            return []
        s = self.s
        low, ratio, rises = self.bank.push(x)
        n = self.n + np.arange(len(x))
        on = n >= self.start
        at = ratio >= s.level
        new = self._since_rise(low, rises) | {"n": n, "cf": np.where(on, np.maximum(ratio.max(1), 0.0), 0.0), "band": at.argmax(1)}
        quiet = n[on & (np.minimum(ratio, s.top) <= QUIET).all(1)]
        w = new if self.kept is None else {k: np.concatenate([self.kept[k], v]) for k, v in new.items()}
        old = len(w["n"]) - len(x)
        area = np.cumsum(np.minimum(w["cf"], s.top))
        start = 1 + np.flatnonzero((w["cf"][1:] >= s.level) & (w["cf"][:-1] < s.level))
        end = np.maximum(start + 1, np.searchsorted(area, area[start - 1] + s.span * s.area))
        fits = (end < start + s.span) & (end < len(area)) & (end >= old)
        out = []
        for e, m in sorted(zip(end[fits].tolist(), (-start[fits]).tolist())):
            m = -m
            self._arm(quiet)
            if self.armed is None or w["n"][m] <= self.armed:
                continue
            out.append(self._pick(w, m, int(w["n"][e])))
            self.armed, self.taken = None, int(w["n"][e])
        self._arm(quiet)
        self.n += len(x)
        self.kept = {k: v[-(s.span + 1) :] for k, v in w.items()}
        return out

    def _arm(self, quiet: np.ndarray) -> None:
        if self.armed is None and (k := np.searchsorted(quiet, self.taken, side="right")) < len(quiet):
            self.armed = int(quiet[k])

    def _pick(self, w: dict[str, np.ndarray], m: int, accepted: int) -> tuple:
        band, trigger = int(w["band"][m]), int(w["n"][m])
        onset = int(w["since"][m, band]) - 1
        way = w["way"][m + 1, band]
        share = w["moved"][m + 1, band] / way if way > 0 else 0.0
        weight = max(0.0, (abs(float(share)) - ONE_SIGN) / (1 - ONE_SIGN))
        first, last, period = 2 * onset - trigger, trigger, float(self.bank.period[band])
        lack = period / PERIOD_SHARE - (last - first) / self.s.rate
        more = int(lack * self.s.rate / 2) if lack > 0 else 0
        first, last = first - more, last + more
        return ((first + last) // 2, first, last, accepted, int(np.sign(share)) if weight else 0, weight, float(w["cf"][m]), period)


def runs(at: np.ndarray, last: int | None) -> list[tuple[slice, bool]]:
    """Slices of consecutive sample numbers, and whether each begins a new run."""
    jump = np.diff(at, prepend=at[0] - 1 if last is None else last) != 1
    jump[0] |= last is None
    cut = [0, *np.flatnonzero(jump[1:]) + 1, len(at)]
    return [(slice(a, b), bool(jump[a])) for a, b in zip(cut, cut[1:])]


def pick_step(on: list[str], at: str, value: str, settings: Settings):
    """Step of a fold: rows are samples numbered by ``at``; output is ``on`` and the columns of ``PICKS``, in sample numbers."""

    def step(state, rows):
        picker, origin, last = state or (None, 0, None)
        n, x, out = rows[at].to_numpy(), rows[value].to_numpy(float), []
        for part, fresh in runs(n, last):
            if fresh:
                picker, origin = Picker(settings), int(n[part][0])
            out += [tuple(v + origin if k < 4 else v for k, v in enumerate(p)) for p in picker.push(x[part])]
        key = [rows[c].iloc[0] for c in on]
        names = [f.split()[0] for f in PICKS.split(", ")]
        return (picker, origin, int(n[-1])), pd.DataFrame([(*key, *p) for p in out], columns=[*on, *names]) if out else None

    return step


class Cascade:
    """Second-order sections after each other, started as if the first sample had always been there."""

    def __init__(self, sections: list, first: float):
        self.sections, self.state = sections, []
        for (b0, b1, b2), (a1, a2) in sections:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            self.state.append([first * (gain - b0), first * (b2 - a2 * gain)])
            first *= gain

    def push(self, x: list[float]) -> list[float]:
        for ((b0, b1, b2), (a1, a2)), z in zip(self.sections, self.state):
            p, q, out = *z, []
            for v in x:
                y = b0 * v + p
                p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
                out.append(y)
            z[:] = p, q
            x = out
        return x


def band_step(on: list[str], at: str, value: str, low: float, high: float, rate: float, first: int):
    """Step and end of a causal band pass. Of each run the first ``first`` samples are waited for and their mean is taken off;
    samples of runs that are shorter, and null samples, come out as nulls."""
    sections = [*butterworth("high", low, rate), *butterworth("low", high, rate)]

    def frame(key, rows):
        return pd.DataFrame([(*key, n, y) for n, y in rows], columns=[*on, at, value]) if rows else None

    def step(state, rows):
        cascade, mean, waiting, last = state or (None, 0.0, [], None)
        out = []
        for n, v in zip(rows[at].tolist(), rows[value].tolist()):
            missing = v is None or v != v
            if missing or (last is not None and n != last + 1):
                out += [(k, None) for k, _ in waiting]
                cascade, waiting = None, []
            last = n
            if missing:
                out.append((n, None))
                continue
            if cascade is not None:
                out.append((n, cascade.push([v - mean])[0]))
                continue
            waiting.append((n, v))
            if len(waiting) == first:
                mean = sum(w for _, w in waiting) / first
                cascade = Cascade(sections, waiting[0][1] - mean)
                out += zip([k for k, _ in waiting], cascade.push([w - mean for _, w in waiting]))
                waiting = []
        return (cascade, mean, waiting, last), frame([rows[c].iloc[0] for c in on], out)

    def end(key, state):
        return frame(key, [(k, None) for k, _ in state[2]])

    return step, end


def ratio_step(on: list[str], at: str, value: str, short: int, long: int, level: float, release: float, gap: int):
    """Short over long average of energy with a trigger: on at ``level``, off below ``release``; an onset within ``gap``
    samples of the last accepted one is not accepted. Output: ``on``, ``at`` and the ratio."""

    def step(state, rows):
        s, l, n, up, taken, last = state or (0.0, LEAST_SD, 0, False, None, None)  # noqa: E741
        out = []
        for t, v in zip(rows[at].tolist(), rows[value].tolist()):
            if last is not None and t != last + 1:
                s, l, n, up = 0.0, LEAST_SD, 0, False  # noqa: E741
            last = t
            if n:
                s, l = s + (v * v - s) / short, l + (v * v - l) / long  # noqa: E741
            ratio = s / l if n >= long else 0.0
            n += 1
            if not up and ratio >= level and (taken is None or t - taken > gap):
                out.append((t, ratio))
                taken = t
            up = ratio >= level or (up and ratio >= release)
        key = [rows[c].iloc[0] for c in on]
        return (s, l, n, up, taken, last), pd.DataFrame([(*key, *o) for o in out], columns=[*on, at, "ratio"]) if out else None

    return step
