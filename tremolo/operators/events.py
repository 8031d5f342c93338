"""Events from detections: assigning them in order, merging one seen twice, and the verdict on an event's picks.

Assignment depends on what was assigned before, so it is a fold over a network's detections; merging and verdicts are
about one event or pair of events, a small group of stations each, dealt out by Spark.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.operators import grid, locate, partners
from tremolo.operators.locate import DEPTH, VP, VS

ASSIGNED = "event bigint, role string"


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Groups dealt to a fixed number of tasks: the rows are few bytes and much work, so small shuffles must not be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def assign_step(on: list[str], key: str, at: str, least: int, coda: float, reach_km: float, slack: float = 3.0, largest: bool = False):
    """Step of a fold over detections in order: columns ``key``, ``at`` (seconds), ``station``, ``lat``, ``lon``, ``restart``.

    A detection within ``coda`` after its station's own in a declared event belongs to that event's coda, but for a restart.
    Otherwise it joins the first event (``largest``: a declared one, then the one with most stations) in which all
    detections are compatible with it: their times differ by no more than the way between the stations at P speed and
    ``slack``. Else it begins an event. An event is declared by the ``least``-th station. Events are forgotten when no
    later detection within ``reach_km`` can be compatible.

    Output: ``on``, ``key``, the event's number within its key and the role: first, joined, declares, coda."""
    near = reach_km / VP + slack
    longest = max(coda, near)

    def step(state, rows):
        count, live = state or (0, [])
        out = []
        names = [*on, key, at, "station", "lat", "lon", "restart"]
        for *k, t, station, lat, lon, restart in zip(*[rows[c].tolist() for c in names]):
            live = [e for e in live if t - e["newest"] <= longest]
            own = [] if restart else [e for e in live if len(e["at"]) >= least and station in e["at"] and 0 < t - e["at"][station][0] <= coda]
            if own:
                out.append((*k, own[0]["id"], "coda"))
                continue
            fits = [e for e in live if t - e["first"] <= near and station not in e["at"] and _compatible(e, t, lat, lon, slack)]
            if largest:
                fits.sort(key=lambda e: (len(e["at"]) < least, -len(e["at"])))
            if fits:
                e = fits[0]
            else:
                e = {"id": count, "at": {}, "first": t, "newest": t}
                count += 1
                live.append(e)
            e["at"][station] = (t, lat, lon)
            e["newest"] = max(e["newest"], t)
            n = len(e["at"])
            out.append((*k, e["id"], "declares" if n == least else "first" if n == 1 else "joined"))
        return (count, live), pd.DataFrame(out, columns=[*on, key, "event", "role"])

    return step


def _compatible(event: dict, t: float, lat: float, lon: float, slack: float) -> bool:
    """Whether all members are; plain arithmetic, as most events have a member or two."""
    for at, la, lo in event["at"].values():
        h = math.sin(math.radians(lat - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - lo) / 2) ** 2
        if abs(at - t) > 2 * locate.EARTH_KM * math.asin(min(1.0, math.sqrt(h))) / VP + slack:
            return False
    return True


#: Grid on which one source near the stations is looked for.
CLOSE = (0.05, 20), (0.005, 15)


def _listed(rows: DataFrame, key: str, columns: list[str], run: Callable, out: str) -> DataFrame:
    """``run(key, *columns)`` for every key with its rows' columns as arrays, in order of the columns: a row, or none. Rows of a
    key are few; keys are dealt to a fixed number of tasks, and looked at by the batch."""
    kind = rows.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in out.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [(k, *made) for k, *values in zip(part[key], *(part[c] for c in columns)) if (made := run(*map(np.asarray, values))) is not None]
            yield pd.DataFrame(found, columns=[key, *names])

    lists = _dealt(rows, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__rows"))
    return lists.select(key, *[F.col(f"__rows.{c}").alias(c) for c in columns]).mapInPandas(each, f"`{key}` {kind}, {out}")


def _first_arrivals(station: np.ndarray, lat: np.ndarray, lon: np.ndarray, time: np.ndarray) -> grid.Observed:
    none = np.full(len(station), np.nan)
    return grid.Observed(station, lat, lon, time, np.full(len(station), VP), none, none)


def merged(rows: pd.DataFrame, most_rms: float = 1.0, least: int = 4, most_shared: int = 4, window: float = 30.0) -> tuple[list, list, float] | None:
    """Stations of a declared event (``own`` false) that stay, and of a second one (``own`` true) that join it, with the
    misfit, if they begin within ``window`` seconds and one source fits them.

    Where both have a station, either detection is tried, the first event's before; one more detection may be left out. The fit needs ``least``
    stations, two of the second and one of the first. A first event of four stations or more that fits by itself gives up
    one detection at most."""
    rows = rows.sort_values(["own", "station"])
    return _merged(*(rows[c].to_numpy() for c in ("own", "station", "lat", "lon", "p_time")), most_rms, least, most_shared, window)


def _merged(own: np.ndarray, station: np.ndarray, lat: np.ndarray, lon: np.ndarray, time: np.ndarray, most_rms: float = 1.0, least: int = 4, most_shared: int = 4, window: float = 30.0) -> tuple[list, list, float] | None:
    """``merged`` of rows in order of ``own``, then station. Choices that no source near their stations can fit are passed over
    by bounds of cells; only for the others is the grid searched."""
    own, lat, lon, time = own.astype(bool), lat.astype(float), lon.astype(float), time.astype(float)
    if own.all() or not own.any():
        return None
    names = station.tolist()
    theirs, ours = ({names[i]: i for i in np.flatnonzero(on).tolist()} for on in (~own, own))
    shared = sorted(set(theirs) & set(ours))
    if len(shared) > most_shared or abs(time[~own].min() - time[own].min()) > window:
        return None

    # how much more two times differ than by the way between their stations: the misfit of any source is half its square at least
    more = np.abs(time[:, None] - time[None]) - locate.km_between(lat, lon, lat, lon) / VP

    def rms(use: list[int]) -> float:
        """Of a choice that no source can fit: infinity."""
        if more[use][:, use].max() > math.sqrt(2 * len(use)) * most_rms + 1e-6:
            return math.inf
        o = _first_arrivals(station[use], lat[use], lon[use], time[use])
        return math.inf if o.excludes(len(use) * most_rms**2 / 2 / grid.SIGMA**2, CLOSE[0]) else o.source(*CLOSE)[3]

    first = list(theirs.values())
    give_up = 1 if len(first) >= 4 and rms(first) <= most_rms else len(first)
    for picked in itertools.product([False, True], repeat=len(shared)):
        choice = dict(zip(shared, picked))
        chosen = [i for i in range(len(names)) if choice.get(names[i], own[i]) == own[i]]
        for left_out in [None, *chosen]:
            use = [i for i in chosen if i != left_out]
            stay, join = [i for i in use if not own[i]], [i for i in use if own[i]]
            lost = sum(picked) + (left_out is not None and not own[left_out])
            if lost > give_up or len(use) < least or len(join) < 2 or not stay:
                continue
            if (found := rms(use)) <= most_rms:
                return [names[i] for i in stay], [names[i] for i in join], found
    return None


def merge_duplicates(pairs: DataFrame, pair: str) -> DataFrame:
    """One row per pair of events that is one event: rows of ``pairs`` are the detections of both (``own``: the second's)."""

    def run(*columns):
        m = _merged(*columns)
        return None if m is None else (",".join(map(str, m[0])), ",".join(map(str, m[1])), m[2])

    return _listed(pairs, pair, ["own", "station", "lat", "lon", "p_time"], run, "stay string, joined string, rms double")


def _one_source(station: np.ndarray, lat: np.ndarray, lon: np.ndarray, p_time: np.ndarray, s_time: np.ndarray, km: np.ndarray, most_rms: float, most_off: float) -> tuple[tuple | None, object]:
    """A source (lat, lon, rms) for all P and S times of two stations or more; else None and the station that is furthest from it."""
    apart = locate.km_between(lat, lon, lat, lon)
    bad = np.triu((np.abs(km[:, None] - km[None]) > apart + 5) | (apart > km[:, None] + km[None] + 5), 1)
    if bad.any():
        i, j = np.argwhere(bad)[0]
        return None, station[i if km[i] > km[j] else j]
    twice, none = (lambda x: np.repeat(x, 2)), np.full(2 * len(station), np.nan)
    times = np.stack([p_time, s_time], 1).ravel()
    la, lo, origin, rms = grid.Observed(twice(station), twice(lat), twice(lon), times, np.tile([VP, VS], len(station)), none, none).source()
    way = np.hypot(locate.km_between(np.array([la]), np.array([lo]), lat, lon)[0], DEPTH)
    off = np.maximum(np.abs(p_time - origin - way / VP), np.abs(s_time - origin - way / VS))
    return ((la, lo, rms) if rms <= most_rms and off.max() <= most_off else None), station[int(off.argmax())]


#: Columns of a station's picks, and those of a verdict.
PICKS = ["station", "lat", "lon", "p_time", "s_time", "log_km", "log_sd", "chance"]
VERDICT = "verdict string, stations bigint, dropped string, lat double, lon double, rms double, z double"


def assess(rows: pd.DataFrame, most_km: float = 200.0, most_rms: float = 2.5, most_off: float = 3.5, agree_z: float = 2.0, rare: float = 0.01) -> dict:
    """Verdict on an event from its stations' picks: ``station, lat, lon, p_time, s_time``, a distance by other means
    (``log_km``, ``log_sd``; null: none), and the event's ``chance`` of coincidence (null: unknown).

    S-P times of more than ``most_km`` are another event's. One source must fit the rest, or all but the worst of three or
    more. Distances and chance support or object. *earthquake*: three stations fit, or two with support and no objection;
    *possible*: two fit; *misfire*: three or more do not fit, or two do not and there is an objection; else *unclassified*."""
    rows = rows.sort_values("station")
    found = _assess(*(rows[c].to_numpy() for c in PICKS), most_km, most_rms, most_off, agree_z, rare)
    return dict(zip([c.split()[0] for c in VERDICT.split(", ")], found))


def _assess(station, lat, lon, p_time, s_time, log_km, log_sd, chance, most_km: float = 200.0, most_rms: float = 2.5, most_off: float = 3.5, agree_z: float = 2.0, rare: float = 0.01) -> tuple:
    """``assess`` of picks as arrays in order of station: the columns ``VERDICT``."""
    lat, lon, p_time, s_time, log_km, log_sd, chance = (np.asarray(v, float) for v in (lat, lon, p_time, s_time, log_km, log_sd, chance))
    km = (s_time - p_time) * VP * VS / (VP - VS)
    used = np.flatnonzero(km <= most_km)
    n, f, dropped = len(used), None, None
    chance = float(chance[used[0]]) if n else math.nan
    if n >= 2:
        fit = lambda on: _one_source(*(x[on] for x in (station, lat, lon, p_time, s_time, km)), most_rms, most_off)
        f, worst = fit(used)
        if f is None and n >= 3:
            rest = used[station[used] != worst]
            f, _ = fit(rest)
            if f is not None:
                dropped, used = worst, rest
    z = np.abs((np.log(np.maximum(km[used], 1.0)) - log_km[used]) / log_sd[used])
    known = ~np.isnan(z)
    middle = float(np.median(z[known])) if known.any() else math.nan
    far = float(km[used][known].max()) if known.any() else 0.0
    support = (middle <= agree_z) + (chance <= rare)
    against = (middle > 2 * agree_z and far <= 60) + (chance > 0.1)
    if n < 2:
        verdict = "unclassified"
    elif f is None:
        verdict = "misfire" if n >= 3 or against else "unclassified"
    else:
        verdict = "earthquake" if len(used) >= 3 or (support and not against) else "possible"
    return verdict, len(used) if f else 0, "" if dropped is None else str(dropped), *(f or (None, None, None)), None if math.isnan(middle) else middle


def assessments(picks: DataFrame, event: str) -> DataFrame:
    """``assess`` for every event."""
    return _listed(picks, event, PICKS, _assess, VERDICT)


def consistent_choice(rows: pd.DataFrame, slack: float = 3.0) -> list | None:
    """One detection of every station of an alarm so that all are pairwise compatible, or None: rows have ``station, id, at,
    lat, lon``. Depth first, stations with fewest candidates first, earlier detections first; a station whose candidates
    all conflict with what is chosen ends its branch at once."""
    rows = rows.sort_values(["station", "at", "id"])
    found = _choice(*(rows[c].to_numpy() for c in ("station", "at", "lat", "lon")), slack)
    return None if found is None else rows["id"].iloc[found].tolist()


def _choice(station: np.ndarray, at: np.ndarray, lat: np.ndarray, lon: np.ndarray, slack: float) -> list[int] | None:
    """``consistent_choice`` of candidates in order of station, then time; sets of candidates are bits of a number."""
    n = len(station)
    if n == 1:
        return [0]
    fits = np.abs(at[:, None] - at[None]) <= locate.km_between(lat, lon, lat, lon) / VP + slack
    starts = np.flatnonzero(np.r_[True, station[1:] != station[:-1]]).tolist()
    if len(starts) == n:  # one candidate each: there is no choice
        return list(range(n)) if fits.all() else None
    fit = [int.from_bytes(b.tobytes(), "little") for b in np.packbits(fits, axis=1, bitorder="little")]
    groups = [(1 << b) - (1 << a) for a, b in zip(starts, [*starts[1:], n])]

    def search(left: list[int], chosen: int) -> int | None:
        if not left:
            return chosen
        k = min(range(len(left)), key=lambda i: left[i].bit_count())
        own = left[k]
        while own:
            bit = own & -own
            own ^= bit
            near = fit[bit.bit_length() - 1]
            rest = [o & near for i, o in enumerate(left) if i != k]
            if all(rest) and (found := search(rest, chosen | bit)) is not None:
                return found
        return None

    found = search(groups, 0)
    return None if found is None else [i for i in range(n) if found >> i & 1]


def reconstruct(rows: DataFrame, most_km: float, slack: float = 3.0) -> DataFrame:
    """For every detection that others are compatible with a consistent choice of the candidates of every station within
    ``most_km``: alarm, stations, ids (in order of station, comma-joined; null: none). ``rows``: id, station, us, lat, lon.

    Candidates are looked at inside spans of time, as long as the way of ``most_km`` takes; they are never rows."""
    most = most_km / VP + slack

    def answer(span, blocks):
        fits, out = partners.Compatible(span, VP, slack, most), []
        at = fits.us / 1e6
        for own, others in blocks:
            order = np.arange(others.start, others.stop)
            order = order[np.lexsort((fits.id[others], fits.us[others], fits.station[others]))]
            i, j = np.nonzero(fits(own, order)[0])
            i, j = i + own.start, order[j]
            near = partners.km_between(fits.lat[i], fits.lon[i], fits.lat[j], fits.lon[j]) <= most_km
            i, j = i[near], j[near]
            names, start = np.unique(i, return_index=True)
            for k, a, b in zip(names.tolist(), start.tolist(), [*start[1:].tolist(), len(i)]):
                c = j[a:b]
                found = _choice(fits.station[c], at[c], fits.lat[c], fits.lon[c], slack)
                out.append((fits.id[k], len(set(fits.station[c].tolist())), None if found is None else ",".join(map(str, fits.id[c[found]].tolist()))))
        return pd.DataFrame(out, columns=["alarm", "stations", "ids"])

    return partners.windows(rows, "us", math.ceil(most * 1e6), answer, "alarm bigint, stations bigint, ids string", spans=40)
