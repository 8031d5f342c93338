"""Continuous detectors, assignment, choices and fits against plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF
from tremolo.operators import censored, events, fold, locate, picker
from tremolo.plans import detectors

RNG = np.random.default_rng(11)


def trace(n=6000):
    x = RNG.normal(0, 1, n)
    for at in (900, 1500, 1560, 3000, 4400):
        k = np.arange(n - at)
        x[at:] += 25 * np.exp(-k / 120) * np.sin(k * 0.7)
    return x


def plain_picks(x, s):
    """Sample by sample, every trigger window looked through again."""
    bank = picker.Bank(s)
    low, ratio, rises = (np.concatenate(v) for v in zip(*[bank.push(np.array([v])) for v in x]))
    start = 3 + int(s.memory * s.rate)
    cf = [max(0.0, ratio[n].max()) if n >= start else 0.0 for n in range(len(x))]
    armed, out = None, []
    for n in range(start, len(x)):
        hit = None
        for m in range(n - 1, max(0, n - s.span), -1):
            if armed is not None and m > armed and cf[m] >= s.level > cf[m - 1] and sum(min(c, s.top) for c in cf[m : n + 1]) >= s.span * s.area:
                hit = m
                break
        if hit is not None:
            out.append((hit, n, int(np.argmax(ratio[hit] >= s.level))))
            armed = None
        elif armed is None and all(min(r, s.top) <= 2 for r in ratio[n]):
            armed = n
    found = []
    for m, n, band in out:
        up, next_up = (max(i for i in range(k) if rises[i, band]) for k in (m + 1, m + 2))
        steps = np.diff(low[next_up - 1 : m + 2, band])
        share = steps.sum() / np.abs(steps).sum()
        found.append((m, n, up - 1, round(share, 9)))
    return found


@pytest.mark.parametrize("s", [picker.Settings(level=6, area=4), picker.Settings(level=4, area=2, within=0.05), picker.Settings(rate=20, longest=0.3, memory=3, level=5, area=3)])
def test_picks_against_plain_loop(s):
    x = trace()
    p = picker.Picker(s)
    got = [o for part in np.array_split(x, [1, 2, 700, 1510, 1511, 1600, 4000]) for o in p.push(part)]
    want = plain_picks(x, s)
    assert len(want) >= 3
    assert [o[3] for o in got] == [n for _, n, _, _ in want]
    assert np.allclose(got, picker.Picker(s).push(x))
    for o, (m, _, onset, share) in zip(got, want):
        assert o[1] <= 2 * onset - m and o[2] >= m and o[1] + o[2] == 2 * onset  # symmetric about the onset
        assert o[5] == pytest.approx(max(0.0, (abs(share) - 0.667) / 0.333), abs=1e-6)
        assert o[4] == (0 if o[5] == 0 else int(np.sign(share)))


def test_band_pass_runs(spark):
    rows = [(1, k, float(RNG.normal())) for k in range(60) if k not in (20, 25, 26)] + [(2, k, 5.0) for k in range(30)]
    rows[40] = (*rows[40][:2], None)
    df = spark.createDataFrame(rows, "c long, at long, x double")
    step, end = picker.band_step(["c"], "at", "x", 0.5, 3.0, 10.0, 8)
    got = {(r.c, r.at): r.x for r in fold.ordered_fold(df, ["c"], ["at"], step, "c long, at long, x double", end).collect()}
    assert len(got) == len(rows)
    sections = [*picker.butterworth("high", 0.5, 10.0), *picker.butterworth("low", 3.0, 10.0)]
    for c in (1, 2):
        run = []
        for r in [*[r for r in sorted(rows, key=lambda r: r[:2]) if r[0] == c], (c, 10**6, None)]:
            if run and (r[2] is None or r[1] != run[-1][1] + 1):
                if len(run) < 8:
                    assert all(got[k[:2]] is None for k in run)
                else:
                    x = np.array([k[2] for k in run]) - np.mean([k[2] for k in run[:8]])
                    for (b0, b1, b2), (a1, a2) in sections:  # direct form over a long constant lead
                        full, y = np.concatenate([np.full(4000, x[0]), x]), []
                        for i, v in enumerate(full):
                            g = lambda q, j: q[j] if j >= 0 else 0.0
                            y.append(b0 * v + b1 * g(full, i - 1) + b2 * g(full, i - 2) - a1 * g(y, i - 1) - a2 * g(y, i - 2))
                        x = np.array(y[4000:])
                    assert np.allclose([got[k[:2]] for k in run], x, atol=1e-6)
                run = []
            if r[2] is not None:
                run.append(r)
            elif r[1] < 10**6:
                assert got[r[:2]] is None


def test_ratio_triggers(spark):
    got = detectors.stalta_triggers(spark, SF).toPandas()
    want = []
    for c, g in detectors._samples(spark, SF).toPandas().sort_values(["channel", "at"]).groupby("channel"):
        taken, last, up, e = None, None, False, []
        for t, x in zip(g["at"], g["x"]):
            if last is not None and t != last + 1:
                e, up = [], False
            e.append(x * x)
            last = t
            s = sum(v / 4 * 0.75 ** (len(e) - 1 - i) for i, v in enumerate(e) if i)
            l = sum(v / 16 * 0.9375 ** (len(e) - 1 - i) for i, v in enumerate(e) if i)  # noqa: E741
            r = s / l if len(e) > 16 else 0.0
            if not up and r >= 1.6 and (taken is None or t - taken > 10):
                want.append((c, t, round(r, 5)))
                taken = t
            up = r >= 1.6 or (up and r >= 1.0)
    assert want and sorted((r.channel, r.at, round(r.ratio, 5)) for r in got.itertuples()) == sorted(want)


def test_assignment_forgets_nothing_that_matters(spark):
    got = {(r.network, r.event_id): (r.event, r.role) for r in detectors.event_assignment(spark, SF).collect()}
    d = detectors._network(spark, SF).toPandas().sort_values(["t", "event_id"])
    assert len(got) == len(d)
    for network, g in d.groupby("network"):
        found = []
        for r in g.itertuples():
            own = [k for k, e in enumerate(found) if not r.restart and len(e) >= 3 and r.station in e and 0 < r.t - e[r.station].t <= 3600]
            if own:
                assert got[network, r.event_id] == (own[0], "coda")
                continue
            km = lambda a: locate.km_between(np.array([a.lat]), np.array([a.lon]), np.array([r.lat]), np.array([r.lon]))[0, 0]
            fits = [k for k, e in enumerate(found) if r.station not in e and all(abs(a.t - r.t) <= km(a) / 6 + 300 for a in e.values())]
            k = max(fits, key=lambda k: (len(found[k]) >= 3, len(found[k]), -k)) if fits else len(found)
            if not fits:
                found.append({})
            found[k][r.station] = r
            assert got[network, r.event_id] == (k, {1: "first", 3: "declares"}.get(len(found[k]), "joined"))


@pytest.mark.parametrize("seed", range(6))
def test_consistent_choice(seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame([(s, 10 * s + k, float(rng.uniform(0, 25)), 38 + s * 0.2, 28 + s * 0.1) for s in range(5) for k in range(3)], columns=["station", "id", "at", "lat", "lon"])
    fits = lambda a, b: abs(a.at - b.at) <= locate.km_between(np.array([a.lat]), np.array([a.lon]), np.array([b.lat]), np.array([b.lon]))[0, 0] / 6 + 3
    all_ = [c for c in itertools.product(*[list(g.itertuples()) for _, g in rows.groupby("station")]) if all(fits(a, b) for a, b in itertools.combinations(c, 2))]
    got = events.consistent_choice(rows)
    assert (got is None) == (not all_)
    assert got is None or got in [[r.id for r in c] for c in all_]


def test_real_events_are_not_merged():
    place = np.array([[38.0, 28.0], [38.4, 28.1], [38.1, 28.6], [38.5, 28.5], [37.8, 28.4]])
    at = lambda la, lo, t0: t0 + np.hypot(locate.km_between(np.array([la]), np.array([lo]), place[:, 0], place[:, 1])[0], 10) / 6
    frame = lambda t, own: pd.DataFrame({"station": range(5), "lat": place[:, 0], "lon": place[:, 1], "p_time": t, "own": own})
    assert events.merged(pd.concat([frame(at(38.2, 28.3, 0), False), frame(at(37.9, 28.1, 12), True)])) is None  # five shared
    a, b = frame(at(38.2, 28.3, 0), False), frame(at(37.9, 28.1, 12), True)
    assert events.merged(pd.concat([a, b[b.station < 3]])) is None  # the first would lose two
    assert events.merged(pd.concat([a, frame(at(38.2, 28.3, 50), True)[:2]])) is None  # beyond the window


def test_merged_tries_few_grids(monkeypatch):
    """The choices of random pairs as of whole grids, of which only those that may fit are searched."""
    from tremolo.operators import grid

    rng, searched, tried, merges = np.random.default_rng(5), [], [], 0
    source = grid.Observed.source
    monkeypatch.setattr(grid.Observed, "source", lambda self, *a: searched.append(1) or source(self, *a))

    def plain(theirs, own, most_rms=1.0):
        fits = lambda use: tried.append(1) or locate.one_source_rms(pd.concat(use).reset_index(drop=True))
        shared = sorted(set(theirs.station) & set(own.station))
        give_up = 1 if len(theirs) >= 4 and fits([theirs]) <= most_rms else len(theirs)
        for picked in itertools.product([False, True], repeat=len(shared)):
            late = {s for s, p in zip(shared, picked) if p}
            a, b = theirs[~theirs.station.isin(late)], own[~own.station.isin(set(shared) - late)]
            for k in range(-1, len(a) + len(b)):
                x, y = a.drop(a.index[k : k + 1]) if 0 <= k < len(a) else a, b.drop(b.index[k - len(a) : k - len(a) + 1]) if k >= len(a) else b
                if len(late) + len(a) - len(x) <= give_up and len(x) + len(y) >= 4 and len(y) >= 2 and len(x) and (rms := fits([x, y])) <= most_rms:
                    return x.station.tolist(), y.station.tolist(), rms
        return None

    for case in range(12):
        place = np.c_[rng.uniform(37.7, 38.3, 6), rng.uniform(27.7, 28.3, 6)]
        km = locate.km_between(np.array([38.0]), np.array([28.0]), place[:, 0], place[:, 1])[0]
        f = pd.DataFrame({"station": range(6), "lat": place[:, 0], "lon": place[:, 1], "p_time": np.hypot(km, 10) / 6 + rng.normal(0, 0.4, 6)})
        a, b = f[:4].copy(), f[3 - case % 2 :].copy()
        a.loc[case % 4, "p_time"] -= case % 3 * 5.0
        b["p_time"] += case % 2 * (10.0 + 7 * (b["station"] - 3))
        got, want = events.merged(pd.concat([a.assign(own=False), b.assign(own=True)])), plain(a, b)
        assert (got is None) == (want is None)
        if got is not None:
            merges += 1
            assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-6
    assert merges >= 4 and len(searched) < len(tried) / 2


def test_verdicts_hold_no_frame_for_each_event(spark, monkeypatch):
    """Verdicts by the batch as one by one, nulls and far picks among them; ``assess`` itself is not called in tasks."""
    rng = np.random.default_rng(6)
    made = []
    for e in range(30):
        n = int(rng.integers(1, 5))
        place = np.c_[rng.uniform(37.7, 38.3, n), rng.uniform(27.7, 28.3, n)]
        way = np.hypot(locate.km_between(np.array([38.0]), np.array([28.0]), place[:, 0], place[:, 1])[0], 10)
        late = rng.choice([0.0, 0.0, 0.0, 12.0, 60.0], n)
        for k in range(n):
            known = rng.random() < 0.5
            made.append((e, k, *map(float, place[k]), float(way[k] / 6), float(way[k] / 3.5 + late[k]), float(math.log(way[k])) if known else None, 0.3 if known else None, [None, 0.001, 0.5][e % 3]))
    names = ["event", *events.PICKS]
    df = spark.createDataFrame(made, "event bigint, station bigint, lat double, lon double, p_time double, s_time double, log_km double, log_sd double, chance double")
    frame = pd.DataFrame(made, columns=names)
    want = {e: events.assess(part) for e, part in frame.groupby("event")}
    got = {r["event"]: r.asDict() for r in events.assessments(df, "event").collect()}
    same = lambda x, y: x == y or (x is not None and y is not None and not isinstance(x, str) and abs(x - y) < 1e-9)
    assert set(got) == set(want) and all(same(got[e][c], v) for e, w in want.items() for c, v in w.items())
    assert len({w["verdict"] for w in want.values()}) == 4
    assert "FlatMapGroupsInPandas" not in events.assessments(df, "event")._jdf.queryExecution().toString()


def test_disagreeing_pair_needs_an_objection():
    rows = pd.DataFrame({"station": [1, 2], "lat": [38.0, 38.1], "lon": [28.0, 28.0], "p_time": [10.0, 11.0], "s_time": [12.0, 25.0], "log_km": [None, None], "log_sd": [None, None], "chance": [None, None]})
    assert events.assess(rows)["verdict"] == "unclassified"
    assert events.assess(rows.assign(chance=0.5))["verdict"] == "misfire"
    assert events.assess(rows.assign(s_time=[90.0, 90.0]))["verdict"] == "unclassified"  # too far to be this event's


def test_censored_fit_recovers_a_relation(spark):
    n = 4000
    x = RNG.normal(0, 1, (n, 2))
    y = 1.5 - 0.8 * x[:, 0] + 0.3 * x[:, 1] + RNG.normal(0, 0.5, n)
    floor = 1.0
    df = spark.createDataFrame([(1.0, *map(float, r), float(max(v, floor)), bool(v < floor)) for r, v in zip(x, y)], "one double, a double, b double, y double, c boolean").repartition(3)
    f = censored.fit_censored(df, "y", ["one", "a", "b"], "c")
    assert f.converged and f.rows == n and f.censored == int((y < floor).sum()) > 500
    assert np.allclose(f.coefficients, [1.5, -0.8, 0.3], atol=0.05) and abs(f.sigma - 0.5) < 0.03
    xs = np.column_stack([np.ones(n), x])

    def value(b, s):
        z = (np.maximum(y, floor) - xs @ b) / s
        return sum(math.log(0.5 * math.erfc(-u / math.sqrt(2))) if v < floor else -0.5 * u * u - math.log(s) for u, v in zip(z, y))

    best = value(np.array(f.coefficients), f.sigma)
    for k, h in itertools.product(range(4), (-1e-3, 1e-3)):
        b, s = np.array(f.coefficients), f.sigma
        if k < 3:
            b[k] += h
        else:
            s += h
        assert value(b, s) < best
    with pytest.raises(ValueError):
        censored.fit_censored(df.where("c"), "y", ["one"], "c")


def test_bidirectional_memory(spark):
    got = detectors.bidirectional_memory(spark, SF).toPandas().set_index(["vec_id", "token", "unit"])["v"]
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def run(tokens, w, u, b):
        y, c, out = np.zeros(2), np.zeros(2), []
        for t in tokens:
            i, f, g, o = np.split(np.array(w) @ t + np.array(u) @ y + np.array(b), 4)
            c = logistic(f) * c + logistic(i) * np.tanh(g)
            y = logistic(o) * np.tanh(c)
            out.append(y)
        return np.array(out)

    for r in detectors._x(spark, SF).limit(5).collect():
        t = np.array(r.x).reshape(8, 8)
        want = np.hstack([run(t, *detectors._memory(0)), run(t[::-1], *detectors._memory(1))[::-1]])
        assert np.allclose(got.loc[r.vec_id].to_numpy().reshape(8, 4), want, atol=2e-6)


def test_recursions_of_mixed_lengths(spark):
    from pyspark.sql import functions as F

    from tremolo.functions import arrays

    low = arrays.butterworth("low", 10.0, 100.0)
    rows = [(k, [float(v) for v in RNG.normal(0, 1, n)] if n is not None else None) for k, n in enumerate((0, 1, 2, 5, 40, 40, None, 300))]
    df = spark.createDataFrame(rows, "k int, x array<double>").repartition(2)
    y = df.select("k", arrays.biquads(F.col("x"), low).alias("y"), arrays.prefix_sum(F.col("x")).alias("s"), arrays.filtfilt(F.col("x"), low, 15).alias("z"), arrays.condition(F.col("x"), low, 15).alias("c"), arrays.sta_lta(F.col("x"), 4, 16).alias("r"), arrays.displacement(F.col("x"), low, 100.0).alias("d"))
    for r in y.collect():
        x = rows[r.k][1]
        assert all(v is None for v in r[1:]) if x is None else all(len(v) == len(x) for v in r[1:])
        if x:
            assert np.allclose(r.s, np.cumsum(x))
            z = x
            for (b0, b1, b2), (a1, a2) in low:
                g, out = lambda q, j: q[j] if j >= 0 else 0.0, []
                for i in range(len(z)):
                    out.append(b0 * z[i] + b1 * g(z, i - 1) + b2 * g(z, i - 2) - a1 * g(out, i - 1) - a2 * g(out, i - 2))
                z = out
            assert np.allclose(r.y, z)
    flat = spark.createDataFrame([([5.0] * 30,)], "x array<double>").select(arrays.filtfilt(F.col("x"), low, 15).alias("z")).first().z
    assert np.allclose(flat, 5.0)


def test_paired_test_is_exact(spark):
    from tremolo.plans import stats

    n = stats.mcnemar_counts(spark, SF).first()
    r = stats.paired_test(spark, SF).first()
    pairs, least = n.only_a + n.only_b, min(n.only_a, n.only_b)
    assert r.p == pytest.approx(min(1.0, 2 * sum(math.comb(pairs, i) for i in range(least + 1)) / 2**pairs), abs=1e-6)
    total, k = n.both + n.only_a + n.only_b + n.neither, n.both + n.only_a
    tail = lambda p, ks: sum(math.exp(math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) + i * math.log(p) + (total - i) * math.log1p(-p)) for i in ks)
    if 0 < k < total:
        assert tail(r.low, range(k, total + 1)) == pytest.approx(0.025, rel=0.05) and tail(r.high, range(k + 1)) == pytest.approx(0.025, rel=0.05)
