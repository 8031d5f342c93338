"""Locators, sizes and signal chains against plain loops."""

import math

import numpy as np
import pandas as pd

from tests.conftest import SF, duck
from tremolo.functions import arrays
from tremolo.operators import fold, locate
from tremolo.plans import driver


def naive_km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def network(n, seed, noise=0.0):
    rng = np.random.default_rng(seed)
    la, lo = 38 + rng.random(), 30 + rng.random()
    lat, lon = la + rng.uniform(-0.6, 0.6, n), lo + rng.uniform(-0.6, 0.6, n)
    km = np.array([naive_km(la, lo, a, b) for a, b in zip(lat, lon)])
    t = lambda v: 50 + np.hypot(km, 10) / v + rng.normal(0, noise, n)
    return (la, lo), pd.DataFrame({"station": np.arange(n), "lat": lat, "lon": lon, "p_time": t(6.0), "s_time": t(3.5), "log_km": np.log(np.maximum(km, 1)) + rng.normal(0, noise / 10, n), "log_sd": 0.3})


def test_best_node_is_the_naive_one():
    for seed in range(3):
        _, rows = network(4, seed, 0.4)
        for method in locate.METHODS:
            make, least = locate.METHODS[method]
            o = make(rows)
            got = locate.fit(o, least, (0.4, 0.1), (0.1, 0.02))

            def misfit(la, lo):
                d = [naive_km(la, lo, a, b) for a, b in zip(o.lat, o.lon)]
                r = [t - math.hypot(x, 10) / v for t, x, v in zip(o.time, d, o.speed)]
                m = sum(r) / len(r)
                return sum((x - m) ** 2 / 2 + ((math.log(max(y, 1)) - k) / s) ** 2 / 2 for x, y, k, s in zip(r, d, o.log_km, o.log_sd))

            la, lo = rows.lat.mean(), rows.lon.mean()
            for half, n, step in ((0.4, 9, 0.1), (0.1, 11, 0.02)):
                la, lo = min(((la + a * step - half, lo + b * step - half) for a in range(n) for b in range(n)), key=lambda p: misfit(*p))
            assert abs(got.lat - la) < 1e-9 and abs(got.lon - lo) < 1e-9 and got.stations == 4


def test_stations_enough_and_the_late_one_left_out():
    (la, lo), rows = network(6, 7)
    rows.loc[2, ["p_time", "s_time"]] += 20
    f = locate.refit(locate.picks(rows), 2)
    assert f.dropped == [2] and naive_km(f.lat, f.lon, la, lo) < 1 and f.rms < 0.1 and f.error_km > 0
    assert locate.fit(locate.first_arrivals(rows[:2]), 3) is None and locate.fit(locate.picks(rows[:1]), 2) is None
    assert math.isnan(locate.fit(locate.first_arrivals(rows), 3).z) and locate.fit(locate.geometry(rows), 3).z > 0
    assert locate.refit(locate.geometry(rows[:3]), 3).dropped == []
    assert locate.one_source_rms(rows) > 1 > locate.one_source_rms(rows.drop(2))


def test_normal_tail_and_posterior():
    for z in (-30.0, -20.1, -19.9, -5.0, 0.0, 3.0):
        want = math.log(0.5 * math.erfc(-z / math.sqrt(2)))
        assert abs(locate.log_normal_cdf(np.array([z]))[0] - want) < 1e-4 * max(1, abs(want))
    y, base, censored = np.array([4.8, 5.0, 4.7]), np.array([-0.3, -0.1, -0.2]), np.array([False, False, True])
    weights = []
    for k in range(751):
        m = 1 + 0.01 * k
        p = 10**-m
        for a, b, c in zip(y, base, censored):
            z = (a - b - m) / 0.3
            p *= 0.5 * math.erfc(-z / math.sqrt(2)) if c else math.exp(-z * z / 2)
        weights.append(p)
    total = sum(weights)
    mean, sd, shares = locate.size_posterior(y, base, censored)
    assert abs(mean - sum(w * (1 + 0.01 * k) for k, w in enumerate(weights)) / total) < 1e-9 and sd > 0
    assert abs(sum(shares) - 1) < 1e-9 and abs(shares[0] - sum(weights[:350]) / total) < 1e-9
    assert locate.size_posterior(y, base, np.ones(3, bool)) is None


def test_censored_size_query(spark):
    got = driver.QUERIES["censored_size"](spark, SF).toPandas().set_index("event")
    o = duck("select o_custkey % 500 as event, o_orderkey as k, log10(o_totalprice) as y from orders where o_custkey % 10 = 0")
    for event, rows in o.groupby("event"):
        found = locate.size_posterior(np.maximum(rows.y.to_numpy(), 4.7), -0.3 * (1 + rows.k.to_numpy() % 3), rows.y.to_numpy() < 4.7)
        assert (found is None) == (event not in got.index)
        if found:
            assert abs(got.loc[event, "mean"] - found[0]) < 1e-5 and got.loc[event, "n"] == len(rows)


def test_emit_on_change(spark):
    got = driver.QUERIES["emit_on_change"](spark, SF).toPandas()
    e = duck("select user_id as station, epoch_us(ts) as us, event_id, value / 100 as mean, (event_type = 'error')::int as n from events order by station, us, event_id")
    want, last, station = [], None, None
    for r in e.itertuples():
        if r.station != station:
            station, last = r.station, None
        if last is None or abs(r.mean - last[0]) >= 1 or r.n != last[1]:
            want.append(r.event_id)
            last = (r.mean, r.n)
    assert sorted(got.event_id) == sorted(want)
    step = fold.change_step("m", "n", 0.1, ["m"])
    assert step(None, pd.DataFrame({"m": [1.0, 1.05, 1.11, 1.11], "n": [3, 3, 3, 4]}))[1].m.tolist() == [1.0, 1.11, 1.11]


def test_displacement(spark):
    (b, a), _ = arrays.butterworth("high", 0.5, 100.0)
    got = driver.QUERIES["displacement"](spark, SF).toPandas().sort_values(["vec_id", "i"])

    def section(x):
        gain = (b[0] + b[1] + b[2]) / (1 + a[0] + a[1])
        p, q, out = 0.0 * gain, 0.0, []
        for v in x:
            y = b[0] * v + p
            p, q = b[1] * v - a[0] * y + q, b[2] * v - a[1] * y
            out.append(y)
        return np.array(out)

    e = duck("select vec_id, embedding from embeddings order by vec_id limit 5")
    for r in e.itertuples():
        x = np.array(r.embedding, float)
        want = section(np.cumsum(section(x - x[0])) / 100)
        assert np.allclose(got[got.vec_id == r.vec_id].v.to_numpy(), want, atol=2e-6)
