"""Ordered release against a clock that ticks, explanation against loops; awkward rows."""

import math
import random

import pytest

from tests.conftest import SF, rows
from tremolo.functions import inference
from tremolo.operators import explain, fold, rates, release, rematch, report, sizes
from tremolo.plans import driver, review


def _plain(messages, wait):
    """A clock that ticks: at every tick the rows of that tick come in, one after another, and what may go out does."""
    promise, lagging, held, last, out = {}, set(), [], None, []

    def look(now):
        nonlocal last, held
        while held:
            held.sort()
            t, station, seq, got, key = held[0]
            back = [s for s in promise if s not in lagging and not promise[s] > t]
            if back and now < got + wait:
                return
            if back:
                for s in sorted(back):
                    lagging.add(s)
                    out.append(("lagging", None, s, now, False))
                continue
            held = held[1:]
            out.append(("message", key, station, now, last is not None and (t, station, seq) < last))
            last = max(last or (t, station, seq), (t, station, seq))

    def caught(now):
        for s in sorted(lagging):
            if last is not None and promise[s] > last[0]:
                lagging.remove(s)
                out.append(("caught", None, s, now, False))

    for now in range(messages[0][-1], messages[-1][-1] + 1):
        look(now)
        caught(now)
        for kind, station, t, seq, key, _ in [m for m in messages if m[-1] == now]:
            if kind == "bye":
                promise.pop(station, None)
                lagging.discard(station)
            else:
                promise.setdefault(station, -math.inf)
            if kind in ("message", "progress"):
                promise[station] = max(promise[station], t)
            if kind == "message":
                held.append((t, station, seq, now, key))
            look(now)
            caught(now)
    return out


def _messages(seed, stations=4, n=120):
    r = random.Random(seed)
    out = [("hello", s, None, 0, None, 0) for s in range(stations)]
    for k in range(n):
        s = r.randrange(stations)
        t = 10 * k + r.randrange(30)
        slow = 400 if s == 0 and 40 < k < 80 else 0  # a station that falls behind and comes back
        out.append((r.choice(["message", "message", "progress"]), s, t, k, k, t + 5 + r.randrange(25) + slow))
    out = sorted(out, key=lambda m: (m[-1], m[3], m[1]))
    return [*out, *[("bye", s, None, n, None, out[-1][-1] + 1) for s in range(stations)]]


@pytest.mark.parametrize("seed, wait", [(1, 30), (2, 60), (3, 200), (4, 10_000), (5, 0)])
def test_release_against_a_ticking_clock(spark, seed, wait):
    m = _messages(seed)
    want = _plain(m, wait)
    assert sorted(x[1] for x in want if x[0] == "message") == sorted(x[4] for x in m if x[0] == "message")  # all go out
    if wait == 30:
        assert {x[0] for x in want} == {"message", "lagging", "caught"} and any(x[4] for x in want)
    if wait == 10_000:
        assert {x[0] for x in want} == {"message"}
    whole = release.Release(wait)
    assert [(a, b, c, e, f) for x in m for a, b, c, _, e, f in whole.offer(*x)] == want
    df = spark.createDataFrame([(7, *x) for x in m] + [(None, *x) for x in m], "network long, kind string, station long, t long, seq long, id long, at long").repartition(5)
    junk = spark.createDataFrame([(7, None, 1, 5, 1, 1, 5), (7, "message", None, 5, 1, 1, 5), (7, "message", 1, None, 1, 1, 3)], df.schema)
    got = fold.ordered_fold(df.unionByName(junk), ["network"], ["at", "seq", "station"], release.release_step("network", wait), f"network bigint, {release.RELEASED}").collect()
    for network in (7, None):
        assert [(r.what, r.id, r.station, r.released, r.disordered) for r in got if r.network == network] == want
    assert fold.ordered_fold(df.where("false"), ["network"], ["at"], release.release_step("network", wait), f"network bigint, {release.RELEASED}").count() == 0


def test_release_on_a_stream_is_the_batch(spark):
    a, b = (driver.QUERIES[q](spark, SF).toPandas() for q in ("stream_ordered_release", "ordered_release"))
    assert len(a) and rows(a) == rows(b)


TIERS = [(5.0, 90.0), (3.0, 2.0)]


def _times(degrees, depth):
    from pyspark.sql import functions as F

    return {"P": degrees * 20 + depth / 10, "S": F.when(degrees < 5, degrees * 35 + depth / 6)}


def _explained(alarms, events, tolerance, need, longest, shift):
    out = {}
    for alarm, seen in alarms.items():
        best = near = None
        us = [u + shift * 1_000_000 for _, u, _, _ in seen]
        for cat_id, at, lat, lon, depth, size in events:
            if None in (at, lat, lon) or not min(us) - longest * 1e6 <= at <= max(us) + tolerance * 1e6:
                continue
            depth = 10.0 if depth is None else min(max(depth, 0.0), 700.0)
            for phase in "PS":
                res = []
                for (_, _, la, lo), u in zip(seen, us):
                    h = math.sin(math.radians(la - lat) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lat)) * math.sin(math.radians(lo - lon) / 2) ** 2
                    deg = math.degrees(2 * math.asin(math.sqrt(h)))
                    if size is not None and any(size >= m and deg <= r for m, r in TIERS) and (phase == "P" or deg < 5):
                        res.append(round(abs(u - at - 1e6 * (deg * 20 + depth / 10 if phase == "P" else deg * 35 + depth / 6))))
                res.sort()
                ok = [x for x in res if x <= tolerance * 1e6]
                if len(ok) >= need:
                    best = min(best or (1e18,), (round(sum(ok) / len(ok)), at, cat_id, phase, len(ok)))
                if len(res) >= need:
                    near = min(near or (1e18,), (res[need - 1], at, cat_id, phase))
        out[alarm] = (best and (best[2], best[3], best[4]), near and (near[2], near[3], near[0] / 1e6))
    return out


def test_explain_against_loops(spark):
    r = random.Random(8)
    events = [(k, int(r.uniform(0, 3000) * 1e6), r.uniform(36, 40), r.uniform(26, 32), r.choice([None, -5.0, 30.0, 900.0]), r.choice([2.0, 3.5, 6.0, None])) for k in range(60)]
    events += [(99, None, 38.0, 28.0, 1.0, 6.0), (98, 10**9, None, 28.0, 1.0, 6.0)]
    alarms = {}
    for a in range(25):
        k = r.choice(events[:60])
        alarms[a] = [(s, int(k[1] + 1e6 * r.choice([20, 40, 60]) + r.uniform(-4e6, 4e6)), r.uniform(36, 40), r.uniform(26, 32)) for s in range(r.choice([1, 2, 5]))]
    d = spark.createDataFrame([(a, *x) for a, seen in alarms.items() for x in seen] + [(77, 1, None, 38.0, 28.0), (3, 9, 5, None, 28.0)], "alarm long, station long, us long, lat double, lon double").repartition(4)
    c = spark.createDataFrame(events, "cat_id long, cat_us long, cat_lat double, cat_lon double, depth double, size double").withColumn("alarm_text", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("more"))
    for need in (1, 2):
        got = explain.explain(d, c, _times, TIERS, 15.0, need, 300.0, (0, 200)).collect()
        assert len(got) == 50
        for shift in (0, 200):
            want = _explained(alarms, events, 15.0, need, 300.0, shift)
            for x in (g for g in got if g["shift"] == shift):
                best, near = want[x.alarm]
                assert (x.best and (x.best, x.phase, x.stations)) == best
                assert (x.near is None) == (near is None) and (near is None or ((x.near, x.near_phase) == near[:2] and abs(x.near_s - near[2]) < 1e-5))
        assert any(g.best is not None for g in got) and any(g.best is None and g.near is not None for g in got)
    assert explain.explain(d.where("false"), c, _times, TIERS).count() == 0
    assert [x.best for x in explain.explain(d, c.where("false"), _times, TIERS).collect()] == [None] * 25


def test_exact_tests_of_counts():
    from fractions import Fraction

    for n, p in ((1, 0.3), (57, 0.01), (57, 0.9), (300, 0.37)):
        terms = [Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(n + 1)]
        for k in range(-1, n + 1):
            assert abs(inference.binomial_cdf(k, n, p) - float(sum(terms[: k + 1]))) < 1e-12
    low, high = inference.clopper_pearson(3, 10)
    assert (round(low, 4), round(high, 4)) == (0.0667, 0.6525) and inference.clopper_pearson(0, 5)[0] == 0 and inference.clopper_pearson(5, 5)[1] == 1
    assert abs(inference.mcnemar(700, 650) - min(1, 2 * sum(Fraction(math.comb(1350, i)) for i in range(651)) / 2**1350)) < 1e-12
    ratio, low, high, p = inference.poisson_ratio(0, 5.0, 0, 5.0)
    assert math.isnan(ratio) and (low, high, p) == (0.0, math.inf, 1.0)
    assert inference.poisson_ratio(4, 5.0, 0, 5.0)[::2] == (math.inf, math.inf) and abs(inference.poisson_ratio(4, 5.0, 0, 5.0)[3] - 0.125) < 1e-12


def test_rates_with_rows_of_one_window_and_none(spark):
    one = [("x", w, 6.0, w % 3, 2) for w in range(20)] + [(None, 1, 5.0, 4, 0), ("z", 1, None, 1, 1)]
    whole = spark.createDataFrame(one, "g string, window long, hours double, a long, b long")
    cut = [(g, w, h, None, b) for g, w, h, _, b in one] + [(g, w, 0.0, a, None) for g, w, _, a, _ in one]
    parts = spark.createDataFrame(cut, whole.schema).repartition(3)
    a, b = (rates.compare_rates(x, ["g"], 200).toPandas() for x in (whole, parts))
    assert rows(a.drop(columns="hours").replace(math.inf, 1e18)) == rows(b.drop(columns="hours").replace(math.inf, 1e18)) and len(a) == 3
    x = a[a.g == "x"].iloc[0]
    assert (x.hours, x.a, x.b) == (120, 19, 40) and x.ratio == 19 / 40 and x.low < 19 / 40 < x.high and x.ratio_low <= 19 / 40 <= x.ratio_high and x.b_per_day_low == x.b_per_day_high == 8
    n = a[a.g.isna()].iloc[0]
    assert n.ratio == math.inf and n.high == math.inf and abs(n.p - 0.125) < 1e-12
    assert math.isnan(a[a.g == "z"].iloc[0].p)
    assert rates.compare_rates(whole.where("false"), ["g"]).count() == 0


def _told(seed, n=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        what = r.choice(["peak", "peak", "peak", "quiet", "distance", "location", "first_location"])
        out.append((what, k // 2, r.randrange(5), r.uniform(38, 39), r.uniform(28, 29), 7.0 if k % 29 == 28 else r.choice([1.0, 1.0, 1.0, 2.0]), 10 ** r.uniform(-6, -3), 10 ** r.uniform(-6, -5), r.uniform(5, 200), r.choice([None, 5.0, 50.0])))
    return out


def _sizes(told, model):
    """Everything reckoned anew at every row, sizes on a list."""
    grid = [1 + 0.01 * k for k in range(751)]
    out, said, count, first = [], None, None, None
    for k, (what, at, *_) in enumerate(told):
        seen = told[: k + 1]
        peaks, quiet, km, loc = {}, {}, {}, {}
        for x in seen:
            if x[0] == "peak":
                peaks[x[2]] = x if x[2] not in peaks or x[5] >= peaks[x[2]][5] else peaks[x[2]]
            if x[0] == "quiet":
                quiet[x[2]] = x
            if x[0] == "distance":
                km[x[2]] = x[8]
            if "location" in x[0]:
                loc[x[0]] = x
        if what == "distance" or not peaks:
            continue
        a, b = loc.get("location"), loc.get("first_location")
        place, source = (a, "location") if a and (a[9] is None or a[9] <= 20) else (b, "first_location") if b and b[9] is not None and b[9] <= 20 else (None, "distance")
        if place:
            h = lambda x: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(x[3] - place[3]) / 2) ** 2 + math.cos(math.radians(x[3])) * math.cos(math.radians(place[3])) * math.sin(math.radians(x[4] - place[4]) / 2) ** 2))  # noqa: B023, E731
            used = [(x, h(x), True) for x in peaks.values()] + [(x, h(x), False) for s, x in quiet.items() if s not in peaks]
        else:
            used = [(x, km[s], True) for s, x in peaks.items() if s in km]
        logs, n, above = [-model.b_value * math.log(10) * m for m in grid], 0, 0
        for x, d, _ in used:
            r = next((r for r in model.relations if r.tau == x[5]), None)
            term, usual = model.terms.get((x[2], x[5]), 0.0), model.noise.get(x[2])
            if r is None or abs(term) > model.most_term or (usual and not usual / 10 <= x[7] <= usual * 10):
                continue
            n, up = n + 1, x[6] >= r.least_snr * x[7]
            above += up
            y = math.log10(x[6] if up else r.least_snr * x[7])
            lr = math.log10(math.hypot(d, r.depth))
            base = r.constant + r.log_km * lr + sum(g * max(0, lr - math.log10(c)) for g, c in r.beyond) + term
            for i, m in enumerate(grid):
                z = (y - base - r.slope * m - r.above * max(0, m - r.knot)) / r.sigma
                logs[i] += -z * z / 2 - math.log(r.sigma * math.sqrt(2 * math.pi)) if up else math.log(math.erfc(-z / math.sqrt(2)) / 2) if z > -30 else -1e4
        if not above:
            continue
        p = [math.exp(x - max(logs)) for x in logs]
        mean = sum(a * m for a, m in zip(p, grid)) / sum(p)
        first = first or (mean, at)
        if said is None or abs(mean - said) >= 0.1 or n != count:
            said = mean
            out.append((at, round(mean, 6), n, above, max(x[5] for x, _, own in used if own), source, round(first[0], 6), first[1]))
        count = n
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sizes_reckoned_anew(spark, seed):
    rows_of = {e: _told(seed * 10 + e) for e in range(3)}
    model = review.MODEL
    data = [(e, *x, k) for e, told in rows_of.items() for k, x in enumerate(told)]
    schema = "event long, what string, at long, station long, lat double, lon double, tau double, peak double, noise double, km double, error double, k long"
    junk = [(1, w, 5, None, None, None, None, None, None, None, None, -1) for w in ("peak", "quiet", "distance", "location", None)]
    df = spark.createDataFrame(data + junk, schema).repartition(4)
    r = fold.ordered_fold(df, ["event"], ["at", "k"], sizes.report_step("event", model), f"event long, {sizes.REPORT}").collect()
    for e, told in rows_of.items():
        got = [(x.at, round(x["mean"], 6), x.stations, x.above, x.tau, x.distances, round(x["first"], 6), x.first_at) for x in r if x.event == e]
        want = _sizes(told, model)
        assert len(want) > 3 and len(got) == len(want)
        for g, w in zip(got, want):
            assert g[2:6] == w[2:6] and g[0] == w[0] and g[7] == w[7] and abs(g[1] - w[1]) < 1e-5 and abs(g[6] - w[6]) < 1e-5
    assert all(abs(x.p_small + x.p_medium + x.p_large - 1) < 1e-9 for x in r)
    assert fold.ordered_fold(df.where("false"), ["event"], ["at", "k"], sizes.report_step("event", model), f"event long, {sizes.REPORT}").count() == 0


def test_sizes_of_short_keys_by_the_batch(spark):
    """Many short events, one without a key, and batches that cut them: the rows of the fold key by key."""
    data = [(None if e == 4 else e, *x, k) for e in range(9) for k, x in enumerate(_told(40 + e)[: 3 + 5 * e])]
    schema = "event long, what string, at long, station long, lat double, lon double, tau double, peak double, noise double, km double, error double, k long"
    df = spark.createDataFrame([*data, (1, "peak", 5, None, None, None, 1.0, float("nan"), 1.0, None, None, -1)], schema)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        want = fold.ordered_fold(df, ["event"], ["at", "k"], sizes.report_step("event", review.MODEL), f"event long, {sizes.REPORT}").toPandas()
        got = sizes.reports(df, "event", ["at", "k"], review.MODEL).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(want) > 20 and sorted(map(str, got.round(9).itertuples(index=False))) == sorted(map(str, want.round(9).itertuples(index=False)))


H = 3_600_000_000


def test_report_of_awkward_rows(spark, tmp_path):
    a = spark.createDataFrame([(1, H, 3, 10), (2, 2 * H, 2, 10), (3, 3 * H + 5_000, 4, None), (4, 3 * H, 1, None), (5, 5 * H, 2, 12)], "alarm long, declared long, stations long, event long").repartition(3)
    e = spark.createDataFrame([(10, H - 2_500_000, 3.25, 7.5), (11, 4 * H, None, None), (12, 5 * H - 4_000_000, 1.0, 1.0), (13, 86_399_999_600, 2.0, 0.4)], "event long, us long, size double, km double").repartition(2)
    got = sorted((tuple(r) for r in report.lines(a, e, [1.5, 3.0]).collect()), key=lambda r: r[:3])
    text = lambda n: [r[3] for r in got if r[0] == n]
    assert [x.split() for x in text(0)] == [["alarms", "5"], ["correct", "(match", "an", "event)", "3", "60.0%"], ["false", "(no", "event)", "2", "40.0%"], ["events", "4"], ["detected", "2", "50.0%"], ["missed", "2", "50.0%"]]
    assert [x.split() for x in text(1)] == [["below", "1.5", "1", "1", "0"], ["1.5", "to", "3", "1", "0", "1"], ["3", "and", "more", "1", "1", "0"]]
    assert text(2) == ["alarm after the event, median           3.3 s"]  # of 2.5 and 4 seconds: 3.25
    assert [x.split() for x in text(3)] == [["04:00:00.00", "UTC", "?", "?", "km"], ["00:00:00.00", "UTC", "2.0", "0", "km"]]
    assert text(4) == ["03:00:00.00 UTC  #4  1 stations", "03:00:00.00 UTC  #3  4 stations"]
    report.write_lines(report.lines(a, e, [1.5, 3.0]), f"{tmp_path}/report", 3)
    files = sorted((tmp_path / "report").glob("part-*.txt"))
    assert len(files) == 3 and [x for f in files for x in f.read_text().splitlines()] == [r[3] for r in got]
    none = [r.line.split() for r in report.lines(a.where("false"), e.where("false"), [1.0]).orderBy("us").collect()]
    assert none[:2] == [["alarms", "0"], ["correct", "(match", "an", "event)", "0", "-%"]] and len(none) == 6
    d = spark.createDataFrame([(1, 8, 100), (1, 7, 2_345_100), (3, 1, 5), (3, 2, None)], "alarm long, station long, us long")
    t = {r.alarm: tuple(r)[1:] for r in report.declared_table(a, d, e).collect()}
    assert t[1] == ("1970-01-01 01:00:00", "3.3 00:59:57.50", "8 7", "8", "7", "2.35") and t[3] == ("1970-01-01 03:00:00", "", "1", "1", "", "") and t[4][1:] == ("", "", "", "", "") and len(t) == 5


def _km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def test_rematch_against_loops(spark):
    r = random.Random(5)
    events = [(k, int(r.uniform(0, 4000) * 1e6), r.uniform(36, 40), r.uniform(26, 32), r.choice([None, 5.0, 60.0])) for k in range(80)]
    dets, alarms = [], []
    for a in range(60):
        e = r.choice(events)
        for s in range(r.choice([0, 1, 3])):
            us = e[1] + int(r.uniform(0, 60) * 1e6)
            dets.append((a, s, us, us + int(r.choice([1, 30]) * 1e6), r.uniform(36, 40), r.uniform(26, 32)))
        alarms.append((a, e[2] + 0.1, e[3], e[1] + int(r.uniform(-4, 8) * 1e6)) if a % 2 else (a, None, None, None))
    times = lambda km, depth: (km / 6 + depth / 50, km / 3 + 1)
    credit, first = {}, {}
    for a, lat, lon, origin in alarms:
        mine, best = [d for d in dets if d[0] == a], None
        for e, at, la, lo, depth in events:
            depth, misses = 10.0 if depth is None else depth, []
            if lat is not None and _km(la, lo, lat, lon) <= 30 and abs(origin - at) <= 5e6:
                misses.append(round(abs(origin - at) / 100))
            misses += [round(abs(d[2] - at - 1e6 * times(_km(la, lo, d[4], d[5]), depth)[0])) for d in mine]
            if misses and min(misses) <= 20e6:
                before = bool(mine) and all(d[3] < at + 1e6 * times(_km(la, lo, d[4], d[5]), depth)[1] for d in mine)
                best = min(best or (1e18,), (min(misses), at, e, before))
        credit[a] = best and best[2]
        if best:
            first.setdefault(best[2], (a, best[3]))
    d = spark.createDataFrame(dets + [(0, 9, None, 1, 38.0, 28.0), (0, 9, 1, 1, None, 28.0)], "alarm long, station long, us long, declared long, lat double, lon double").repartition(3)
    a = spark.createDataFrame(alarms, "alarm long, lat double, lon double, origin long")
    e = spark.createDataFrame(events + [(500, None, 38.0, 28.0, 1.0)], "event long, event_us long, event_lat double, event_lon double, depth double").repartition(2)
    got, scored = rematch.rematch(d, a, e, times, 20.0, 200.0)
    assert {x.alarm: x.event for x in got.collect()} == credit and any(credit.values()) and None in credit.values()
    s = {x.event: (x.alarm, x.detected, x.before) for x in scored.collect()}
    assert s == {k: (*first[k][:1], True, first[k][1]) if k in first else (None, False, False) for k in [*range(80), 500]}
    assert {x[2] for x in s.values() if x[1]} == {True, False}
    none, missed = rematch.rematch(d.where("false"), a.where("false"), e, times, 20.0, 200.0)
    assert none.count() == 0 and missed.where("detected").count() == 0 and missed.count() == 81


def test_prediction_check(spark):
    km = [("a", 1, 8.0), ("a", 2, 8.0), ("a", 3, 1.0), ("a", 3, 1.0), ("b", 1, 30.0), ("b", 2, 60.0), ("c", 1, 5.0), ("d", 1, None), ("d", 2, 3.0), ("e", 1, 9.0), ("e", 2, 5.0), (None, 1, 1.0), (None, 2, 2.0)]
    s = spark.createDataFrame(km, "subset string, station long, km double").repartition(3)
    o = spark.createDataFrame([("a", 5.0), ("b", 20.0), ("c", 1.0), ("d", 1.0), ("e", None), ("z", 3.0)], "subset string, observed_s double")
    p, one = rematch.prediction_check(s, o)
    assert sorted((r.subset, r.predicted_s, r.latency_s) for r in p.collect()) == [("a", round(math.hypot(8, 10) / 6, 6), round(5 - math.hypot(8, 10) / 6, 6)), ("b", round(math.hypot(60, 10) / 6, 6), round(20 - math.hypot(60, 10) / 6, 6))]
    r = one.first()
    assert r.subsets == 2 and abs(r.rho - 1) < 1e-12 and r.q25 < r["median"] < r.q75
    assert [x.subset for x in rematch.worst(p, 1).collect()] == ["b"]
    r = rematch.prediction_check(s, o.where("subset = 'a'"))[1].first()
    assert (r.subsets, r.rho) == (1, None) and r["median"] == r.q25
    r = rematch.prediction_check(s.where("false"), o)[1].first()
    assert (r.subsets, r["median"], r.rho) == (0, None, None)


@pytest.mark.parametrize("seed, events, seconds", [(1, 300, 1200), (2, 40, 9000), (3, 8, 60)])
def test_explained_from_the_residuals_within_the_tolerance(spark, monkeypatch, seed, events, seconds):
    """Alarms among many events, few and hardly any: the rows of the general operator, and events that are too early or too late to
    be near are not looked at where others are."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from tremolo.operators import partners

    draw = np.random.default_rng(seed)
    n = 60
    lat, lon = 36 + draw.integers(0, 601, n + events) / 100, 26 + draw.integers(0, 1201, n + events) / 100
    us = np.r_[draw.integers(0, 300_000_000, n), draw.integers(-seconds * 1_000_000, 300_000_000, events)]
    size = np.r_[np.full(n, np.nan), draw.choice([3.0, 7.0, 30.0, 150.0], events)]
    rows_ = pd.DataFrame({"id": np.arange(n + events), "station": draw.integers(0, 25, n + events), "us": us, "lat": lat, "lon": lon, "event": np.arange(n + events) >= n, "size": size, "depth": np.r_[np.full(n, np.nan), draw.integers(0, 700, events)]})
    by_station = rows_.drop_duplicates("station").set_index("station")
    rows_["lat"], rows_["lon"] = rows_["station"].map(by_station["lat"]), rows_["station"].map(by_station["lon"])
    tiers, looked = [(100.0, 180.0), (20.0, 4.0), (5.0, 1.0)], []
    residuals, ran = explain._residuals, {}
    monkeypatch.setattr(explain.partners, "windows", lambda rows, at, tolerance, answer, schema, near, **_: ran.update(answer=answer, near=near))
    df = spark.createDataFrame(rows_)
    explain.explain_compatible(df, review._phases, tiers, 60.0, 2, 2400.0, (0,), review._latest)
    monkeypatch.undo()
    span = rows_.assign(shift=0).sort_values("us", kind="stable").reset_index(drop=True)
    monkeypatch.setattr(explain, "_residuals", lambda fits, d, e, *a: looked.append(len(d) * len(e)) or residuals(fits, d, e, *a))
    got = ran["answer"](span, [(slice(i, min(i + 30, len(span))), slice(0, len(span))) for i in range(0, len(span), 30)])
    monkeypatch.undo()
    if events == 300:
        assert sum(looked) <= n * events
    d = partners.first_detections(df.where("not event")).withColumn("seen", F.arrays_zip("station", "lat", "lon", "id"))
    d = d.select(F.col("event").alias("alarm"), F.explode("seen").alias("x")).select("alarm", "x.*").join(df.select("id", "us"), "id")
    c = df.where("event").select(F.col("id").alias("cat_id"), F.col("us").alias("cat_us"), F.col("lat").alias("cat_lat"), F.col("lon").alias("cat_lon"), "size", "depth")

    def phases(degrees, depth):
        ray = F.hypot(degrees * 111.195, depth)
        return {"P": F.when(ray < 100, ray / 5.8).otherwise(6.0 + ray / 8.0), "S": F.when(degrees <= 8, F.when(ray < 100, ray / 3.4).otherwise(8.0 + ray / 4.6))}

    want = explain.explain(d, c, phases, tiers, 60.0, 2, 2400.0, (0,)).toPandas()
    assert len(got) > 20 and rows(got) == rows(want) and (events == 8 or got["best"].notna().any())
