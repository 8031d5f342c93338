"""Queries whose work must grow with their tables: on events that lie very close together no step may make more than a few
rows for each row read, and the result is still that of the SQL."""

import os

import pytest

from tests.conftest import SF, duck, rows
from tremolo.plans import driver

#: Copies of the events below, and how much closer they lie.
COPIES, CLOSER = 3, 100
#: By query, the rows that its largest step may make for each row of events.
LINEAR = {
    "catalogue_match_best": 6,
    "nearest_pick": 6,
    "paired_latency": 6,
    "score_left": 6,
    "first_after_latency": 6,
    "station_level": 6,
    "quiet_filter": 4,
    "visible_arrivals": 2,
    "external_candidates": 6,
    "association_scorecard": 6,
    "chance_probability": 6,
    "classify_unmatched": 6,
    "declare_events": 6,
    "associated_stations": 6,
    "exact_pair": 6,
    "best_pair": 12,
    "explain_k_of_n": 12,
    "warning_summary": 4,
    "shift_outcomes": 12,
    "alarm_report": 6,
    "alarm_table": 6,
    "rematch_times": 6,
    "alarm_detections": 8,
    "locate_first_arrivals": 6,
    "locate_check": 6,
    # next
}


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """The smallest tables with ``COPIES`` copies of the events, four times as large, in a hundredth of the time, none at the same time."""
    import duckdb

    d = tmp_path_factory.mktemp("dense")
    for f in os.listdir(SF):
        if f != "events.parquet":
            os.symlink(f"{SF}/{f}", d / f)
    sql = f"""SELECT event_id + i * 1000 AS event_id, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // {CLOSER} + i * 7) AS ts, user_id + i * 15 AS user_id, event_type, value * 4 AS value, props
    FROM '{SF}/events.parquet', range({COPIES}) AS r(i)"""
    duckdb.connect().execute(f"COPY ({sql}) TO '{d}/events.parquet' (FORMAT parquet)")
    return str(d)


def most_rows(df) -> int:
    """Rows of the step of a finished plan that made most."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        m = p.metrics()
        if m.contains("numOutputRows"):
            most = max(most, m.apply("numOutputRows").value())
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.mark.parametrize("name", sorted(LINEAR))
def test_no_more_rows_than_a_few_for_each_read(spark, dense, name):
    df = driver.QUERIES[name](spark, dense)
    got = df.toPandas()
    assert most_rows(df) <= LINEAR[name] * COPIES * 1000 + len(got)
    if name in driver.ORACLES:
        assert rows(got) == rows(duck(driver.ORACLES[name], dense))


def test_pairs_of_events_and_sites_are_not_shuffled(spark, dense):
    df = driver.QUERIES["warnings_by_site"](spark, dense)
    got = df.toPandas()
    assert "hashpartitioning(cat_id" not in df._jdf.queryExecution().toString()
    assert rows(got) == rows(duck(driver.ORACLES["warnings_by_site"], dense))


def test_errors_of_pairs_are_counted_not_collected(spark, dense):
    df = driver.QUERIES["error_stats"](spark, dense)
    assert rows(df.toPandas()) == rows(duck(driver.ORACLES["error_stats"], dense))
    assert "median(abs" not in df._jdf.queryExecution().toString()


def test_errors_of_pairs_are_never_rows(spark, dense, monkeypatch):
    from tremolo.operators import ranges

    def no_pairs(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(ranges, "tolerance_join", no_pairs)
    assert rows(driver.QUERIES["error_stats"](spark, dense).toPandas()) == rows(duck(driver.ORACLES["error_stats"], dense))


def test_middle_offsets_are_those_of_all_pairs(spark):
    """Spans of one row, times on a span's edge, equal times, a key without a name and one that is out of reach."""
    import numpy as np

    from tremolo.operators import offsets

    base = [0, 5, 60, 60, 119, 120, 1000]
    of = {"a": [0, 3, 59, 60, 70, 130], "b": [10, 125], None: [55, 61, 990, 1010], "far": [500]}
    b = spark.createDataFrame([(x,) for x in base], "at bigint")
    r = spark.createDataFrame([(k, x) for k, v in of.items() for x in v], "kind string, at bigint")
    spans = offsets.spans_of(b, r, 10, "kind")
    got = {x["kind"]: x for x in offsets.sums(spans, "kind", 10, 4).collect() if x["n"]}
    off = {k: np.array([y - x for x in base for y in v if abs(y - x) <= 10]) for k, v in of.items()}
    off = {k: v for k, v in off.items() if len(v)}
    assert {k: (x["n"], int(x["total"]), int(x["size"]), x["inside"], round(x["square"] * 1e12)) for k, x in got.items()} == {k: (len(v), v.sum(), abs(v).sum(), (abs(v) <= 4).sum(), (v * v).sum()) for k, v in off.items()}
    middle = {k: tuple(np.sort(abs(v))[[(len(v) - 1) // 2, len(v) // 2]]) for k, v in off.items()}
    assert offsets.middle(spans, "kind", 10, {k: len(v) for k, v in off.items()}) == middle


def test_quantiles_read_their_table_once(spark):
    """The table is counted once: what is left reads the staged counts only, and ranges are told by blocks of bounds."""
    from pyspark.sql import functions as F

    from tremolo.operators import stats

    df = driver.QUERIES["quantiles"](spark, SF)
    assert "lineitem" not in " ".join(df.inputFiles()) and rows(df.toPandas()) == rows(duck(driver.ORACLES["quantiles"]))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    x = spark.range(1000).select((F.col("id") * 7 % 300).alias("v")).mapInPandas(count, "v bigint")
    got = stats.places_all(x, "v", {"a": (0.25, "between"), "b": (0.5, "floor"), "c": (0.9, "even")}).collect()[0]
    v = sorted(i * 7 % 300 for i in range(1000))
    assert tuple(got) == (v[249] + (v[250] - v[249]) * 0.75, v[499], v[899]) and read.value == 1000
    numbered = stats.in_ranges(spark.range(500).select("id"), ["id"]).collect()
    assert [r["__range"] for r in sorted(numbered)] == sorted(r["__range"] for r in numbered) and len({r["__range"] for r in numbered}) > 2


def test_pairs_at_the_edge_of_their_window():
    """Compatible pairs as by distances, among them some at the edge to the microsecond, at one place and at one time; stations of
    one row, of some and of very many; rows out of reach are not looked at."""
    import numpy as np
    import pandas as pd

    from tremolo.operators import partners

    rng = np.random.default_rng(3)
    lat, lon = rng.uniform(37, 39, 120).round(2), rng.uniform(27, 29, 120).round(2)
    lat[1:10], lon[1:10] = lat[0], lon[0]
    station = np.r_[np.arange(60), rng.integers(0, 30, 50), np.full(10, 99)]
    us = rng.integers(0, 60_000_000, 120)
    edge = [int(min(300, partners.km_between(lat[k], lon[k], lat[k + 1], lon[k + 1]) / 6 + 3) * 1e6) for k in range(20, 30, 2)]
    us[21:31:2] = us[20:30:2] + edge
    us[23], us[40] = us[23] + 1, us[41]
    at = np.argsort(us, kind="stable")
    span = pd.DataFrame({"id": rng.permutation(120), "station": station, "us": us, "lat": lat, "lon": lon}).iloc[at].reset_index(drop=True)
    for speed, most in ((6.0, 300.0), (2.0, 3000.0)):
        f = partners.Compatible(span, speed, 3.0, most)
        km = partners.km_between(f.lat[:, None], f.lon[:, None], f.lat[None], f.lon[None])
        want = (f.id[:, None] < f.id[None]) & (f.station[:, None] != f.station[None]) & (np.abs(f.us[:, None] - f.us[None]) <= np.minimum(most, km / speed + 3) * 1e6)
        order, starts = partners.by_station(f.station, slice(0, 120))
        told, chord = f(slice(0, 120), order)
        assert (told == want[:, order]).all() and want.sum() > 100 and np.abs(partners.chord_km(np.maximum(chord, 0)) - km[:, order]).max() < 1e-3
        assert (partners.any_of_station(told, starts) == np.logical_or.reduceat(told, starts, axis=1)).all()
        few = order[:40]
        assert (partners.any_of_station(told[:, :40], by := np.flatnonzero(np.r_[True, np.diff(f.station[few]) != 0])) == np.logical_or.reduceat(told[:, :40], by, axis=1)).all()
    far = span.assign(us=np.arange(120) * 10_000_000)
    f = partners.Compatible(far, 6.0, 3.0, 300.0)
    near = f.near(slice(60, 62), slice(30, 92))
    assert 2 < near.stop - near.start < 30


def test_closest_pairs_meet_their_neighbours_only(spark):
    """Two groups of sites, some at one place, one of them of two far sites: the closest pair as of all pairs."""
    from pyspark.sql import functions as F

    from tremolo.functions import geo
    from tremolo.operators import ranges
    from tremolo.plans.registry import place

    k = F.col("id") * 37
    lat, lon = place(k)
    s = spark.range(3000).select((F.col("id") % 1).alias("g"), k.alias("k"), lat.alias("lat"), lon.alias("lon"))
    s = s.unionByName(spark.createDataFrame([(1, 5, 10.0, 10.0), (1, 9, -60.0, 170.0), (2, 1, 1.0, 1.0), (3, 4, 2.0, 2.0), (3, 2, 2.0, 2.0), (3, 3, 2.0, 2.0)], "g bigint, k bigint, lat double, lon double")).localCheckpoint()
    df = ranges.closest_pairs(s, "g", "k")
    got = {r.g: (r.a, r.b, r.km) for r in df.collect()}
    assert most_rows(df) <= 30 * 3006
    a, b = s.select("g", F.col("k").alias("a"), F.col("lat").alias("x"), F.col("lon").alias("y")), s.select("g", F.col("k").alias("b"), "lat", "lon")
    pairs = a.join(b, "g").where("a < b").withColumn("km", geo.distance_km(F.col("x"), F.col("y"), F.col("lat"), F.col("lon")))
    want = {r.g: (r.m.a, r.m.b, r.m.km) for r in pairs.groupBy("g").agg(F.min(F.struct("km", "a", "b")).alias("m")).collect()}
    assert got == want and set(got) == {0, 1, 3}


def test_sizes_come_from_sums_of_parts(spark):
    """An event's observations lie in several parts; no task takes them all, and the sizes are those of all."""
    import numpy as np

    from tremolo.operators import locate

    k = np.arange(6000)
    y, base, censored = 4.7 + k % 13 / 20, -0.3 * (1 + k % 3), k % 13 == 0
    df = spark.createDataFrame([(7, float(a), float(b), bool(c)) for a, b, c in zip(y, base, censored)], "event bigint, y double, base double, censored boolean").repartition(5)
    out = locate.size_of_events(df, "event")
    plan = out._jdf.queryExecution().toString()
    assert plan.index("FlatMapGroupsInPandas") < plan.index("MapInPandas", plan.index("FlatMapGroupsInPandas") + 30)
    mean, sd, shares = locate.size_posterior(y, base, censored)
    assert np.allclose(out.first()[1:], [6000, int((~censored).sum()), mean, sd, *shares], atol=1e-9)


def test_release_never_looks_at_all_stations():
    """A network of many stations, half of them lagging, of which some leave and come back: a row may look at its own
    station and at those that hold a message back, and what comes out is that of looking at all of them."""
    from tremolo.operators import release

    class Promises(dict):
        def items(self):
            raise AssertionError("looks at every station")

    class Lagging(set):
        def __iter__(self):
            raise AssertionError("looks at every lagging station")

    whole = release.Release(40)
    whole.promised, whole.lagging = Promises(), Lagging()
    out = [x for s in range(300) for x in whole.offer("hello", s, None, 0, None, 0)]
    for k in range(3000):
        s = k * 7 % 150 if k % 10 else k * 3 % 300
        out += whole.offer("bye" if k % 97 == 0 else "hello" if k % 97 == 1 else "message", s, k, k, k, k + k % 5)
    out += [x for s in range(300) for x in whole.offer("bye", s, None, 0, None, 4000)]
    assert [x[1] for x in out if x[0] == "message"] == sorted({k for k in range(3000) if k % 97 > 1}) and {x[0] for x in out} == {"message", "lagging", "caught"}


def test_alarms_put_together_without_pairs_as_rows(spark, dense):
    """Every alarm's choice is that of its candidates among all pairs."""
    import numpy as np

    from tremolo.operators import events, partners
    from tremolo.plans.joins import _placed

    e = _placed(spark, dense).toPandas()
    us = e.us.to_numpy()
    want = []
    for k, r in enumerate(e.itertuples()):
        km = partners.km_between(np.full(len(e), r.lat), np.full(len(e), r.lon), e.lat.to_numpy(), e.lon.to_numpy())
        c = e[(e.id > r.id) & (e.station != r.station) & (km <= 150) & (np.abs(us - r.us) <= (km / 6 + 3) * 1e6)]
        if len(c):
            ids = events.consistent_choice(c.assign(at=c.us / 1e6))
            want.append((r.id, c.station.nunique(), None if ids is None else ",".join(map(str, ids))))
    got = [tuple(r) for r in driver.QUERIES["alarm_detections"](spark, dense).collect()]
    assert sorted(got) == sorted(want) and max(x[1] for x in want) > 1


def test_alarms_explained_without_pairs_as_rows(spark, dense):
    """The rows of the general operator, which makes a row for each alarm and event."""
    from pyspark.sql import functions as F

    from tremolo.operators import explain, partners
    from tremolo.plans.joins import _placed
    from tremolo.plans.registry import detections, place

    df = driver.QUERIES["explain_alarms"](spark, dense)
    got = df.toPandas()
    assert most_rows(df) <= 6 * COPIES * 1000 + len(got)
    d = partners.first_detections(_placed(spark, dense)).withColumn("seen", F.arrays_zip("station", "lat", "lon", "id"))
    us = detections(spark, dense).select(F.col("event_id").alias("id"), "us")
    d = d.select(F.col("event").alias("alarm"), F.explode("seen").alias("x")).select("alarm", "x.*").join(us, "id")
    lat, lon = place(F.col("station"))
    depth = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 120 * 10 - 20)
    c = detections(spark, dense).where("kind = 'purchase'").select(F.col("event_id").alias("cat_id"), F.col("us").alias("cat_us"), F.col("value").alias("size"), depth.alias("depth"), lat.alias("cat_lat"), lon.alias("cat_lon"))

    def phases(degrees, depth):
        ray = F.hypot(degrees * 111.195, depth)
        return {"P": F.when(ray < 100, ray / 5.8).otherwise(6.0 + ray / 8.0), "S": F.when(degrees <= 8, F.when(ray < 100, ray / 3.4).otherwise(8.0 + ray / 4.6))}

    want = explain.explain(d, c, phases, [(100.0, 180.0), (20.0, 4.0), (5.0, 1.0)], 60.0, 2, 2400.0, (0, 3600)).toPandas()
    assert len(got) > 1000 and rows(got) == rows(want) and got["best"].notna().any()


def test_requests_are_not_shuffled(spark, dense):
    df = driver.QUERIES["pick_requests"](spark, dense)
    got = df.toPandas()
    assert len(got) and rows(got) == rows(duck(driver.ORACLES["pick_requests"], dense))
    assert "hashpartitioning(cat_id" not in df._jdf.queryExecution().toString() and "SortMergeJoin" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("n, seconds, stations, spread", [(600, 60, 40, 1.0), (900, 400, 900, 1.0), (60, 40_000, 4, 1.0), (500, 900, 300, 9.0), (1, 1, 1, 1.0)])
def test_partners_in_single_numbers_are_those_in_double(n, seconds, stations, spread):
    """Also at pairs on the edge of what one source can explain, at times beyond the longest, and of no rows."""
    import numpy as np
    import pandas as pd

    from tremolo.operators import partners

    draw = np.random.default_rng(n)
    station = draw.integers(0, stations, n)
    lat, lon = 36 + station * 7919 % 601 / 100 * spread, 26 + station * 104_729 % 1201 / 100 * spread
    us = draw.integers(0, seconds * 1_000_000, n)
    # a third of the rows lie as far from the first one as a wave needs, to the microsecond
    edge = np.arange(n) % 3 == 1
    us[edge] = us[0] + np.floor(np.minimum(300, partners.km_between(lat[0], lon[0], lat[edge], lon[edge]) / 6 + 3) * 1e6).astype(np.int64) + draw.integers(0, 2, edge.sum())
    span = pd.DataFrame({"id": draw.permutation(n), "station": station, "us": us, "lat": lat, "lon": lon}).sort_values("us", kind="stable")
    fits = partners.Compatible(span, 6.0, 3.0, 300.0)
    id_, s, t, a, b = (span[c].to_numpy() for c in ("id", "station", "us", "lat", "lon"))
    km = partners.km_between(a[:, None], b[:, None], a[None], b[None])
    want = (id_[:, None] < id_[None]) & (s[:, None] != s[None]) & (np.abs(t[:, None] - t[None]) <= np.minimum(300.0, km / 6 + 3) * 1e6)
    own, others = slice(n // 4, n // 2 + 1), slice(0, n)
    for x, y in ((slice(0, n), others), (own, others), (np.arange(0, n, 2), np.arange(n)[::-1]), (np.arange(0), np.arange(0)), (slice(0, 0), others)):
        told, _ = fits.told(x, y)
        assert (told == want[x][:, y]).all()
    assert (fits.stations(want[own], others) == [len(set(s[r])) for r in want[own]]).all()


def test_alarms_say_what_is_asked(spark):
    import numpy as np

    from tremolo.operators import partners

    draw = np.random.default_rng(5)
    table = [(i, int(s), int(t), float(36 + s * 7919 % 601 / 100), float(26 + s * 104_729 % 1201 / 100)) for i, (s, t) in enumerate(zip(draw.integers(0, 30, 400), draw.integers(0, 2_000_000_000, 400)))]
    rows_ = spark.createDataFrame(table, "id bigint, station bigint, us bigint, lat double, lon double")
    want = {}
    for i, s, t, la, lo in table:
        found = [(q, u, float(partners.km_between(la, lo, a, b))) for j, q, u, a, b in table if j > i and q != s]
        found = [(q, u, km) for q, u, km in found if abs(u - t) <= min(300.0, km / 6 + 3) * 1e6]
        if found:
            q, u, km = zip(*found)
            want[i] = {"others": len(set(q)), "first": min(q), "last": max(q), "last_us": max(u), "km": round(min(km), 9)}
    for ask in (("others", "first", "last", "last_us", "km"), ("others",), ("last_us",), ("km", "others")):
        got = {r["a_id"]: {k: round(v, 9) if k == "km" else v for k, v in r.asDict().items() if k in ask} for r in partners.alarms(rows_, ask).collect()}
        assert got == {i: {k: v for k, v in w.items() if k in ask} for i, w in want.items()}


def test_no_task_holds_all_leads_for_their_median(spark, dense):
    df = driver.QUERIES["warning_summary"](spark, dense)
    assert "median(" not in df._jdf.queryExecution().toString()
    assert rows(df.toPandas()) == rows(duck(driver.ORACLES["warning_summary"], dense))


def test_rows_of_a_site_stand_together_over_many_events(spark, tmp_path):
    """What repeats is written as repeats: a row of the result takes a fraction of what its six columns hold."""
    spark.range(3000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT id * 7919 AS event_id, id % 40 AS user_id, timestamp_micros(id * 1000003) AS ts, if(id % 2 = 0, 'purchase', 'click') AS event_type, 100.0D + id % 300 AS value FROM range(1200)").write.parquet(f"{tmp_path}/events.parquet")
    big = spark.read.parquet(f"{tmp_path}/events.parquet").where("event_type = 'purchase' and value >= 200").count()
    driver.QUERIES["warnings_by_site"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert len(got) == big * 3000 and big == 400 and size < len(got)
    assert (got.groupby("cat_id").nearest.apply(lambda x: sorted(x) == list(range(1, 3001)))).all() and got.groupby("s_suppkey").nearest.nunique().eq(1).all()


def test_requests_stand_together_by_events(spark, tmp_path):
    """The next rows of a file are of the same few hundred events, whatever their number, so that their names repeat."""
    import pandas as pd

    os.symlink(f"{SF}/supplier.parquet", tmp_path / "supplier.parquet")
    spark.sql("""SELECT id AS event_id, id % 500 AS user_id, timestamp_micros(86400000000 + id * 10000000) AS ts, 'purchase' AS event_type, 250.0D AS value FROM range(3000)
        UNION ALL SELECT 10000 + id, id, timestamp_micros(id), 'click', 1.0D FROM range(2000)""").write.parquet(f"{tmp_path}/events.parquet")
    driver.QUERIES["pick_requests"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    parts = [pd.read_parquet(p) for p in (tmp_path / "out").glob("*.parquet")]
    got, most = pd.concat(parts), max(parts, key=len)
    assert got.groupby("station").cat_id.nunique().eq(3000).all() and len(got) == 3000 * got.station.nunique() > 100_000
    assert max(most.cat_id.iloc[i : i + 2048].nunique() for i in range(0, len(most), 2048)) <= 1100
