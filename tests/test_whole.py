"""Queries of whole tables: no row is left out, at any number of ranges."""

import math

from pyspark.sql import functions as F

from tests.conftest import SF, duck
from tremolo.functions import geo
from tremolo.operators import islands, stats
from tremolo.plans import driver
from tremolo.plans.registry import place


def test_total_order_numbers_every_row(spark):
    got = driver.QUERIES["total_order"](spark, SF).toPandas()
    n = int(duck("SELECT count(*) AS n FROM events").n[0])
    assert n > 500 and sorted(got.seq) == list(range(1, n + 1))


def test_row_numbers_with_ties_and_nulls(spark):
    data = [(None if i % 97 == 0 else i * 7919 % 5, i * 31 % 1009, i) for i in range(1009)] + [(3, 1, 2000 + i) for i in range(500)]
    df = spark.createDataFrame(data, "a long, b long, c long").repartition(5)
    got = {r.c: r.seq for r in stats.row_numbers(df, ["a", "b", "c"]).collect()}
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert got == {r[2]: i for i, r in enumerate(want, 1)}
    assert stats.row_numbers(df.where("false"), ["a", "b", "c"]).count() == 0


def test_every_explained_catalogue_row(spark):
    got = driver.QUERIES["explain_k_of_n"](spark, SF).toPandas()
    e = duck("SELECT user_id AS station, epoch_us(ts) AS us, event_type AS kind, event_id FROM events")
    cat, det = e[e.kind == "purchase"], e[e.kind != "purchase"]
    want = {int(c.event_id): int(n) for c in cat.itertuples() if (n := det[(det.us - c.us).abs() <= 900_000_000].station.nunique()) >= 3}
    assert dict(zip(got.cat_id, got.stations)) == want


def test_no_two_hundred_in_explain_k_of_n(spark, tmp_path):
    spark.sql(
        "SELECT id AS event_id, id % 4 AS user_id, timestamp_micros(id div 4 * 2000000000) AS ts, if(id % 4 = 0, 'purchase', 'click') AS event_type, 1.0D AS value FROM range(1000)"
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = driver.QUERIES["explain_k_of_n"](spark, str(tmp_path)).toPandas()
    assert len(got) == 250 and set(got.stations) == {3}


def test_chance_of_every_alarm_and_station(spark, tmp_path):
    ids = [3, 40, 41, 42, 7, 900]
    data = [(i, s, t, "click", 1.0) for i, (s, t) in enumerate([(ids[0], 100), (ids[1], 101), (ids[2], 102), (ids[3], 103), (ids[4], 90_000), (ids[5], 200_000)])]
    data += [(50 + i, 41, 400_000 + 5000 * i, "view", 1.0) for i in range(3)]
    spark.createDataFrame(data, "event_id long, user_id long, s long, event_type string, value double").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    km = spark.range(1).select(*[geo.distance_km(*place(F.lit(3)), *place(F.lit(s))).alias(f"s{s}") for s in (40, 41, 42)]).first()
    part = lambda s, n: math.log(1 - math.exp(-n / 2_592_000 * 2 * (km[f"s{s}"] / 6 + 3)))
    got = {r.a_id: r for r in driver.QUERIES["chance_probability"](spark, str(tmp_path)).collect()}
    alarms = {r.a_id for r in driver.QUERIES["declare_events"](spark, str(tmp_path)).collect()}
    assert set(got) == alarms and 0 in got and got[0].others == 3
    assert abs(got[0].ln_p - part(40, 1) - part(41, 4) - part(42, 1)) < 1e-5


def test_coverage_at_any_width(spark):
    data = [(None if i % 4 == 0 else i % 3, i * 7919 % 2003, i * 7919 % 2003 + i * 31 % 17) for i in range(200)]
    data += [(1, 10, 1500), (1, 1500, 1510), (2, 5, 5), (2, None, 9), (2, 9, None), (2, 40, 50), (2, 40, 50)]
    df = spark.createDataFrame(data, "k long, a long, b long").repartition(3)
    want = {}
    for key in {r[0] for r in data}:
        end, covered, spans = None, 0, 0
        for a, b in sorted((r[1], r[2]) for r in data if r[0] == key and r[1] is not None and r[2] is not None):
            spans += end is None or a > end
            covered += max(0, b - (a if end is None else max(a, end)))
            end = b if end is None else max(end, b)
        want[key] = (covered, spans)
    for width in (1, 50, 10_000):
        assert {r.k: (r.covered, r.spans) for r in islands.coverage(df, "a", "b", ["k"], width).collect()} == want
    assert islands.coverage(df.where("false"), "a", "b", ["k"], 50).count() == 0
