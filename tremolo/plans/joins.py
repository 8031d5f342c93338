"""Queries of association, matching and other joins on time and place. The catalogue is the events of one kind."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.functions import geo
from tremolo.operators import partners, ranges, stats
from tremolo.plans.registry import DETECTIONS, LAT, LON, detections, km_sql, place, query, r6, table

S = 1_000_000
#: Events that are joined with a site together.
EVENTS = 512
CAT = f"{DETECTIONS}, cat AS (SELECT event_id AS cat_id, us AS cat_us, value AS size FROM e WHERE kind = 'purchase'), det AS (SELECT * FROM e WHERE kind <> 'purchase')"
LA, LO = LAT.format(k="{0}.station"), LON.format(k="{0}.station")


def _km(a: str, b: str) -> str:
    return km_sql(LA.format(a), LO.format(a), LA.format(b), LO.format(b))


def _catalogue(spark, sf_dir):
    e = detections(spark, sf_dir)
    return e.where("kind = 'purchase'").select(F.col("event_id").alias("cat_id"), F.col("us").alias("cat_us"), F.col("value").alias("size"))


def _detections(spark, sf_dir):
    return detections(spark, sf_dir).where("kind <> 'purchase'")


def _pairs(spark, sf_dir, which: str = "true"):
    """Detections of different stations that one source can explain: their distance bounds their time difference."""
    e = _detections(spark, sf_dir).where(which)
    a = e.select(F.col("event_id").alias("a_id"), F.col("station").alias("a_station"), F.col("us").alias("a_us"))
    b = e.select(F.col("event_id").alias("b_id"), F.col("station").alias("b_station"), F.col("us").alias("b_us"))
    most = 300  # seconds: the largest distance over the velocity, and the slack
    pairs = ranges.tolerance_join(a, b, "a_us", "b_us", most * S).where("a_id < b_id and a_station <> b_station")
    km = geo.distance_km(*place(F.col("a_station")), *place(F.col("b_station")))
    return pairs.withColumn("km", km).where(F.abs(F.col("a_us") - F.col("b_us")) <= F.least(F.lit(float(most)), F.col("km") / 6 + 3) * S)


def _placed(spark, sf_dir, which: str = "true"):
    """Detections with the places of their stations, for ``partners``."""
    lat, lon = place(F.col("station"))
    return _detections(spark, sf_dir).where(which).select(F.col("event_id").alias("id"), "station", "us", lat.alias("lat"), lon.alias("lon"))


PAIRS = f"p AS (SELECT a.event_id AS a_id, b.event_id AS b_id, a.station AS a_station, b.station AS b_station, a.us AS a_us, b.us AS b_us, {_km('a', 'b')} AS km FROM det a JOIN det b ON a.event_id < b.event_id AND a.station <> b.station AND abs(a.us - b.us) <= 300000000), q AS (SELECT * FROM p WHERE abs(a_us - b_us) <= least(300.0::DOUBLE, km / 6 + 3) * 1000000)"


@query("associate_pairs", f"WITH {CAT}, {PAIRS} SELECT a_id, b_id, round(km, 6) AS km FROM q")
def associate_pairs(spark, sf_dir):
    """Compatible pairs of detections under a tolerance that depends on the stations' distance."""
    return _pairs(spark, sf_dir).select("a_id", "b_id", r6(F.col("km")).alias("km"))


@query(
    "declare_events",
    f"WITH {CAT}, {PAIRS} SELECT a_id, count(DISTINCT b_station) + 1 AS stations, greatest(max(a_us), max(b_us)) AS declared FROM q GROUP BY a_id HAVING count(DISTINCT b_station) >= 2",
)
def declare_events(spark, sf_dir):
    """Detections that stations enough are compatible with, and when the last of them was declared."""
    g = partners.alarms(_placed(spark, sf_dir), ("others", "last_us")).where("others >= 2")
    return g.select("a_id", (F.col("others") + 1).alias("stations"), F.greatest("a_us", "last_us").alias("declared"))


MATCH = "m AS (SELECT d.event_id, c.cat_id, c.size, abs(d.us - c.cat_us) AS miss, row_number() OVER (PARTITION BY d.event_id ORDER BY abs(d.us - c.cat_us), c.cat_us, c.cat_id) AS n FROM det d JOIN cat c ON abs(d.us - c.cat_us) <= 600000000)"


def _matched(spark, sf_dir):
    d, c = _detections(spark, sf_dir), _catalogue(spark, sf_dir)
    m = ranges.nearest_join(d, c, "us", "cat_us", 600 * S, ties=["cat_id"])
    return m.select("event_id", "us", "cat_id", "size", F.abs(F.col("us") - F.col("cat_us")).alias("miss"))


@query("catalogue_match_best", f"WITH {CAT}, {MATCH} SELECT event_id, cat_id, size, miss FROM m WHERE n = 1")
def catalogue_match_best(spark, sf_dir):
    """The catalogue row that each detection fits best: smallest miss, earlier row on ties."""
    return _matched(spark, sf_dir).drop("us")


@query(
    "score_left",
    f"WITH {CAT}, {MATCH} SELECT c.cat_id, count(m.event_id) AS fits, min(m.event_id) AS first_alarm, arg_min(m.miss, m.event_id) AS miss FROM cat c LEFT JOIN m ON m.cat_id = c.cat_id AND m.n = 1 GROUP BY c.cat_id",
)
def score_left(spark, sf_dir):
    """Each catalogue row with the first detection credited to it, or none."""
    m = _matched(spark, sf_dir).select("event_id", "cat_id", "miss")
    return _catalogue(spark, sf_dir).select("cat_id").join(m, "cat_id", "left").groupBy("cat_id").agg(F.count("event_id").alias("fits"), F.min("event_id").alias("first_alarm"), F.min_by("miss", "event_id").alias("miss"))


@query("unmatched_anti", f"WITH {CAT} SELECT event_id, us FROM det d WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE abs(d.us - c.cat_us) <= 600000000)")
def unmatched_anti(spark, sf_dir):
    """Detections that fit no catalogue row."""
    return ranges.tolerance_join(_detections(spark, sf_dir), _catalogue(spark, sf_dir), "us", "cat_us", 600 * S, how="left_anti").select("event_id", "us")


@query(
    "pre_s_counts",
    f"""WITH {CAT}, w AS (SELECT c.cat_id, d.event_id, d.us, c.cat_us + (sqrt(pow({km_sql(LA.format('d'), LO.format('d'), '38.0::DOUBLE', '30.0::DOUBLE')}, 2) + 100) / 3.5 * 1000000)::DOUBLE AS s_us
FROM cat c JOIN det d ON d.us BETWEEN c.cat_us AND c.cat_us + 600000000)
SELECT cat_id, count(*) AS n, count(*) FILTER (us < s_us) AS before_s FROM w GROUP BY cat_id""",
)
def pre_s_counts(spark, sf_dir):
    """Detections after a catalogue row, and those before the slower wave could arrive at their station."""
    c = _catalogue(spark, sf_dir).withColumn("end_us", F.col("cat_us") + 600 * S)
    pairs = ranges.range_join(_detections(spark, sf_dir), c, "us", "cat_us", "end_us", 600 * S)
    km = geo.distance_km(*place(F.col("station")), F.lit(38.0), F.lit(30.0))
    s_us = F.col("cat_us") + geo.travel_time(km, 10.0, 3.5) * S
    return pairs.groupBy("cat_id").agg(F.count("*").alias("n"), F.count_if(F.col("us") < s_us).alias("before_s"))


@query(
    "warnings_by_site",
    f"""WITH {CAT}, big AS (SELECT * FROM cat WHERE size >= 200), s AS (SELECT s_suppkey, {LAT.format(k='s_suppkey')} AS la, {LON.format(k='s_suppkey')} AS lo FROM supplier),
d AS (SELECT cat_id, s_suppkey, {km_sql('la', 'lo', '38.0::DOUBLE', '30.0::DOUBLE')} AS km FROM big, s)
SELECT cat_id, s_suppkey, round(km, 6) AS km, round(sqrt(km * km + 100) / 3.5 - 20, 6) AS lead_s, round(sqrt(greatest(pow(3.5 * 20, 2) - 100, 0)), 6) AS blind_km, row_number() OVER (PARTITION BY cat_id ORDER BY km, s_suppkey) AS nearest FROM d""",
)
def warnings_by_site(spark, sf_dir):
    """Large catalogue rows by site: distance, seconds of warning, blind radius and rank."""
    sites = table(spark, sf_dir, "supplier").select("s_suppkey")
    big = _catalogue(spark, sf_dir).where("size >= 200").select("cat_id")
    km = geo.distance_km(*place(F.col("s_suppkey")), F.lit(38.0), F.lit(30.0))
    # a site's figures and rank are the same for all events: they are worked out once, and the pairs, which are the result itself, are not shuffled
    ranked = stats.row_numbers(sites.withColumn("km", km), ["km", "s_suppkey"], "nearest")
    ranked = ranked.select("s_suppkey", r6(F.col("km")).alias("km"), r6(geo.travel_time(F.col("km"), 10.0, 3.5) - 20).alias("lead_s"), r6(geo.blind_radius(F.lit(20.0))).alias("blind_km"), F.col("nearest").cast("int").alias("nearest"))
    # events by the hundred with spans of ranks, dealt out; each site has its rows one after another, so that all but the events repeat and are written as such
    span = 4096
    sites = ranked.withColumn("__span", F.floor((F.col("nearest") - 1) / span).cast("int"))
    listed = big.withColumn("__block", F.floor(F.monotonically_increasing_id() / EVENTS)).groupBy("__block").agg(F.array_sort(F.collect_list(F.struct("cat_id"))).alias("events")).drop("__block")
    dealt = listed.join(F.broadcast(sites.select("__span").distinct()), how="cross").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = dealt.join(F.broadcast(sites), "__span").select(F.explode("events").alias("e"), "s_suppkey", "km", "lead_s", "blind_km", "nearest")
    return pairs.select("e.cat_id", "s_suppkey", "km", "lead_s", "blind_km", "nearest")


@query(
    "gain_epoch_join",
    """WITH g AS (SELECT p_partkey, p_partkey % 40 AS ch, epoch_us(TIMESTAMP '1995-01-01') + p_partkey * 86400000000 AS lo, CASE WHEN p_partkey % 3 > 0 THEN epoch_us(TIMESTAMP '1995-01-01') + (p_partkey + 300) * 86400000000 END AS hi, p_retailprice FROM part),
o AS (SELECT o_orderkey, o_custkey % 40 AS ch, epoch_us(o_orderdate) AS us FROM orders),
m AS (SELECT o.o_orderkey, g.p_partkey, g.p_retailprice, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY g.lo, g.p_partkey) AS n FROM o JOIN g ON o.ch = g.ch AND o.us >= g.lo AND o.us < coalesce(g.hi, 9000000000000000))
SELECT o_orderkey, p_partkey, p_retailprice AS gain FROM m WHERE n = 1""",
)
def gain_epoch_join(spark, sf_dir):
    """The first epoch [start, end) of a channel that holds at a time; open ends never end."""
    day = 86_400 * S
    base = 788_918_400 * S
    p = table(spark, sf_dir, "part")
    epochs = p.select((F.col("p_partkey") % 40).alias("ch"), "p_partkey", (F.lit(base) + F.col("p_partkey") * day).alias("lo"), F.when(F.col("p_partkey") % 3 > 0, F.lit(base) + (F.col("p_partkey") + 300) * day).alias("hi"), F.col("p_retailprice").alias("gain"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("ch"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    last = o.agg(F.max("us").alias("last"))  # where open ends end
    spans = epochs.join(F.broadcast(last)).withColumn("hi", F.coalesce(F.col("hi") - 1, "last")).where("lo <= last")
    m = ranges.range_join(o, spans, "us", "lo", "hi", 300 * day, ["ch"])
    return m.groupBy("o_orderkey").agg(F.min(F.struct("lo", "p_partkey", "gain")).alias("g")).select("o_orderkey", "g.p_partkey", "g.gain")


@query(
    "asof_last_before",
    f"WITH {CAT} SELECT d.event_id, d.us - c.us AS lag_us, c.value AS click_value FROM (SELECT * FROM e WHERE kind = 'error') d ASOF LEFT JOIN (SELECT * FROM e WHERE kind = 'click') c ON d.station = c.station AND d.us >= c.us",
)
def asof_last_before(spark, sf_dir):
    """For every error the station's latest click before it."""
    e = detections(spark, sf_dir)
    left = e.where("kind = 'error'").select("event_id", "station", "us")
    right = e.where("kind = 'click'").select("station", F.col("us").alias("click_us"), F.col("value").alias("click_value"))
    return ranges.asof_join(left, right, "us", "click_us", ["station"], ["click_us", "click_value"]).select("event_id", (F.col("us") - F.col("click_us")).alias("lag_us"), "click_value")


@query(
    "asof_within",
    f"""WITH {CAT}, a AS (SELECT d.event_id, d.us, c.us AS click_us FROM (SELECT * FROM e WHERE kind = 'error') d ASOF LEFT JOIN (SELECT * FROM e WHERE kind = 'click') c ON d.station = c.station AND d.us >= c.us)
SELECT event_id, CASE WHEN us - click_us <= 86400000000 THEN us - click_us END AS lag_us FROM a""",
)
def asof_within(spark, sf_dir):
    """The same within a day."""
    e = detections(spark, sf_dir)
    left = e.where("kind = 'error'").select("event_id", "station", "us")
    right = e.where("kind = 'click'").select("station", F.col("us").alias("click_us"))
    return ranges.asof_join(left, right, "us", "click_us", ["station"], ["click_us"], tolerance=86_400 * S).select("event_id", (F.col("us") - F.col("click_us")).alias("lag_us"))


@query(
    "first_after_latency",
    f"""WITH {CAT} SELECT c.event_id AS cat_id, min(d.us) - min(c.us) AS latency FROM (SELECT * FROM e WHERE kind = 'purchase') c JOIN det d ON d.station % 10 = c.station % 10 AND d.us BETWEEN c.us - 500000 AND c.us + 7200000000 GROUP BY c.event_id""",
)
def first_after_latency(spark, sf_dir):
    """Per catalogue row, the first detection of its region from half a second before to two hours after."""
    e = detections(spark, sf_dir).withColumn("region", F.col("station") % 10)
    c = e.where("kind = 'purchase'").select(F.col("event_id").alias("cat_id"), F.col("us").alias("cat_us"), "region")
    d = e.where("kind <> 'purchase'").select("us", "region")
    return ranges.first_after(c, d, "cat_us", "us", S // 2, 7200 * S, ["region"]).select("cat_id", (F.col("us") - F.col("cat_us")).alias("latency"))


@query(
    "nearest_pick",
    f"""WITH {CAT}, n AS (SELECT d.event_id, v.event_id AS pick_id, v.us - d.us AS offset_us, row_number() OVER (PARTITION BY d.event_id ORDER BY abs(v.us - d.us), v.us) AS n
FROM (SELECT * FROM e WHERE kind = 'error') d JOIN (SELECT * FROM e WHERE kind = 'view') v ON abs(v.us - d.us) <= 1800000000)
SELECT event_id, pick_id, offset_us FROM n WHERE n = 1""",
)
def nearest_pick(spark, sf_dir):
    """The nearest view of an error within half an hour, the earlier one on ties."""
    e = detections(spark, sf_dir)
    d = e.where("kind = 'error'").select("event_id", "us")
    v = e.where("kind = 'view'").select(F.col("event_id").alias("pick_id"), F.col("us").alias("pick_us"))
    return ranges.nearest_join(d, v, "us", "pick_us", 1800 * S).select("event_id", "pick_id", (F.col("pick_us") - F.col("us")).alias("offset_us"))


ARR = f"""{CAT}, st AS (SELECT DISTINCT station FROM e), big AS (SELECT * FROM cat WHERE size >= 120),
v AS (SELECT st.station, b.cat_id, b.cat_us, {km_sql(LA.format('st'), LO.format('st'), '38.0::DOUBLE', '30.0::DOUBLE')} AS km, b.size / 60.0::DOUBLE AS mag FROM st, big b),
arr AS (SELECT *, cat_us + ((km / 8 - 10) * 1000000)::BIGINT AS lo, cat_us + ((km / 6 + 120) * 1000000)::BIGINT AS hi FROM v WHERE km <= 50 OR (km <= 150 AND mag >= 2) OR (km <= 400 AND mag >= 3) OR (km <= 1500 AND mag >= 4.5))"""


def _rings(spark, sf_dir):
    """Stations with the ring of distance they lie in, and large catalogue rows once for every ring that sees their size."""
    stations = detections(spark, sf_dir).select("station").distinct().withColumn("km", geo.distance_km(*place(F.col("station")), F.lit(38.0), F.lit(30.0)))
    ring = F.when(F.col("km") <= 50, 0).when(F.col("km") <= 150, 1).when(F.col("km") <= 400, 2).when(F.col("km") <= 1500, 3)
    big = _catalogue(spark, sf_dir).where("size >= 120").withColumn("mag", F.col("size") / 60)
    seen_to = F.when(F.col("mag") >= 4.5, 3).when(F.col("mag") >= 3, 2).when(F.col("mag") >= 2, 1).otherwise(0)
    return stations.withColumn("ring", ring).where("ring is not null"), big.select("cat_us", F.explode(F.sequence(F.lit(0), seen_to)).alias("ring"))


def _arrival_after(km):
    """The span of a predicted arrival after its event, in microseconds."""
    us = lambda x: F.round(x * S).cast("long")
    return us(km / 8 - 10), us(km / 6 + 120)


@query("visible_arrivals", f"WITH {ARR} SELECT station, count(*) AS arrivals, round(min(km), 6) AS km, min(lo) AS first FROM arr GROUP BY station")
def visible_arrivals(spark, sf_dir):
    """Arrivals by station under the visibility rule of distance and size."""
    stations, seen = _rings(spark, sf_dir)
    # a station's arrivals are those of its ring, shifted by one time: a ring's events are summed up once
    rings = seen.groupBy("ring").agg(F.count("*").alias("arrivals"), F.min("cat_us").alias("first_us"))
    v = stations.join(F.broadcast(rings), "ring")
    return v.select("station", "arrivals", r6(F.col("km")).alias("km"), (F.col("first_us") + _arrival_after(F.col("km"))[0]).alias("first"))


@query("quiet_filter", f"WITH {ARR} SELECT event_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM arr WHERE arr.station = d.station AND d.us BETWEEN arr.lo AND arr.hi)")
def quiet_filter(spark, sf_dir):
    """Detections outside all predicted arrivals of their station."""
    stations, seen = _rings(spark, sf_dir)
    after, until = _arrival_after(F.col("km"))
    d = _detections(spark, sf_dir).join(stations, "station", "left").withColumn("from", F.col("us") - until).withColumn("to", F.col("us") - after)
    # an event between these times has an arrival here: the first one of the ring from then on tells
    longest = int((1500 / 6 + 120 - 1500 / 8 + 10) * S) + 2
    hit = ranges.first_after(d.select("event_id", "ring", "from", "to"), seen, "from", "cat_us", 0, longest, ["ring"]).where("cat_us <= to")
    return d.select("event_id").join(hit.select("event_id"), "event_id", "left_anti")


@query(
    "overlap_semi",
    f"WITH {CAT}, w AS (SELECT event_id, station % 10 AS ch, us, us + 60000000 AS us_end FROM e WHERE kind = 'view'), g AS (SELECT station % 10 AS ch, us AS lo, us + 1800000000 AS hi FROM e WHERE kind = 'error') SELECT event_id FROM w WHERE EXISTS (SELECT 1 FROM g WHERE g.ch = w.ch AND w.us < g.hi AND g.lo < w.us_end)",
)
def overlap_semi(spark, sf_dir):
    """Windows that overlap any gap of their channel."""
    e = detections(spark, sf_dir).withColumn("ch", F.col("station") % 10)
    w = e.where("kind = 'view'").select("event_id", "ch", "us", (F.col("us") + 60 * S).alias("us_end"))
    g = e.where("kind = 'error'").select("ch", F.col("us").alias("lo"), (F.col("us") + 1800 * S).alias("hi"))
    return ranges.overlap_semi(w, g, "us", "us_end", "lo", "hi", 3600 * S, ["ch"]).select("event_id")


@query(
    "explain_k_of_n",
    f"""WITH {CAT}, x AS (SELECT c.cat_id, d.station, min(abs(d.us - c.cat_us)) AS res FROM cat c JOIN det d ON abs(d.us - c.cat_us) <= 900000000 GROUP BY 1, 2)
SELECT cat_id, count(*) AS stations, round(avg(res), 3) AS mean_res FROM x GROUP BY cat_id HAVING count(*) >= 3""",
)
def explain_k_of_n(spark, sf_dir):
    """Every catalogue row that explains detections of three stations or more."""
    return _explained(spark, sf_dir).select("cat_id", "stations", F.round("mean", 3).alias("mean_res"))


def _explained(spark, sf_dir):
    """Catalogue rows with the number of stations that detect within 15 minutes, and the mean of their nearest residuals.

    A station's nearest residual is a sloping line on each side of a detection, up to the middle to the next one or 15
    minutes. All stations' lines at a time are a running sum of those that start and end, in buckets of that length."""
    d, reach = _detections(spark, sf_dir).select("station", "us").distinct(), 900 * S
    w = W.partitionBy("station").orderBy("us")
    half = lambda a, b: F.floor((a + b) / 2).cast("long")
    d = d.withColumn("from", F.greatest(F.col("us") - reach, F.coalesce(half(F.lag("us").over(w), F.col("us")) + 1, F.col("us") - reach)))
    d = d.withColumn("to", F.least(F.col("us") + reach, F.coalesce(half(F.col("us"), F.lead("us").over(w)), F.col("us") + reach)))
    line = lambda low, high, slope: F.struct(low.alias("low"), high.alias("high"), F.lit(slope).cast("long").alias("slope"), F.col("us"))
    lines = d.select(F.explode(F.array(line(F.col("from"), F.col("us"), -1), line(F.col("us") + 1, F.col("to"), 1))).alias("l")).select("l.*").where("low <= high")
    bucket = lambda x: F.floor(x / F.lit(reach)).cast("long")
    lines = lines.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    # residual = slope * (time - us), with times counted from the bucket's start
    base = F.col("bucket") * reach
    ends = F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("one")), F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias("one"))))
    steps = lines.select("bucket", "slope", (F.col("us") - base).alias("us"), ends.alias("e")).select("bucket", "e.at", F.lit(None).cast("long").alias("cat_id"), F.col("e.one").cast("long").alias("n"), (F.col("e.one") * F.col("slope")).alias("k"), (-F.col("e.one") * F.col("slope") * F.col("us")).alias("c"))
    zero = F.lit(0).cast("long")
    asks = _catalogue(spark, sf_dir).select(bucket(F.col("cat_us")).alias("bucket"), F.col("cat_us").alias("at"), "cat_id", zero.alias("n"), zero.alias("k"), zero.alias("c"))
    so_far = W.partitionBy("bucket").orderBy("at", F.col("cat_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    x = steps.unionByName(asks).select("cat_id", "at", base.alias("base"), *[F.sum(c).over(so_far).alias(c) for c in ("n", "k", "c")]).where("cat_id is not null and n >= 3")
    return x.select("cat_id", F.col("n").alias("stations"), ((F.col("k") * (F.col("at") - F.col("base")) + F.col("c")) / F.col("n")).alias("mean"))


KNN = f"""d AS (SELECT c_custkey, s_suppkey, {km_sql(LAT.format(k='c_custkey'), LON.format(k='c_custkey'), LAT.format(k='s_suppkey'), LON.format(k='s_suppkey'))} AS km FROM customer, supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS n FROM d)"""


@query("kth_nearest", f"WITH {KNN} SELECT c_custkey, s_suppkey, round(km, 6) AS km, n FROM r WHERE n <= 2")
def kth_nearest(spark, sf_dir):
    """The nearest and second nearest site of every customer."""
    place_of = lambda t, k: table(spark, sf_dir, t).select(k, place(F.col(k))[0].alias("lat"), place(F.col(k))[1].alias("lon"))
    sites = place_of("supplier", "s_suppkey")
    cell = max(0.05, (72 * 3 / max(1, sites.count())) ** 0.5)  # degrees: about three sites a cell in the region of 6 by 12
    return ranges.nearest_places(place_of("customer", "c_custkey"), sites, "c_custkey", "s_suppkey", 2, cell).select("c_custkey", "s_suppkey", r6(F.col("km")).alias("km"), "n")


@query(
    "closest_pair",
    f"""WITH d AS (SELECT a.s_nationkey AS nation, a.s_suppkey AS a, b.s_suppkey AS b, {km_sql(LAT.format(k='a.s_suppkey'), LON.format(k='a.s_suppkey'), LAT.format(k='b.s_suppkey'), LON.format(k='b.s_suppkey'))} AS km FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT nation, round(km, 6) AS km, a, b FROM d QUALIFY row_number() OVER (PARTITION BY nation ORDER BY km, a, b) = 1""",
)
def closest_pair(spark, sf_dir):
    """The closest pair of sites of each nation."""
    lat, lon = place(F.col("s_suppkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), lat.alias("lat"), lon.alias("lon"))
    m = ranges.closest_pairs(s, "nation", "key")
    return m.select("nation", r6(F.col("km")).alias("km"), "a", "b")


@query(
    "rejoin_with_tolerance",
    f"""WITH {CAT}, t AS (SELECT cat_id AS want_id, cat_us + (cat_id % 3 - 1) * 400000 AS want_us, size + 0.03::DOUBLE AS want_size FROM cat)
SELECT t.want_id, count(c.cat_id) AS hits, min(c.cat_id) AS cat_id, CASE WHEN count(c.cat_id) = 1 THEN 'one' WHEN count(c.cat_id) = 0 THEN 'none' ELSE 'several' END AS verdict
FROM t LEFT JOIN cat c ON abs(t.want_us - c.cat_us) <= 1000000 AND abs(t.want_size - c.size) < 0.051 GROUP BY t.want_id""",
)
def rejoin_with_tolerance(spark, sf_dir):
    """Rows found again in a catalogue by time and size, and whether exactly one fits."""
    c = _catalogue(spark, sf_dir)
    t = c.select(F.col("cat_id").alias("want_id"), (F.col("cat_us") + (F.col("cat_id") % 3 - 1) * 400_000).alias("want_us"), (F.col("size") + 0.03).alias("want_size"))
    hits = ranges.tolerance_join(t, c, "want_us", "cat_us", S).where(F.abs(F.col("want_size") - F.col("size")) < 0.051).groupBy("want_id").agg(F.count("*").alias("hits"), F.min("cat_id").alias("cat_id"))
    out = t.select("want_id").join(hits, "want_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("hits") == 1, "one").when(F.col("hits") == 0, "none").otherwise("several"))


@query(
    "outcome_pairing",
    f"""WITH {CAT}, o AS (SELECT c.cat_id, k.kind, count(d.event_id) > 0 AS hit FROM cat c CROSS JOIN (SELECT unnest(['click', 'view']) AS kind) k LEFT JOIN det d ON d.kind = k.kind AND abs(d.us - c.cat_us) <= 600000000 GROUP BY 1, 2)
SELECT a.hit AS hit_a, b.hit AS hit_b, count(*) AS n FROM o a JOIN o b USING (cat_id) WHERE a.kind = 'click' AND b.kind = 'view' GROUP BY 1, 2""",
)
def outcome_pairing(spark, sf_dir):
    """Outcomes of two detectors on the same catalogue rows, crossed."""
    c = _catalogue(spark, sf_dir)
    d = _detections(spark, sf_dir)
    hit = lambda kind, name: ranges.tolerance_join(c, d.where(F.col("kind") == kind), "cat_us", "us", 600 * S, how="left_semi").select("cat_id", F.lit(True).alias(name))
    both = c.select("cat_id").join(hit("click", "hit_a"), "cat_id", "left").join(hit("view", "hit_b"), "cat_id", "left").fillna(False, ["hit_a", "hit_b"])
    return both.groupBy("hit_a", "hit_b").agg(F.count("*").alias("n"))


@query(
    "detection_attributes",
    f"""WITH {CAT}, p AS (SELECT d.event_id, p.event_id AS pick, row_number() OVER (PARTITION BY d.event_id ORDER BY p.us) AS f, row_number() OVER (PARTITION BY d.event_id ORDER BY p.us DESC) AS l
FROM (SELECT * FROM e WHERE kind = 'error') d JOIN (SELECT * FROM e WHERE kind = 'view') p ON d.station = p.station AND p.us BETWEEN d.us AND d.us + 172800000000)
SELECT d.event_id, max(pick) FILTER (f = 1) AS first_pick, max(pick) FILTER (l = 1) AS last_pick FROM e d LEFT JOIN p ON d.event_id = p.event_id WHERE d.kind = 'error' GROUP BY d.event_id""",
)
def detection_attributes(spark, sf_dir):
    """Detections with their first and latest follow-up of the same station within two days."""
    e = detections(spark, sf_dir)
    d = e.where("kind = 'error'").select("event_id", "station", F.col("us").alias("lo"), (F.col("us") + 172_800 * S).alias("hi"))
    p = e.where("kind = 'view'").select("station", "us", F.col("event_id").alias("pick"))
    m = ranges.range_join(p, d, "us", "lo", "hi", 172_800 * S, ["station"]).groupBy("event_id").agg(F.min_by("pick", "us").alias("first_pick"), F.max_by("pick", "us").alias("last_pick"))
    return d.select("event_id").join(m, "event_id", "left")


@query(
    "geo_functions",
    f"""WITH s AS (SELECT s_suppkey, {km_sql(LAT.format(k='s_suppkey'), LON.format(k='s_suppkey'), '38.0::DOUBLE', '30.0::DOUBLE')} AS km FROM supplier)
SELECT s_suppkey, round(km, 6) AS km, round(km / (6371.0::DOUBLE * pi() / 180), 6) AS deg, round(sqrt(km * km + 100) / 6, 6) AS p_s, round((sqrt(km * km + 100) / 3.5 - sqrt(km * km + 100) / 6) * (6 * 3.5 / 2.5), 6) AS from_delay FROM s""",
)
def geo_functions(spark, sf_dir):
    """Distance, degrees, travel time and the distance that a delay stands for."""
    km = geo.distance_km(*place(F.col("s_suppkey")), F.lit(38.0), F.lit(30.0))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", km.alias("km"))
    p, q = geo.travel_time(F.col("km")), geo.travel_time(F.col("km"), 10.0, 3.5)
    return s.select("s_suppkey", r6(F.col("km")).alias("km"), r6(geo.km_to_degrees(F.col("km"))).alias("deg"), r6(p).alias("p_s"), r6(geo.distance_from_delay(q - p)).alias("from_delay"))


FLAGSHIP = f"""WITH {CAT}, {PAIRS}, g AS (SELECT a_id, count(DISTINCT b_station) + 1 AS stations, greatest(max(a_us), max(b_us)) AS us FROM q GROUP BY a_id HAVING count(DISTINCT b_station) >= 1),
m AS (SELECT g.a_id, c.cat_id, c.size, row_number() OVER (PARTITION BY g.a_id ORDER BY abs(g.us - c.cat_us), c.cat_us, c.cat_id) AS n FROM g JOIN cat c ON abs(g.us - c.cat_us) <= 600000000),
h AS (SELECT cat_id, min(a_id) AS alarm FROM m WHERE n = 1 GROUP BY cat_id)
SELECT least(4, floor(c.size / 20))::BIGINT AS band, count(*) AS events, count(h.alarm) AS detected FROM cat c LEFT JOIN h ON c.cat_id = h.cat_id GROUP BY 1"""


@query("association_scorecard", FLAGSHIP)
def association_scorecard(spark, sf_dir):
    """From detections to a scorecard: associated, declared, matched with the catalogue, summed up by size."""
    g = partners.alarms(_placed(spark, sf_dir), ("last_us",)).select("a_id", F.greatest("a_us", "last_us").alias("us"))
    c = _catalogue(spark, sf_dir)
    best = ranges.nearest_join(g, c.select("cat_id", "cat_us"), "us", "cat_us", 600 * S, ties=["cat_id"]).select("a_id", "cat_id")
    hit = best.groupBy("cat_id").agg(F.min("a_id").alias("alarm"))
    band = F.least(F.lit(4), F.floor(F.col("size") / 20)).cast("long")
    return c.join(hit, "cat_id", "left").groupBy(band.alias("band")).agg(F.count("*").alias("events"), F.count("alarm").alias("detected"))
