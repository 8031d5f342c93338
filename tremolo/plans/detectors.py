"""Queries of continuous detectors, of events made from detections in order, and of verdicts on them.

Stations' values in order of time stand for samples; sources and picks are made up, so that the answer is known.
"""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.functions import arrays, geo
from tremolo.operators import censored, events, fold, picker, ranges
from tremolo.plans.joins import S, _placed
from tremolo.plans.registry import DETECTIONS, detections, place, query, r6, table
from tremolo.plans.signals import _x

SETTINGS = picker.Settings(rate=10.0, longest=0.8, memory=2.0, level=3.0, area=2.0, within=0.4)
BEFORE, AFTER, LONG_AFTER = 1800 * S, 7200 * S, 21_600 * S


def _samples(spark, sf_dir):
    """Values of ten channels, numbered in order of time; every hundredth number is missing."""
    e = detections(spark, sf_dir).withColumn("channel", F.col("station") % 10)
    at = F.row_number().over(W.partitionBy("channel").orderBy("us", "event_id")).cast("long")
    return e.select("channel", (at + F.floor(at / 100)).alias("at"), (F.col("value") - 40).alias("x"))


STATIONS = 6


def _truth(spark, sf_dir):
    """Every tenth nation's customers as sources in reach of six stations each."""
    c = table(spark, sf_dir, "customer").where("c_nationkey % 10 = 3").select(F.col("c_custkey").alias("event"))
    la, lo = place(F.col("event"))
    return c.withColumn("la", la).withColumn("lo", lo)


def _observed(spark, sf_dir, late: float = 0.0):
    """Six stations around each source with exact arrival times; ``late`` seconds are added at station 4."""
    o = _truth(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STATIONS - 1))))
    angle = F.col("k") * F.lit(2 * math.pi / STATIONS) + F.col("event") % 7
    o = o.withColumn("lat", F.col("la") + (0.2 + F.col("k") * 0.05) * F.sin(angle)).withColumn("lon", F.col("lo") + (0.2 + F.col("k") * 0.05) * F.cos(angle))
    km = geo.distance_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    extra = F.when(F.col("k") == 4, F.lit(late)).otherwise(F.lit(0.0))
    o = o.withColumn("p_time", 100 + geo.travel_time(km, 10.0, 6.0) + extra).withColumn("s_time", 100 + geo.travel_time(km, 10.0, 3.5) + extra)
    return o.select("event", F.col("k").alias("station"), "lat", "lon", "p_time", "s_time", F.log(F.greatest(km, F.lit(1.0))).alias("log_km"), F.lit(0.2).alias("log_sd"))


@query("multiband_picks")
def multiband_picks(spark, sf_dir):
    """Onsets by the largest of several bands' deviations, with polarity and the interval of their uncertainty."""
    step = picker.pick_step(["channel"], "at", "x", SETTINGS)
    p = fold.ordered_fold(_samples(spark, sf_dir), ["channel"], ["at"], step, f"channel bigint, {picker.PICKS}")
    return p.select("channel", "time", "first", "last", "accepted", "polarity", *[r6(F.col(c)).alias(c) for c in ("weight", "amplitude", "period")])


@query("picker_triggers")
def picker_triggers(spark, sf_dir):
    """Onsets of the bands, of which none is within forty samples of the last accepted one."""
    return fold.greedy_min_gap(multiband_picks(spark, sf_dir), "time", 40, ["channel"], ["channel", "time", "accepted"], ["accepted"])


@query("stalta_triggers")
def stalta_triggers(spark, sf_dir):
    """Onsets of short over long averages with hysteresis and a least distance from the last accepted one."""
    step = picker.ratio_step(["channel"], "at", "x", 4, 16, 1.6, 1.0, 10)
    return fold.ordered_fold(_samples(spark, sf_dir), ["channel"], ["at"], step, "channel bigint, at bigint, ratio double").withColumn("ratio", r6(F.col("ratio")))


@query("causal_band_pass")
def causal_band_pass(spark, sf_dir):
    """Samples through a causal band pass by gap-free run; what is too short for it is null."""
    step, end = picker.band_step(["channel"], "at", "x", 0.5, 3.0, 10.0, 10)
    f = fold.ordered_fold(_samples(spark, sf_dir), ["channel"], ["at"], step, "channel bigint, at bigint, x double", end)
    return f.select("channel", "at", (r6(F.col("x")) + F.lit(0.0)).alias("y"))


RULES = "t AS (SELECT unnest([50, 100, 200]) AS level)"


@query(
    "trigger_score",
    f"""WITH {DETECTIONS}, {RULES}, d AS (SELECT station % 10 AS channel, event_id, us, value, coalesce(lag(value) OVER (PARTITION BY station % 10 ORDER BY us, event_id), 0) AS before FROM e WHERE kind <> 'purchase'),
a AS (SELECT station % 10 AS channel, event_id AS arrival, us AS p FROM e WHERE kind = 'purchase'),
s AS (SELECT level, arrival, coalesce(max(value), 0) AS top, count(*) FILTER (value >= level AND before < level) AS n FROM a CROSS JOIN t LEFT JOIN d ON d.channel = a.channel AND d.us BETWEEN p - {BEFORE} AND p + {AFTER} GROUP BY level, arrival),
o AS (SELECT level, count(*) AS arrivals, count(*) FILTER (n > 0) AS detected, count(*) FILTER (n = 0 AND top < level) AS never_reached, count(*) FILTER (n = 0 AND top >= level) AS not_rearmed FROM s GROUP BY level),
u AS (SELECT level, count(*) AS triggers, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.channel = d.channel AND d.us BETWEEN p - {BEFORE} AND p + {LONG_AFTER})) AS unmatched FROM d CROSS JOIN t WHERE value >= level AND before < level GROUP BY level)
SELECT o.*, coalesce(triggers, 0) AS triggers, coalesce(unmatched, 0) AS unmatched FROM o LEFT JOIN u USING (level)""",
)
def trigger_score(spark, sf_dir):
    """By trigger level: arrivals detected, never reached and met by a trigger that was not armed again; triggers that no
    arrival explains. One pass over arrivals with the values near them serves all levels."""
    e = detections(spark, sf_dir).withColumn("channel", F.col("station") % 10)
    before = F.coalesce(F.lag("value").over(W.partitionBy("channel").orderBy("us", "event_id")), F.lit(0.0))
    d = e.where("kind <> 'purchase'").withColumn("before", before).select("channel", "us", "value", "before", F.col("event_id").alias("det"))
    a = e.where("kind = 'purchase'").select("channel", F.col("event_id").alias("arrival"), F.col("us").alias("p"))
    spans = a.withColumn("lo", F.col("p") - BEFORE).withColumn("hi", F.col("p") + AFTER)
    near = ranges.range_join(d, spans, "us", "lo", "hi", BEFORE + AFTER, ["channel"])
    levels, rises = [50, 100, 200], lambda v: (F.col("value") >= v) & (F.col("before") < v)
    s = near.groupBy("arrival").agg(F.max("value").alias("top"), *[F.count_if(rises(v)).alias(f"n{v}") for v in levels])
    s = a.select("arrival").join(s, "arrival", "left").fillna(0)
    of = lambda f: F.explode(F.array(*[F.struct(F.lit(v).alias("level"), *f(v)) for v in levels])).alias("r")
    s = s.select("arrival", of(lambda v: (F.col(f"n{v}").alias("n"), F.col("top"))))
    o = s.groupBy("r.level").agg(F.count("*").alias("arrivals"), F.count_if(F.expr("r.n > 0")).alias("detected"), F.count_if(F.expr("r.n = 0 and r.top < r.level")).alias("never_reached"), F.count_if(F.expr("r.n = 0 and r.top >= r.level")).alias("not_rearmed"))
    long = a.withColumn("lo", F.col("p") - BEFORE).withColumn("hi", F.col("p") + LONG_AFTER).drop("arrival")
    fired = d.where(rises(levels[0]) | rises(levels[1]) | rises(levels[2]))
    known = ranges.range_join(fired, long, "us", "lo", "hi", BEFORE + LONG_AFTER, ["channel"]).select("det").distinct().withColumn("known", F.lit(True))
    u = fired.join(known, "det", "left").select("known", of(lambda v: (rises(v).alias("fires"),))).where("r.fires").groupBy("r.level").agg(F.count("*").alias("triggers"), F.count_if(F.col("known").isNull()).alias("unmatched"))
    return o.join(u, "level", "left").fillna(0)


def _network(spark, sf_dir):
    """Detections of ten networks in seconds, with their stations' places; some are restarts."""
    e = detections(spark, sf_dir)
    lat, lon = place(F.col("station"))
    return e.select((F.col("station") % 10).alias("network"), "event_id", (F.col("us") / S).alias("t"), "station", lat.alias("lat"), lon.alias("lon"), (F.col("event_id") % 11 == 0).alias("restart"))


@query("event_assignment")
def event_assignment(spark, sf_dir):
    """Every detection with the event that it begins, joins, declares or is the coda of."""
    step = events.assign_step(["network"], "event_id", "t", 3, 3600.0, 1500.0, 300.0, largest=True)
    return fold.ordered_fold(_network(spark, sf_dir), ["network"], ["t", "event_id"], step, f"network bigint, event_id bigint, {events.ASSIGNED}")


@query("merge_duplicates", "SELECT c_custkey AS event, '0,1,2' AS stay, '4,5' AS joined, true AS fits FROM customer WHERE c_nationkey % 10 = 3 AND c_custkey % 2 = 0")
def merge_duplicates(spark, sf_dir):
    """Events seen twice: stations 0 to 3, of which 3 was early by chance and is left out, and 3 to 5. Of odd sources the second event is
    another one, ten seconds later at each station and of other stations, and stays apart."""
    o = _observed(spark, sf_dir).withColumn("odd", F.col("event") % 2 == 1)
    first = o.where("station <= 3").withColumn("own", F.lit(False)).withColumn("p_time", F.col("p_time") - F.when((F.col("station") == 3) & ~F.col("odd"), 9.0).otherwise(0.0))
    second = o.where("station >= 3").withColumn("own", F.lit(True)).withColumn("p_time", F.col("p_time") + F.when(F.col("odd"), 10.0 + 7 * (F.col("station") - 3)).otherwise(0.0))
    m = events.merge_duplicates(first.unionByName(second), "event")
    return m.select("event", "stay", "joined", (F.col("rms") < 0.2).alias("fits"))


@query("assess_events", "SELECT c_custkey AS event, CASE c_custkey % 6 WHEN 0 THEN 'earthquake' WHEN 1 THEN 'earthquake' WHEN 2 THEN 'possible' WHEN 3 THEN 'unclassified' WHEN 4 THEN 'misfire' ELSE 'earthquake' END AS verdict, CASE c_custkey % 6 WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS stations, CASE WHEN c_custkey % 6 = 1 THEN '4' ELSE '' END AS dropped FROM customer WHERE c_nationkey % 10 = 3")
def assess_events(spark, sf_dir):
    """Verdicts on made events: all stations fit; all but a late one; two without and two with support by their distances;
    one station; three that no source fits."""
    case = F.col("event") % 6
    o = _observed(spark, sf_dir).where(~((case.isin(2, 5)) & (F.col("station") > 1)) & ~((case == 3) & (F.col("station") > 0)) & ~((case == 4) & (F.col("station") > 2)))
    late = F.when((case == 1) & (F.col("station") == 4), 12.0).otherwise(0.0)
    s_late = late + F.when(case == 4, 8.0 * F.col("station")).otherwise(0.0)
    o = o.withColumn("p_time", F.col("p_time") + late).withColumn("s_time", F.col("s_time") + s_late)
    known = case == 5
    o = o.withColumn("log_km", F.when(known, F.col("log_km"))).withColumn("log_sd", F.when(known, F.col("log_sd"))).withColumn("chance", F.lit(None).cast("double"))
    return events.assessments(o, "event").select("event", "verdict", "stations", "dropped")


@query("alarm_detections")
def alarm_detections(spark, sf_dir):
    """Alarms put together again: of every station within 150 km that may have taken part, one detection, all pairwise compatible."""
    return events.reconstruct(_placed(spark, sf_dir), 150.0)


@query("censored_fit")
def censored_fit(spark, sf_dir):
    """A linear relation of orders' values, of which those below a level are only bounded, by maximum likelihood."""
    y = F.log10("o_totalprice")
    o = table(spark, sf_dir, "orders").select(F.greatest(y, F.lit(4.7)).alias("y"), (y < 4.7).alias("c"), F.lit(1.0).alias("one"), (F.col("o_custkey") % 10 / 10.0).alias("share"), (F.col("o_orderstatus") == "F").cast("double").alias("done"))
    f = censored.fit_censored(o, "y", ["one", "share", "done"], "c")
    rows = [*zip(["one", "share", "done"], f.coefficients), ("sigma", f.sigma)]
    return spark.createDataFrame([(n, round(v, 5)) for n, v in rows], "term string, value double")


def _memory(seed: int) -> tuple:
    """Small weights of two units over eight inputs, by rule."""
    w = [[((i * 5 + j * 3 + seed) % 7 - 3) / 4 for i in range(8)] for j in range(8)]
    return w, [[((i + j * 2 + seed) % 5 - 2) / 4 for i in range(2)] for j in range(8)], [(j % 3 - 1) / 10 for j in range(8)]


@query("bidirectional_memory")
def bidirectional_memory(spark, sf_dir):
    """Eight tokens of a vector through memories in both directions."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("x", t * 8 + 1, F.lit(8)))
    y = _x(spark, sf_dir).select("vec_id", F.posexplode(arrays.bilstm(tokens, _memory(0), _memory(1))).alias("token", "y"))
    return y.select("vec_id", "token", F.posexplode("y").alias("unit", "v")).select("vec_id", "token", "unit", (r6(F.col("v")) + F.lit(0.0)).alias("v"))
