"""Alarms credited to events again with other travel times, and subsets of stations held against what they did."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions import geo
from tremolo.operators import ranges, stats
from tremolo.sources.shared import staged

S = 1_000_000


def rematch(
    detections: DataFrame, alarms: DataFrame, events: DataFrame, times: Callable[[Column, Column], tuple[Column, Column]], tolerance: float, longest: float, most_km: float = 30.0, most_s: float = 5.0
) -> tuple[DataFrame, DataFrame]:
    """The event that each alarm is credited with (alarm, event, miss_us; null: none), and every event with its first alarm
    (event, alarm, detected, before): ``before`` where all of the alarm's detections were declared before the second arrival.

    ``detections``: alarm, station, us, declared, lat, lon, one a station; ``alarms``: alarm, lat, lon, origin of its
    location (null: not located); ``events``: event, event_us, event_lat, event_lon, depth; ``times``: seconds of the first
    and second arrival by km and depth, which must not be over ``longest``. An alarm's miss is the least difference of a
    detection from the first arrival there, or a hundredth of the location's in time where that is within ``most_km`` and
    ``most_s``; the least miss up to ``tolerance`` seconds has the credit, of equal ones the earlier event and the smaller
    id. Misses are compared in microseconds. Alarms without detections are matched by their location alone.

    Detections of an alarm travel as one list; one join by time gives all candidates of both kinds.
    """
    d = detections.where("us is not null and lat is not null and lon is not null").groupBy("alarm").agg(F.collect_list(F.struct("us", "declared", "lat", "lon")).alias("seen"), F.min("us").alias("first"), F.max("us").alias("last"))
    a = alarms.select("alarm", F.struct("lat", "lon", "origin").alias("at")).join(d, "alarm", "left")
    low = F.least(F.col("first") - int((longest + tolerance) * S), F.col("at.origin") - int(most_s * S))
    high = F.greatest(F.col("last") + int(tolerance * S), F.col("at.origin") + int(most_s * S))
    spans = a.withColumn("low", low).withColumn("high", high).where("low is not null")
    e = events.select("event", "event_us", "event_lat", "event_lon", F.coalesce(F.col("depth").cast("double"), F.lit(10.0)).alias("depth")).where("event_us is not null and event_lat is not null and event_lon is not null")
    pairs = ranges.range_join(e, spans, "event_us", "low", "high", int((longest + 2 * tolerance + 2 * most_s) * S))
    km = lambda x: geo.distance_km(F.col("event_lat"), F.col("event_lon"), x["lat"], x["lon"])
    late = lambda x: F.round(F.abs((x["us"] - F.col("event_us")).cast("double") - times(km(x), F.col("depth"))[0] * S)).cast("long")
    off = F.abs(F.col("at.origin") - F.col("event_us"))
    located = F.when((km(F.col("at")) <= most_km) & (off <= int(most_s * S)), F.round(off / 100.0).cast("long"))
    miss = F.least(F.array_min(F.transform("seen", late)), located)
    before = F.forall("seen", lambda x: x["declared"].cast("double") < F.col("event_us") + times(km(x), F.col("depth"))[1] * S)
    found = pairs.select("alarm", miss.alias("miss_us"), "event_us", "event", (F.coalesce(F.size("seen") > 0, F.lit(False)) & F.coalesce(before, F.lit(False))).alias("before")).where(F.col("miss_us") <= int(tolerance * S))
    best = found.groupBy("alarm").agg(F.min(F.struct("miss_us", "event_us", "event", "before")).alias("b"))
    credit = alarms.select("alarm").join(best, "alarm", "left").select("alarm", F.col("b.event").alias("event"), F.col("b.miss_us").alias("miss_us"))
    first = best.groupBy(F.col("b.event").alias("event")).agg(F.min(F.struct("alarm", F.col("b.before").alias("before"))).alias("f"))
    scored = events.select("event").join(first, "event", "left")
    return credit, scored.select("event", F.col("f.alarm").alias("alarm"), F.col("f.alarm").isNotNull().alias("detected"), F.coalesce("f.before", F.lit(False)).alias("before"))


def prediction_check(subsets: DataFrame, observed: DataFrame, velocity: float = 6.0, depth: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Every subset that alarmed with the arrival at its second nearest station (subset, predicted_s, observed_s, latency_s),
    and one row about them: subsets, median, quartiles of the latency, and the rank correlation of both times.

    ``subsets``: subset, station, km of each station from the source; ``observed``: subset, observed_s. Subsets of fewer than
    two stations with a distance, and those without an observed time, take no part. The correlation is null where either
    side does not vary. A subset's two nearest are a partial aggregate; ranks come from counts of distinct values.
    """
    s = subsets.where("km is not null").groupBy("subset", "station").agg(F.min("km").alias("km"))
    two = s.groupBy("subset").agg(F.min("km").alias("one"), F.min_by("station", F.struct("km", "station")).alias("nearest"))
    second = s.join(two, "subset").where(F.col("station") != F.col("nearest")).groupBy("subset").agg(F.min("km").alias("km"))
    o = observed.where("observed_s is not null").join(second, "subset")
    p = o.select("subset", F.round(F.hypot(F.col("km"), F.lit(depth)) / velocity, 6).alias("predicted_s"), "observed_s")
    p = staged(p.withColumn("latency_s", F.round(F.col("observed_s") - F.col("predicted_s"), 6)), "prediction-check")  # read for ranks and quantiles
    x, y = (stats.mean_ranks(p, c).select(c, F.col("rank").alias(r)) for c, r in (("predicted_s", "x"), ("observed_s", "y")))
    ranked = p.join(x, "predicted_s").join(y, "observed_s")
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    cov, vx, vy = n * F.sum(F.col("x") * F.col("y")) - sx * sy, n * F.sum(F.col("x") * F.col("x")) - sx * sx, n * F.sum(F.col("y") * F.col("y")) - sy * sy
    rho = ranked.agg(n.alias("subsets"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when(vx > 0, vx)) / F.sqrt(F.when(vy > 0, vy))).alias("rho"))
    q = stats.interpolated_all(p, "latency_s", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return p, rho.join(F.broadcast(q), how="left").select("subsets", "median", "q25", "q75", "rho")


def worst(checked: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` subsets with the largest latency, of either sign; ties to the smaller subset."""
    return checked.orderBy(F.abs("latency_s").desc(), "subset").limit(k)
