"""How well sets of stations watch a region: by node of a grid the alert's time, what the alert cannot reach, the error of a
location and the widest gap of bearings; by set their weighted means, and the same with the worst station lost.

A node keeps sums of its normal matrix and its three first stations, never its list of stations. To lose a station changes
only nodes at which it is one of the two first: they go dark if there is no third, and wait for the third otherwise. So
all losses are sums over nodes, and no set is scored again without each of its stations.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.functions import geo

#: Kilometres of a degree of longitude at the equator and of latitude; 95% of a chi-square with two degrees of freedom (fixed values).
EAST_KM, NORTH_KM, CHI2 = 111.32, 110.57, 5.991


def node_geometry(stations: DataFrame, nodes: DataFrame, depth: float = 10.0, reach: float = 150.0, latency: float = 2.0, vp: float = 6.0, vs: float = 3.5, sigma_p: float = 0.3, sigma_s: float = 0.5) -> DataFrame:
    """One row for each set and node with two stations of the set in reach.

    ``stations`` has subset, station, lat, lon; ``nodes`` node, lat, lon, weight. Stations meet the nodes of their band of
    latitude and the two beside it; what is in reach is shuffled once by set and node, which both windows and the sums share. Columns: subset, node, weight, n, alert_s,
    blind_km, location_km (semi-axis of the 95% ellipse), step_deg and close_deg (the widest gap between bearings in
    order, and that from the last to the first), first, second (stations) and third_s (alert time without one of these; null
    if there is no third). Stations without a set or place take no part; equal places are a gap of zero.
    """
    s = stations.select("subset", "station", F.col("lat").alias("la"), F.col("lon").alias("lo")).where("subset is not null and la is not null and lo is not null")
    band = lambda c: F.floor(F.col(c) / (reach * 1.001 / (geo.EARTH_KM * math.pi / 180))).cast("long")
    around = nodes.withColumn("band", F.explode(F.sequence(band("lat") - 1, band("lat") + 1)))
    near = s.withColumn("band", band("la")).join(around, "band").withColumn("km", geo.distance_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))).where(F.col("km") <= reach)
    east, north = (F.col("lo") - F.col("lon")) * EAST_KM * F.cos(F.radians("lat")), (F.col("la") - F.col("lat")) * NORTH_KM
    far = F.sqrt(F.col("km") * F.col("km") + depth * depth)
    near = near.select("subset", "node", "weight", "station", F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)).alias("az"), (far / vp).alias("t"), (-east / far).alias("x"), (-north / far).alias("y"))
    here = W.partitionBy("subset", "node")
    near = near.withColumn("step", F.col("az") - F.lag("az").over(here.orderBy("az", "station"))).withColumn("k", F.row_number().over(here.orderBy("t", "station")))
    both = 1 / (vp * sigma_p) ** 2 + 1 / (vs * sigma_s) ** 2
    mixed, times = 1 / (vp * sigma_p**2) + 1 / (vs * sigma_s**2), 1 / sigma_p**2 + 1 / sigma_s**2
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    x, y = F.col("x"), F.col("y")
    g = near.groupBy("subset", "node", "weight").agg(
        F.count("*").alias("n"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.max("step").alias("step_deg"),
        (F.min("az") + 360 - F.max("az")).alias("close_deg"), at(1, "station").alias("first"), at(2, "station").alias("second"), (at(2, "t") + latency).alias("alert_s"), (at(3, "t") + latency).alias("third_s"),
    ).where("n >= 2")
    # the time of origin taken out of the normal matrix: the inverse of what is left is the epicentre's covariance
    o = F.col("n") * times + 1e-12
    a = F.col("xx") * both + 1e-12 - F.col("x") * F.col("x") * mixed**2 / o
    d = F.col("yy") * both + 1e-12 - F.col("y") * F.col("y") * mixed**2 / o
    b = F.col("xy") * both - F.col("x") * F.col("y") * mixed**2 / o
    least = (a + d - F.sqrt((a - d) * (a - d) + 4 * b * b)) / 2
    blind = F.sqrt(F.greatest(F.pow(F.col("alert_s") * vs, F.lit(2.0)) - depth * depth, F.lit(0.0)))
    return g.select("subset", "node", "weight", "n", "alert_s", blind.alias("blind_km"), F.sqrt(CHI2 / F.greatest(least, F.lit(1e-12))).alias("location_km"), "step_deg", "close_deg", "first", "second", "third_s")


def subset_scores(found: DataFrame, stations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each set of ``stations``: k, coverage, means over covered nodes by weight (alert_s, blind_km, gap_deg, round_deg),
    the weighted median of location_km, worst_coverage and worst_alert_s.

    ``found`` is a written table of :func:`node_geometry`. ``round_deg`` is the widest gap all the way round; ``gap_deg`` counts
    the gap from the last bearing to the first only where the whole set is in reach. Sets of two stations and fewer have
    a worst coverage of 0 and no worst alert; where no weight is covered, coverage is 0 and means are null.
    """
    w = F.col("weight")
    total = nodes.agg(F.sum("weight").alias("total"))
    sets = stations.where("subset is not null and lat is not null and lon is not null").groupBy("subset").agg(F.count("*").alias("k"))
    f = found.join(sets, "subset")
    whole = F.greatest("step_deg", "close_deg")
    mean = lambda c: F.sum(w * c)
    sums = f.groupBy("subset").agg(F.sum(w).alias("w"), mean(F.col("alert_s")).alias("alert"), mean(F.col("blind_km")).alias("blind"), mean(F.when(F.col("n") == F.col("k"), whole).otherwise(F.col("step_deg"))).alias("gap"), mean(whole).alias("round"))
    order = W.partitionBy("subset").orderBy("location_km", "node")
    up = found.where("weight > 0").withColumn("up", F.sum(w).over(order.rowsBetween(W.unboundedPreceding, 0))).join(sums.select("subset", "w"), "subset")
    median = up.where("up >= w / 2").groupBy("subset").agg(F.min("location_km").alias("location_km"))
    dark = F.col("third_s").isNull()
    lost = found.select("subset", F.explode(F.array("first", "second")).alias("station"), F.when(dark, -w).otherwise(F.lit(0.0)).alias("dw"), (w * F.when(dark, -F.col("alert_s")).otherwise(F.col("third_s") - F.col("alert_s"))).alias("da"))
    lost = lost.groupBy("subset", "station").agg(F.sum("dw").alias("dw"), F.sum("da").alias("da")).join(sums.select("subset", "w", "alert"), "subset")
    left = F.col("w") + F.col("dw")
    worst = lost.groupBy("subset").agg(F.min(left).alias("least"), F.max(F.when(left > F.col("w") * 1e-9, (F.col("alert") + F.col("da")) / left)).alias("latest"))
    r = sets.join(sums, "subset", "left").join(median, "subset", "left").join(worst, "subset", "left").join(F.broadcast(total), F.lit(True))
    ratio = lambda c: F.when(F.col("w") > 0, F.col(c) / F.col("w"))
    part = lambda c: F.when((F.col("total") > 0) & F.col(c).isNotNull(), F.col(c) / F.col("total")).otherwise(F.lit(0.0))
    many = F.col("k") > 2
    return r.select(
        "subset", "k", part("w").alias("coverage"), ratio("alert").alias("alert_s"), ratio("blind").alias("blind_km"), "location_km", ratio("gap").alias("gap_deg"), ratio("round").alias("round_deg"),
        F.when(many, F.least(part("w"), part("least"))).otherwise(F.lit(0.0)).alias("worst_coverage"), F.when(many, F.greatest(ratio("alert"), "latest")).alias("worst_alert_s"),
    )
