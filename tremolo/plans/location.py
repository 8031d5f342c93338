"""Location and size queries: the alarms that detections make are located from their stations' times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremolo.functions import arrays, geo
from tremolo.operators import coverage, fold, grid, locate, partners
from tremolo.plans.joins import CAT, PAIRS, _placed
from tremolo.plans.registry import LAT, LON, detections, km_sql, place, query, r6, table
from tremolo.plans.signals import X, _long, _sql, _x
from tremolo.sources.shared import staged

#: Alarms of the detections of one kind, which are rare enough for their stations' times to overlap by chance only.
ALARM = f"""WITH {CAT.replace("kind <> 'purchase'", "kind = 'error'")}, {PAIRS}, m AS (SELECT a_id, a_station AS station, a_us AS us, a_id AS id FROM q UNION SELECT a_id, b_station, b_us, b_id FROM q),
f AS (SELECT a_id, station, arg_min(us, (us, id)) AS us, arg_min(id, (us, id)) AS id FROM m GROUP BY a_id, station),
g AS (SELECT a_id, min(us) AS first FROM f GROUP BY a_id HAVING count(*) >= 3),
s AS (SELECT a_id AS event, station, {LAT.format(k="station")} AS lat, {LON.format(k="station")} AS lon, (us - first) / 1000000.0::DOUBLE AS p_time, id FROM f JOIN g USING (a_id))"""
#: Observations of the methods: first arrivals; with second ones; with distances.
OBSERVED = {
    "first_arrivals": "SELECT *, p_time AS time, 6.0::DOUBLE AS speed, NULL::DOUBLE AS log_km, NULL::DOUBLE AS log_sd FROM s",
    "picks": "SELECT *, p_time AS time, 6.0::DOUBLE AS speed, NULL::DOUBLE AS log_km, NULL::DOUBLE AS log_sd FROM s UNION ALL SELECT *, p_time + 1 + (id % 40) / 2.0::DOUBLE, 3.5::DOUBLE, NULL, NULL FROM s",
    "geometry": "SELECT *, p_time AS time, 6.0::DOUBLE AS speed, ln(5.0::DOUBLE + id % 200) AS log_km, 0.3::DOUBLE AS log_sd FROM s",
}


def _grid_sql(obs: str, t: str, coarse: tuple[float, int] = grid.COARSE, fine: tuple[float, int] = grid.FINE) -> str:
    """Common table expressions that search every node of both grids for observations ``obs``: ``best`` and ``told``."""

    def level(name: str, centres: str, step: float, most: int) -> str:
        km = km_sql("n.lat", "n.lon", "o.lat", "o.lon")
        return f"""{name}{t} AS MATERIALIZED (SELECT event, lat, lon, sum(r) / count(*) AS origin, sqrt(greatest(sum(r * r) - sum(r) * sum(r) / count(*), 0) / count(*)) AS rms,
  greatest(sum(r * r) - sum(r) * sum(r) / count(*), 0) / 2 + coalesce(sum(d * d), 0) / 2 AS j FROM (
    SELECT event, lat, lon, time - sqrt(km * km + 100) / speed AS r, (ln(greatest(km, 1.0)) - log_km) / log_sd AS d FROM (
      SELECT n.event, n.lat, n.lon, o.time, o.speed, o.log_km, o.log_sd, {km} AS km FROM (
        SELECT event, lat0 + i * {step}::DOUBLE AS lat, lon0 + k * {step}::DOUBLE AS lon FROM {centres}, range(-{most}, {most + 1}) AS a(i), range(-{most}, {most + 1}) AS b(k)) n JOIN {obs} o ON o.event = n.event)) GROUP BY event, lat, lon)"""

    km = km_sql("b.lat", "b.lon", "o.lat", "o.lon")
    return f"""c{t} AS MATERIALIZED (SELECT event, count(*) AS stations, avg(lat) AS lat0, avg(lon) AS lon0 FROM (SELECT DISTINCT event, station, lat, lon FROM {obs}) GROUP BY event),
{level("wide", f"c{t}", *coarse)},
top{t} AS (SELECT event, min(struct_pack(j := j, lat := lat, lon := lon, origin := origin, rms := rms)) AS x FROM wide{t} GROUP BY event),
{level("near", f"(SELECT event, x.lat AS lat0, x.lon AS lon0 FROM top{t})", *fine)},
pick{t} AS (SELECT t.event, CASE WHEN n.x.j < t.x.j THEN n.x ELSE t.x END AS x FROM top{t} t JOIN (SELECT event, min(struct_pack(j := j, lat := lat, lon := lon, origin := origin, rms := rms)) AS x FROM near{t} GROUP BY event) n ON n.event = t.event),
b{t} AS (SELECT event, x.j AS j, x.lat AS lat, x.lon AS lon, x.origin AS origin, x.rms AS rms FROM pick{t}),
e{t} AS (SELECT b.event, greatest(max({km_sql("b.lat", "b.lon", "w.lat", "w.lon")}) FILTER (w.j <= b.j + {grid.ONE_SIGMA}), 6371.0::DOUBLE * radians({coarse[0]}::DOUBLE) / 2) AS error_km FROM b{t} b JOIN wide{t} w ON w.event = b.event GROUP BY b.event),
u{t} AS (SELECT event, station, abs(d) AS z, pow(r, 2) / 2 + coalesce(d * d / 2, 0) AS share FROM (SELECT event, station, time - sqrt(km * km + 100) / speed - origin AS r, (ln(greatest(km, 1.0)) - log_km) / log_sd AS d FROM (SELECT o.*, b.origin, {km} AS km FROM {obs} o JOIN b{t} b ON b.event = o.event))),
told{t} AS (SELECT event, max(z) AS z, arg_max(station, (share, station)) AS worst FROM u{t} GROUP BY event),
fit{t} AS MATERIALIZED (SELECT b.*, c.stations, e.error_km, x.z, x.worst FROM b{t} b JOIN c{t} c ON c.event = b.event JOIN e{t} e ON e.event = b.event JOIN told{t} x ON x.event = b.event)"""


_ROUNDED = "event, round(lat, 6) AS lat, round(lon, 6) AS lon, round(origin, 6) AS origin, round(rms, 6) AS rms, round(error_km, 6) AS error_km, stations, round(z, 6) AS z, worst"


def _fit_sql(method: str, **grids) -> str:
    return f"{ALARM}, obs AS MATERIALIZED ({OBSERVED[method]}), {_grid_sql('obs', '1', **grids)} SELECT {_ROUNDED} FROM fit1"


RELOCATE = f"""{ALARM}, obs AS MATERIALIZED ({OBSERVED["picks"]}), {_grid_sql("obs", "1")},
obs2 AS MATERIALIZED (SELECT o.* FROM obs o JOIN fit1 f ON f.event = o.event WHERE f.rms > 2 AND f.stations > 2 AND o.station <> f.worst), {_grid_sql("obs2", "2")}
SELECT {_ROUNDED}, '' AS dropped FROM fit1 WHERE NOT (rms > 2 AND stations > 2) UNION ALL
SELECT s.event, round(s.lat, 6), round(s.lon, 6), round(s.origin, 6), round(s.rms, 6), round(s.error_km, 6), s.stations, round(s.z, 6), s.worst, f.worst::VARCHAR FROM fit2 s JOIN fit1 f ON f.event = s.event"""


def _observed(spark, sf_dir, method):
    """The first detections of every alarm's stations as first arrivals, in seconds from the alarm's first, as lists."""
    s = partners.first_detections(_placed(spark, sf_dir, "kind = 'error'"))
    each = lambda f: F.transform("id", f)
    s = s.withColumn("time", F.col("p_time")).withColumn("speed", each(lambda i: F.lit(6.0)))
    if method == "picks":
        second = F.zip_with("p_time", "id", lambda t, i: t + 1 + i % 40 / 2.0)
        s = s.withColumn("time", F.concat("time", second)).withColumn("speed", F.concat("speed", each(lambda i: F.lit(3.5))))
        for c in ("station", "lat", "lon", "id"):
            s = s.withColumn(c, F.concat(c, c))
    near = method == "geometry"
    none = F.lit(None).cast("double")
    return s.withColumn("log_km", each(lambda i: F.log(5.0 + i % 200) if near else none)).withColumn("log_sd", each(lambda i: F.lit(0.3) if near else none))


def _rounded(f, *more):
    return f.select("event", *[r6(F.col(c)).alias(c) for c in ("lat", "lon", "origin", "rms", "error_km")], "stations", r6(F.col("z")).alias("z"), "worst", *more)


@query("locate_picks", _fit_sql("picks"))
def locate_picks(spark, sf_dir):
    """Alarms located from first and second arrivals."""
    return _rounded(grid.located(_observed(spark, sf_dir, "picks"), "event", 2))


@query("locate_geometry", _fit_sql("geometry"))
def locate_geometry(spark, sf_dir):
    """Alarms located from first arrivals and single-station distances."""
    return _rounded(grid.located(_observed(spark, sf_dir, "geometry"), "event", 3))


@query("locate_first_arrivals", _fit_sql("first_arrivals"))
def locate_first_arrivals(spark, sf_dir):
    """Alarms located from first arrivals alone."""
    return _rounded(grid.located(_observed(spark, sf_dir, "first_arrivals"), "event", 3))


@query("locate_without_worst", RELOCATE)
def locate_without_worst(spark, sf_dir):
    """Alarms located from first and second arrivals, once more without the worst station where they fit badly."""
    f = grid.located(_observed(spark, sf_dir, "picks"), "event", 2, most_rms=2.0, most_dropped=1)
    return _rounded(f.withColumn("dropped", F.array_join("dropped", ",")), "dropped")


_CLOSE = {"coarse": (0.05, 20), "fine": (0.005, 15)}


@query("one_source", _fit_sql("first_arrivals", **_CLOSE).replace(f"SELECT {_ROUNDED}", "SELECT event, round(rms, 6) AS rms, rms <= 1 AS as_one"))
def one_source(spark, sf_dir):
    """Whether one source near the stations fits all first arrivals of an alarm to a second."""
    f = grid.located(_observed(spark, sf_dir, "first_arrivals"), "event", 1, **_CLOSE)
    return f.select("event", r6(F.col("rms")).alias("rms"), (F.col("rms") <= 1).alias("as_one"))


@query("censored_size")
def censored_size(spark, sf_dir):
    """Sizes of events from values of which some are only upper bounds."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 10 = 0")
    y = F.log10("o_totalprice")
    obs = o.select((F.col("o_custkey") % 500).alias("event"), F.greatest(y, F.lit(4.7)).alias("y"), (-0.3 * (1 + F.col("o_orderkey") % 3)).cast("double").alias("base"), (y < 4.7).alias("censored"))
    f = locate.size_of_events(obs, "event")
    return f.select("event", "n", "above", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "p_small", "p_medium", "p_large")])


@query("emit_on_change")
def emit_on_change(spark, sf_dir):
    """Reports of a station that differ by a unit from the last one given out, or come from another kind."""
    e = detections(spark, sf_dir).select("station", "us", "event_id", (F.col("value") / 100).alias("mean"), F.when(F.col("kind") == "error", 1).otherwise(0).cast("long").alias("n"))
    return fold.ordered_fold(e, ["station"], ["us", "event_id"], fold.change_step("mean", "n", 1.0, ["station", "event_id", "mean", "n"]), "station bigint, event_id bigint, mean double, n bigint")


# ---- signals and layers -------------------------------------------------------------------------------------------------


@query("displacement")
def displacement(spark, sf_dir):
    """High pass, running sum over the rate, high pass: displacement of a window of velocity."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.displacement(F.col("x"), arrays.butterworth("high", 0.5, 100.0)[:1], 100.0)))


@query("peak_and_noise", f"WITH {X} SELECT vec_id, list_max(list_transform(x[31:50], lambda v: abs(v))) AS peak, list_max(list_transform(x[11:29], lambda v: abs(v))) AS noise FROM x")
def peak_and_noise(spark, sf_dir):
    """The largest amplitude from an onset on, and of the noise up to a moment before it."""
    top = lambda a, n: F.array_max(F.transform(F.slice("x", a, n), F.abs))
    return _x(spark, sf_dir).select("vec_id", top(31, 20).alias("peak"), top(11, 19).alias("noise"))


@query("onset_quality", f"WITH {X}, s AS (SELECT vec_id, sqrt(list_sum(list_transform(x[33:64], lambda v: v * v)) / 32) AS after, sqrt(list_sum(list_transform(x[1:32], lambda v: v * v)) / 32) AS before FROM x) SELECT vec_id, round(after / before, 6) AS snr, after / before >= 1.1 AS passes FROM s")
def onset_quality(spark, sf_dir):
    """Signal over noise around a pick, and whether it passes the gate."""
    s = _x(spark, sf_dir).withColumn("snr", arrays.rms(F.slice("x", 33, 32)) / arrays.rms(F.slice("x", 1, 32)))
    return s.select("vec_id", r6(F.col("snr")).alias("snr"), (F.col("snr") >= 1.1).alias("passes"))


@query("gap_runs", f"WITH {X}, l AS (SELECT vec_id, i, x[i] AS v FROM x, (SELECT unnest(range(1, 65)) AS i)), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS run FROM l WHERE abs(v) < 0.15), r AS (SELECT vec_id, run, count(*) AS n, min(i) AS first, avg(v) AS m FROM g GROUP BY ALL) SELECT vec_id, (first - 1)::INT AS first, n, round(m, 6) + 0.0::DOUBLE AS mean, n >= 5 AS filtered FROM r")
def gap_runs(spark, sf_dir):
    """Gap-free runs of samples with the mean to be taken off; runs too short for a filter are missing."""
    from pyspark.sql import Window as W

    l = _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v")).where("abs(v) < 0.15")
    g = l.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy("vec_id").orderBy("i")))
    r = g.groupBy("vec_id", "run").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.avg("v").alias("m"))
    return r.select("vec_id", "first", "n", (r6(F.col("m")) + F.lit(0.0)).alias("mean"), (F.col("n") >= 5).alias("filtered"))


@query("token_gap_mask", f"WITH {X} SELECT vec_id, (t - 1)::INT AS token, len(list_filter(x[(t - 1) * 10 + 1 : t * 10], lambda v: abs(v) >= 0.25)) > 0 AS missing FROM x, (SELECT unnest(range(1, 7)) AS t)")
def token_gap_mask(spark, sf_dir):
    """Whether any of the ten samples of a token is missing."""
    t = _x(spark, sf_dir).withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return t.select("vec_id", "token", F.exists(F.slice("x", F.col("token") * 10 + 1, F.lit(10)), lambda v: F.abs(v) >= 0.25).alias("missing"))


@query("context_refresh", "WITH e AS (SELECT user_id AS station, epoch_us(ts) // 86400000000 AS minute, value FROM events), m AS (SELECT station, minute, max(value) < 150 AND count(*) FILTER (value < 5) < 0.05 * count(*) AS quiet FROM e GROUP BY ALL) SELECT station, minute, max(minute) FILTER (quiet) OVER (PARTITION BY station ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM m")
def context_refresh(spark, sf_dir):
    """The last quiet and nearly complete span before each span: what a detector takes as its context."""
    from pyspark.sql import Window as W

    e = detections(spark, sf_dir).withColumn("minute", F.floor(F.col("us") / 86_400_000_000).cast("long"))
    m = e.groupBy("station", "minute").agg(((F.max("value") < 150) & (F.count_if(F.col("value") < 5) < 0.05 * F.count("*"))).alias("quiet"))
    before = W.partitionBy("station").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    return m.select("station", "minute", F.max(F.when(F.col("quiet"), F.col("minute"))).over(before).alias("context"))


KERNEL = (0.25, 0.5, -0.75)


@query("convolution", f"WITH {X}, p AS (SELECT vec_id, list_concat([0.0::DOUBLE], x, [0.0::DOUBLE]) AS p FROM x) SELECT vec_id, (i - 1)::INT AS i, round(greatest(p[i] * 0.25::DOUBLE + p[i + 1] * 0.5::DOUBLE - p[i + 2] * 0.75::DOUBLE + 0.01::DOUBLE, 0), 6) + 0.0::DOUBLE AS v FROM p, (SELECT unnest(range(1, 65)) AS i)")
def convolution(spark, sf_dir):
    """A layer of one convolution with zero padding, bias and rectifier."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.relu(arrays.convolve(F.col("x"), KERNEL, 0.01))))


@query("dense_layer", f"WITH {X}, l AS (SELECT vec_id, j, list_sum(list_transform(x, lambda v, i: v * ((i * j) % 7 - 3) / 8.0::DOUBLE)) + 0.1::DOUBLE * j AS v FROM x, (SELECT unnest(range(1, 5)) AS j)) SELECT vec_id, (j - 1)::INT AS i, round(1 / (1 + exp(-v)), 6) AS v FROM l")
def dense_layer(spark, sf_dir):
    """A layer of weighted sums with biases and the logistic function."""
    weights = [[((i * j) % 7 - 3) / 8 for i in range(1, 65)] for j in range(1, 5)]
    return _long(_x(spark, sf_dir).withColumn("y", arrays.sigmoid(arrays.dense(F.col("x"), weights, [0.1 * j for j in range(1, 5)]))))


@query("layer_norm", _sql("list_transform(x, lambda v: (v - list_sum(x) / 64) / sqrt(list_sum(list_transform(x, lambda u: u * u)) / 64 - pow(list_sum(x) / 64, 2) + 1e-5) * 2 + 0.5)"))
def layer_norm(spark, sf_dir):
    """Normalisation of a layer with gain and offset; with fixed mean and deviation it is a batch normalisation."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.layer_norm(F.col("x"), 2.0, 0.5)))


@query("attention", f"WITH {X}, q AS (SELECT vec_id, list_transform(range(0, 8), lambda t: x[t * 8 + 1 : t * 8 + 8]) AS tok FROM x), s AS (SELECT vec_id, tok, list_transform(tok, lambda k: exp(list_dot_product(tok[8], k) / sqrt(8.0::DOUBLE))) AS w FROM q) SELECT vec_id, (i - 1)::INT AS i, round(list_sum(list_transform(range(1, 9), lambda t: w[t] * tok[t][i])) / list_sum(w), 6) + 0.0::DOUBLE AS v FROM s, (SELECT unnest(range(1, 9)) AS i)")
def attention(spark, sf_dir):
    """The last of eight tokens attending to all of them: softmax of scaled products, and the weighted mean."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("x", t * 8 + 1, F.lit(8)))
    return _long(_x(spark, sf_dir).withColumn("y", arrays.let(tokens, lambda t: arrays.attend(F.element_at(t, 8), t, t, 8))))


@query("ensemble_probability", f"WITH {X} SELECT vec_id, round((1 / (1 + exp(-list_sum(list_transform(x, lambda v: asinh(v * 4)))))+ 1 / (1 + exp(-list_sum(list_transform(x, lambda v: asinh(v * 2))))) + 1 / (1 + exp(-list_sum(list_transform(x, lambda v: asinh(v)))))) / 3, 6) AS p FROM x")
def ensemble_probability(spark, sf_dir):
    """Mean of three models' probabilities over scaled input."""
    one = lambda k: arrays.sigmoid(F.array(arrays.total(F.transform("x", lambda v: F.asinh(v * k)))))[0]
    return _x(spark, sf_dir).select("vec_id", r6((one(4.0) + one(2.0) + one(1.0)) / 3).alias("p"))


CELL = f"{km_sql(LAT.format(k='s_suppkey'), LON.format(k='s_suppkey'), 'g.la', 'g.lo')}"


@query("network_coverage", f"WITH g AS (SELECT a * 13 + b AS node, 36.0::DOUBLE + a * 0.5::DOUBLE AS la, 26.0::DOUBLE + b::DOUBLE AS lo FROM (SELECT unnest(range(0, 13)) AS a), (SELECT unnest(range(0, 13)) AS b)), d AS (SELECT g.node, s_nationkey % 5 AS subset, {CELL} AS km FROM supplier, g), r AS (SELECT node, subset, km, row_number() OVER (PARTITION BY node, subset ORDER BY km) AS n FROM d) SELECT subset, count(*) AS covered, round(avg(sqrt(km * km + 100) / 6 + 3), 6) AS alert_s, round(max(km), 6) AS worst_km FROM r WHERE n = 2 AND km <= 300 GROUP BY subset")
def network_coverage(spark, sf_dir):
    """How well subsets of stations cover a grid: nodes with two stations in reach and the time of the second.

    The grid has 169 nodes, a broadcast side of fixed size; the two nearest are kept by partial aggregates, not ranked."""
    g = spark.range(169).select(F.col("id").alias("node"), (36.0 + F.floor(F.col("id") / 13) * 0.5).alias("la"), (26.0 + F.col("id") % 13).cast("double").alias("lo"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("subset"))
    d = s.crossJoin(F.broadcast(g)).withColumn("km", geo.distance_km(*place(F.col("s_suppkey")), F.col("la"), F.col("lo"))).where("km <= 300")
    first = d.groupBy("node", "subset").agg(F.min(F.struct("km", "s_suppkey")).alias("a"))
    second = d.join(first, ["node", "subset"]).where(F.struct("km", "s_suppkey") != F.col("a")).groupBy("node", "subset").agg(F.min("km").alias("km"))
    return second.groupBy("subset").agg(F.count("*").alias("covered"), r6(F.avg(geo.travel_time(F.col("km"), 10.0, 6.0) + 3)).alias("alert_s"), r6(F.max("km")).alias("worst_km"))


REACH = 300.0
_FAR = f"""WITH g AS (SELECT a * 13 + b AS node, 36.0::DOUBLE + a * 0.5::DOUBLE AS la, 26.0::DOUBLE + b::DOUBLE AS lo FROM (SELECT unnest(range(0, 13)) AS a), (SELECT unnest(range(0, 13)) AS b)),
v AS (SELECT round_even(({LAT.format(k="c_custkey")} - 36) * 2, 0)::BIGINT * 13 + round_even({LON.format(k="c_custkey")} - 26, 0)::BIGINT AS node, count(*)::DOUBLE AS weight FROM customer GROUP BY 1),
n AS (SELECT g.*, coalesce(weight, 0) AS w FROM g LEFT JOIN v USING (node)),
s AS (SELECT s_nationkey AS subset, s_suppkey AS station, {LAT.format(k="s_suppkey")} AS sa, {LON.format(k="s_suppkey")} AS so FROM supplier),
p AS (SELECT * FROM (SELECT subset, station, node, w, la, {km_sql("sa", "so", "la", "lo")} AS km, (so - lo) * 111.32::DOUBLE * cos(radians(la)) AS dx, (sa - la) * 110.57::DOUBLE AS dy FROM s, n) WHERE km <= {REACH}),
t AS (SELECT *, sqrt(km * km + 100) AS hyp, ((degrees(atan2(dx, dy)) + 360) % 360) AS az FROM p),
"""
GEOMETRY = (
    _FAR
    + """k AS (SELECT subset, count(*) AS k FROM s GROUP BY subset),
z AS (SELECT *, az - lag(az) OVER (PARTITION BY subset, node ORDER BY az, station) AS step FROM t),
m AS (SELECT subset, node, w, count(*) AS n, list_sort(list(hyp / 6))[2] + 2 AS alert, max(step) AS step, min(az) + 360 - max(az) AS shut,
  sum(dx * dx / hyp / hyp) * c1 + 1e-12 - pow(sum(-dx / hyp) * c2, 2) / (count(*) * c3 + 1e-12) AS a, sum(dy * dy / hyp / hyp) * c1 + 1e-12 - pow(sum(-dy / hyp) * c2, 2) / (count(*) * c3 + 1e-12) AS d,
  sum(dx * dy / hyp / hyp) * c1 - sum(-dx / hyp) * c2 * sum(-dy / hyp) * c2 / (count(*) * c3 + 1e-12) AS b
  FROM z, (SELECT 1 / pow(1.8, 2) + 1 / pow(1.75, 2) AS c1, 1 / (6 * pow(0.3, 2)) + 1 / (3.5 * pow(0.5, 2)) AS c2, 1 / pow(0.3, 2) + 1 / pow(0.5, 2) AS c3) GROUP BY subset, node, w, c1, c2, c3 HAVING count(*) >= 2),
e AS (SELECT *, sqrt(5.991 / greatest((a + d - sqrt(pow(a - d, 2) + 4 * b * b)) / 2, 1e-12)) AS err FROM m),
o AS (SELECT *, sum(w) OVER (PARTITION BY subset ORDER BY err, node ROWS UNBOUNDED PRECEDING) AS up, sum(w) OVER (PARTITION BY subset) AS all_w FROM e WHERE w > 0),
l AS (SELECT subset, min(err) AS location_km FROM o WHERE up >= all_w / 2 GROUP BY subset),
r AS (SELECT subset, sum(w) AS w, sum(w * alert) / sum(w) AS alert_s, sum(w * sqrt(greatest(pow(3.5 * alert, 2) - 100, 0))) / sum(w) AS blind_km, sum(w * CASE WHEN n = k THEN greatest(step, shut) ELSE step END) / sum(w) AS gap_deg, sum(w * greatest(step, shut)) / sum(w) AS round_deg FROM e JOIN k USING (subset) GROUP BY subset HAVING sum(w) > 0),
x AS (SELECT s.subset, s.station AS lost, t.node, any_value(t.w) AS w, list_sort(list(t.hyp / 6))[2] + 2 AS alert FROM s JOIN t ON t.subset = s.subset AND t.station <> s.station GROUP BY ALL HAVING count(*) >= 2),
y AS (SELECT s.subset, s.station, coalesce(sum(x.w), 0) AS w, CASE WHEN sum(x.w) > 0 THEN sum(x.w * x.alert) / sum(x.w) END AS alert FROM s LEFT JOIN x ON x.subset = s.subset AND x.lost = s.station GROUP BY ALL),
q AS (SELECT subset, min(w) AS least, max(alert) AS latest FROM y GROUP BY subset)
SELECT subset, k, round(coalesce(r.w, 0) / tot, 6) AS coverage, round(alert_s, 6) AS alert_s, round(blind_km, 6) AS blind_km, round(location_km, 3) AS location_km, round(gap_deg, 6) AS gap_deg, round(round_deg, 6) AS round_deg,
  CASE WHEN k > 2 THEN round(least / tot, 6) ELSE 0 END::DOUBLE AS worst_coverage, CASE WHEN k > 2 THEN round(greatest(latest, alert_s), 6) END AS worst_alert_s
FROM k LEFT JOIN r USING (subset) LEFT JOIN l USING (subset) JOIN q USING (subset), (SELECT sum(w) AS tot FROM n)"""
)


@query("network_geometry", GEOMETRY)
def network_geometry(spark, sf_dir):
    """How well each nation's stations watch a grid that is weighted by what has happened near its nodes."""
    c = table(spark, sf_dir, "customer").select(*(x.alias(n) for x, n in zip(place(F.col("c_custkey")), ("lat", "lon"))))
    v = c.groupBy((F.rint((F.col("lat") - 36) * 2) * 13 + F.rint(F.col("lon") - 26)).cast("long").alias("node")).agg(F.count("*").cast("double").alias("weight"))
    g = spark.range(169).select(F.col("id").alias("node"), (36.0 + F.floor(F.col("id") / 13) * 0.5).alias("lat"), (26.0 + F.col("id") % 13).cast("double").alias("lon"))
    nodes = staged(g.join(v, "node", "left").fillna(0.0), "nodes")
    lat, lon = place(F.col("s_suppkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("subset"), F.col("s_suppkey").alias("station"), lat.alias("lat"), lon.alias("lon"))
    r = coverage.subset_scores(staged(coverage.node_geometry(s, nodes, reach=REACH), "geometry"), s, nodes)
    return r.select("subset", "k", *[F.round(c, 3 if c == "location_km" else 6).alias(c) for c in r.columns[2:]])
