"""Aggregation, statistics, selection, subset and location queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.functions import geo, inference
from tremolo.operators import partners, ranges, regression, settings, stats
from tremolo.plans.joins import CAT, MATCH, PAIRS, _catalogue, _detections, _km, _matched, _placed
from tremolo.plans.registry import DETECTIONS, LAT, LON, detections, km_sql, place, query, r6, table
from tremolo.sources.shared import staged

S, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


@query("scan_counts_by_tag", f"WITH {DETECTIONS} SELECT kind, us // {DAY} AS day, count(*) AS n, min(us) AS first, max(us) AS last FROM e GROUP BY ALL")
def scan_counts_by_tag(spark, sf_dir):
    """Rows by tag and day, with the first and last of each."""
    e = detections(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY).cast("long"))
    return e.groupBy("kind", "day").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))


@query("catalogue_window", "SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' AND o_totalprice IS NOT NULL")
def catalogue_window(spark, sf_dir):
    """Catalogue rows of a time window: the bounds reach the scan."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1996-07-01' and o_totalprice is not null")
    return o.select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))


@query("first_per_key", "SELECT c_nationkey, min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def first_per_key(spark, sf_dir):
    """The first row of each key: a partial aggregate instead of a window."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"), F.min_by("c_name", "c_custkey").alias("c_name"))


@query("parse_text_fields", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS host, len(regexp_extract_all(html, '[0-9]+')) AS numbers FROM pages")
def parse_text_fields(spark, sf_dir):
    """Fields of report text by patterns."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("[0-9]+"), 0)).cast("long").alias("numbers"))


@query("json_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    """Counts by a field of JSON text."""
    e = table(spark, sf_dir, "events").select("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(
    "quantiles",
    """WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(list_aggregate(v, 'quantile_cont', 0.5), 6) AS median, v[1 + CAST(floor(0.9::DOUBLE * (len(v) - 1)) AS BIGINT)] AS p90_floor, v[1 + CAST(round_even(0.99::DOUBLE * (len(v) - 1), 0) AS BIGINT)] AS p99_even,
round(list_aggregate(v, 'quantile_cont', 0.25), 6) AS q1 FROM s""",
)
def quantiles(spark, sf_dir):
    """Median and quartile by interpolation, and percentiles by index, from counts of distinct values."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    places = {"median": (0.5, "between"), "q1": (0.25, "between"), "p90_floor": (0.9, "floor"), "p99_even": (0.99, "even")}
    return stats.places_all(l, "l_extendedprice", places, ["l_returnflag"]).select("l_returnflag", r6(F.col("q1")).alias("q1"), r6(F.col("median")).alias("median"), "p90_floor", "p99_even")


@query(
    "magnitude_bands",
    "SELECT CAST(o_totalprice >= 50000 AS INT) + CAST(o_totalprice >= 100000 AS INT) + CAST(o_totalprice >= 200000 AS INT) + CAST(o_totalprice >= 400000 AS INT) AS band, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hit, count(*) FILTER (o_orderstatus <> 'F') AS missed FROM orders GROUP BY band",
)
def magnitude_bands(spark, sf_dir):
    """Hits and misses by half-open size band; empty bands are left out."""
    o = table(spark, sf_dir, "orders").withColumn("band", stats.bands(F.col("o_totalprice"), [50_000.0, 100_000.0, 200_000.0, 400_000.0]))
    return o.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("hit"), F.count_if(F.expr("o_orderstatus <> 'F'")).alias("missed"))


@query(
    "distance_bands",
    f"WITH k AS (SELECT {km_sql(LAT.format(k='c_custkey'), LON.format(k='c_custkey'), '38.0::DOUBLE', '30.0::DOUBLE')} AS km, c_acctbal FROM customer) SELECT CAST(km >= 100 AS INT) + CAST(km >= 200 AS INT) + CAST(km >= 400 AS INT) AS band, count(*) AS n, round(avg(abs(c_acctbal)), 6) AS mean_abs, round(avg(c_acctbal), 6) AS bias FROM k GROUP BY band",
)
def distance_bands(spark, sf_dir):
    """Counts, mean absolute value and bias by distance band."""
    km = geo.distance_km(*place(F.col("c_custkey")), F.lit(38.0), F.lit(30.0))
    c = table(spark, sf_dir, "customer").select(stats.bands(km, [100.0, 200.0, 400.0]).alias("band"), "c_acctbal")
    return c.groupBy("band").agg(F.count("*").alias("n"), r6(F.avg(F.abs("c_acctbal"))).alias("mean_abs"), r6(F.avg("c_acctbal")).alias("bias"))


@query(
    "chance_corrected",
    f"""WITH {CAT}, s AS (SELECT unnest(range(0, 5)) AS shift), h AS (SELECT s.shift, c.cat_id, EXISTS (SELECT 1 FROM det d WHERE abs(d.us - c.cat_us - s.shift * {HOUR}) <= 300000000) AS hit FROM cat c, s),
r AS (SELECT shift, avg(hit::INT) AS rate, count(*) AS n FROM h GROUP BY shift), o AS (SELECT max(rate) FILTER (shift = 0) AS o, avg(rate) FILTER (shift > 0) AS c, max(n) AS n FROM r)
SELECT n, round(o, 6) AS observed, round(c, 6) AS chance, round(CASE WHEN c >= 1 THEN 0 ELSE (o - c) / (1 - c) * n END, 6) AS corrected FROM o""",
)
def chance_corrected(spark, sf_dir):
    """Detected share of the catalogue, the mean share under time shifts, and what is left of it beyond chance."""
    c = _catalogue(spark, sf_dir).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("at", F.col("cat_us") + F.col("shift") * HOUR)
    hits = ranges.tolerance_join(c.select("cat_id", "shift", "at"), _detections(spark, sf_dir).select("us"), "at", "us", 300 * S, how="left_semi").groupBy("shift").agg(F.count("*").alias("hits"))
    rate = c.groupBy("shift").agg(F.count("*").alias("n")).join(hits, "shift", "left").withColumn("rate", F.coalesce("hits", F.lit(0)) / F.col("n"))
    o = rate.agg(F.max(F.when(F.col("shift") == 0, F.col("rate"))).alias("o"), F.avg(F.when(F.col("shift") > 0, F.col("rate"))).alias("c"), F.max("n").alias("n"))
    corrected = F.when(F.col("c") >= 1, F.lit(0.0)).otherwise((F.col("o") - F.col("c")) / (1 - F.col("c")) * F.col("n"))
    return o.select("n", r6(F.col("o")).alias("observed"), r6(F.col("c")).alias("chance"), r6(corrected).alias("corrected"))


@query("rate_rollup", f"WITH {DETECTIONS} SELECT station % 10 AS grp, kind, count(*) AS n, round(24 * count(*) / 720.0::DOUBLE, 6) AS per_day, grouping(kind) AS all_kinds FROM e GROUP BY ROLLUP (grp, kind)")
def rate_rollup(spark, sf_dir):
    """Rates per day by group and kind, with totals of groups and of all."""
    e = detections(spark, sf_dir).select((F.col("station") % 10).alias("grp"), "kind")
    return e.rollup("grp", "kind").agg(F.count("*").alias("n"), r6(24 * F.count("*") / F.lit(720.0)).alias("per_day"), F.grouping("kind").cast("long").alias("all_kinds"))


@query(
    "mannwhitney_auc",
    """WITH x AS (SELECT quality, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)
SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc, count(*) AS n FROM x""",
)
def mannwhitney_auc(spark, sf_dir):
    """Area under the curve by rank sums, ties half: ranks come from counts of the distinct values."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").where("quality is not null and n_chars is not null")
    pos = d.groupBy("n_chars").agg(F.count_if(F.expr("quality = 1")).alias("p"))
    r = stats.mean_ranks(d, "n_chars").join(pos, "n_chars").agg(F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return r.select(r6((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"), "n")


@query(
    "budget_threshold",
    f"WITH {DETECTIONS}, t AS (SELECT quantile_cont(value, 1 - 150 / 5000.0::DOUBLE) AS t FROM e WHERE kind <> 'purchase') SELECT round(t.t, 6) AS threshold, count(*) FILTER (e.value > t.t) AS above, count(*) AS n FROM e, t WHERE e.kind = 'purchase' GROUP BY t.t",
)
def budget_threshold(spark, sf_dir):
    """The background's quantile that a budget of false alarms allows, and the events above it: one broadcast row."""
    e = detections(spark, sf_dir)
    t = stats.interpolated(e.where("kind <> 'purchase'"), "value", 1 - 150 / 5000.0).withColumnRenamed("quantile", "t")
    return e.where("kind = 'purchase'").join(F.broadcast(t)).groupBy("t").agg(F.count_if(F.col("value") > F.col("t")).alias("above"), F.count("*").alias("n")).select(r6(F.col("t")).alias("threshold"), "above", "n")


@query("b_value", "SELECT o_orderstatus, count(*) AS n, round(0.4342944819032518::DOUBLE / (avg(o_totalprice / 100000.0::DOUBLE) - (1.0::DOUBLE - 0.05)), 6) AS b FROM orders WHERE o_totalprice >= 100000 GROUP BY o_orderstatus")
def b_value(spark, sf_dir):
    """Maximum-likelihood slope of sizes above a completeness size."""
    o = table(spark, sf_dir, "orders").where("o_totalprice >= 100000")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r6(F.lit(0.4342944819032518) / (F.avg(F.col("o_totalprice") / 100_000.0) - (F.lit(1.0) - 0.05))).alias("b"))


@query(
    "change_point",
    f"""WITH {DETECTIONS}, h AS (SELECT us // {HOUR} AS hour, count(*) AS n FROM e GROUP BY hour), g AS (SELECT unnest(range((SELECT min(hour) FROM h), (SELECT max(hour) + 1 FROM h))) AS hour),
c AS (SELECT g.hour, coalesce(h.n, 0) AS n, row_number() OVER (ORDER BY g.hour) AS k, sum(coalesce(h.n, 0)) OVER (ORDER BY g.hour) AS s, count(*) OVER () AS t, sum(coalesce(h.n, 0)) OVER () AS a FROM g LEFT JOIN h USING (hour)),
l AS (SELECT hour, round(CASE WHEN s > 0 THEN s * ln(s::DOUBLE / k) ELSE 0 END + CASE WHEN a > s THEN (a - s) * ln((a - s)::DOUBLE / (t - k)) ELSE 0 END, 6) AS ll FROM c WHERE k < t)
SELECT arg_max(hour, (ll, -hour)) AS hour, max(ll) AS ll FROM l""",
)
def change_point(spark, sf_dir):
    """The hour at which two rates explain hourly counts best. The window sees one row an hour, not the events."""
    h = detections(spark, sf_dir).groupBy(F.floor(F.col("us") / HOUR).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    g = h.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.sequence("a", "b")).alias("hour"))
    all_hours, order = W.partitionBy(), W.partitionBy().orderBy("hour")
    c = g.join(h, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = c.select("hour", F.row_number().over(order).alias("k"), F.sum("n").over(order).alias("s"), F.count("*").over(all_hours).alias("t"), F.sum("n").over(all_hours).alias("a")).where("k < t")
    part = lambda s, k: F.when(s > 0, s * F.log(s / k)).otherwise(0.0)
    ll = r6(part(F.col("s"), F.col("k")) + part(F.col("a") - F.col("s"), F.col("t") - F.col("k")))
    return c.withColumn("ll", ll).agg(F.max_by("hour", F.struct(F.col("ll"), -F.col("hour"))).alias("hour"), F.max("ll").alias("ll"))


SPAN = 30 * DAY


@query(
    "time_slide_null",
    f"""WITH {DETECTIONS}, b AS (SELECT min(us) AS lo FROM e), x AS (SELECT s.slide, e.event_id, e.station, ((e.us - b.lo) + (e.station + 1) * s.slide * 600000000) % {SPAN} AS at FROM e, b, (SELECT unnest(range(0, 6)) AS slide) s WHERE e.kind = 'purchase'),
p AS (SELECT a.slide, count(*) AS n FROM x a JOIN x c ON a.slide = c.slide AND a.station < c.station AND abs(a.at - c.at) <= 60000000 GROUP BY a.slide), r AS (SELECT s.slide, coalesce(p.n, 0) AS n FROM (SELECT unnest(range(0, 6)) AS slide) s LEFT JOIN p USING (slide))
SELECT max(n) FILTER (slide = 0) AS observed, round(avg(n) FILTER (slide > 0), 6) AS null_mean, round((1 + count(*) FILTER (slide > 0 AND n >= (SELECT n FROM r WHERE slide = 0))) / 6.0::DOUBLE, 6) AS p FROM r""",
)
def time_slide_null(spark, sf_dir):
    """Coincidences of stations as observed and with every station shifted around the span: mean of the null and p."""
    e = detections(spark, sf_dir)
    low = e.agg(F.min("us").alias("lo"))
    slides = spark.range(6).select(F.col("id").alias("slide"))
    x = e.where("kind = 'purchase'").join(F.broadcast(low)).withColumn("slide", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    x = x.select("slide", "event_id", "station", (((F.col("us") - F.col("lo")) + (F.col("station") + 1) * F.col("slide") * 600 * S) % SPAN).alias("at"))
    a, b = x.select("slide", F.col("station").alias("sa"), F.col("at").alias("aa")), x.select("slide", F.col("station").alias("sb"), F.col("at").alias("ab"))
    n = ranges.tolerance_join(a, b, "aa", "ab", 60 * S, ["slide"]).where("sa < sb").groupBy("slide").agg(F.count("*").alias("n"))
    r = slides.join(n, "slide", "left").select("slide", F.coalesce("n", F.lit(0)).alias("n"))
    o = r.where("slide = 0").select(F.col("n").alias("observed"))
    g = r.where("slide > 0").join(F.broadcast(o)).groupBy("observed").agg(r6(F.avg("n")).alias("null_mean"), F.count_if(F.col("n") >= F.col("observed")).alias("k"))
    return g.select("observed", "null_mean", r6((F.col("k") + 1) / F.lit(6.0)).alias("p"))


@query(
    "spearman",
    "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r",
)
def spearman(spark, sf_dir):
    """Rank correlation: the ranks of the distinct values are joined back, so no row meets a global sort."""
    l = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount")
    a = stats.mean_ranks(l, "l_quantity").select("l_quantity", F.col("rank").alias("a"))
    b = stats.mean_ranks(l, "l_discount").select("l_discount", F.col("rank").alias("b"))
    return l.join(a, "l_quantity").join(b, "l_discount").agg(r6(F.corr("a", "b")).alias("rho"))


@query(
    "weighted_median",
    """WITH g AS (SELECT l_returnflag, l_linestatus, l_discount, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_discount) AS r, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS t FROM g)
SELECT l_returnflag, l_linestatus, min(l_discount) AS weighted_median, round(any_value(m.mean), 6) AS weighted_mean FROM c JOIN (SELECT l_returnflag AS f, l_linestatus AS s, sum(l_discount * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY ALL) m ON f = l_returnflag AND s = l_linestatus WHERE 2 * r >= t GROUP BY l_returnflag, l_linestatus""",
)
def weighted_median(spark, sf_dir):
    """Weighted mean and median of each group."""
    l, on = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    mean = l.groupBy(*on).agg(r6(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("weighted_mean"))
    return stats.weighted_median(l, "l_discount", F.col("l_quantity"), on).join(mean, on)


@query(
    "chance_probability",
    f"""WITH {CAT}, {PAIRS}, m AS (SELECT a_id, a_station AS station, a_us AS us, a_id AS id FROM q UNION SELECT a_id, b_station, b_us, b_id FROM q),
f AS (SELECT a_id, arg_min(station, (us, id)) AS station FROM m GROUP BY a_id HAVING count(DISTINCT station) >= 3),
n AS (SELECT station, count(*) AS n FROM det GROUP BY station),
s AS (SELECT DISTINCT m.a_id, m.station, f.station AS first, n.n, 2 * ({_km("f", "m")} / 6 + 3) AS w FROM m JOIN f ON m.a_id = f.a_id AND m.station <> f.station JOIN n ON n.station = m.station)
SELECT a_id, count(*) AS others, round(sum(ln(1 - exp(-n / 2592000.0::DOUBLE * w))), 6) AS ln_p FROM s GROUP BY a_id""",
)
def chance_probability(spark, sf_dir):
    """Of every alarm of ``declare_events``, the logarithm of the probability that its other stations fired by chance
    within their association window around its first detection, each at its own rate over all detections."""
    n = _detections(spark, sf_dir).groupBy("station").agg(F.count("*").alias("n"))
    return partners.by_chance(_placed(spark, sf_dir).join(n, "station"), 2592000.0).select("a_id", "others", r6(F.col("ln_p")).alias("ln_p"))


SWEEP = "SELECT l_suppkey % 97 AS setting, l_returnflag AS source, count(*) FILTER (l_discount >= 0.05) AS detected, count(*) FILTER (l_tax >= 0.06) AS unmatched FROM lineitem GROUP BY ALL"


def _sweep(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy((F.col("l_suppkey") % 97).alias("setting"), F.col("l_returnflag").alias("source")).agg(F.count_if(F.expr("l_discount >= 0.05")).alias("detected"), F.count_if(F.expr("l_tax >= 0.06")).alias("unmatched"))


@query(
    "selection_rules",
    f"WITH s AS ({SWEEP}), m AS (SELECT source, quantile_disc(unmatched, 0.5) AS most FROM s GROUP BY source) SELECT source, arg_max(setting, (detected, -unmatched, -setting)) AS setting, max(detected) AS detected FROM s JOIN m USING (source) WHERE unmatched <= most GROUP BY source",
)
def selection_rules(spark, sf_dir):
    """The setting of most detections among those of no more unmatched alarms than the middle one, ties by fewer alarms and setting."""
    s = _sweep(spark, sf_dir)
    m = s.groupBy("source").agg(F.expr("percentile_disc(0.5) within group (order by unmatched)").cast("long").alias("most"))
    best = F.max_by("setting", F.struct(F.col("detected"), -F.col("unmatched"), -F.col("setting")))
    return s.join(m, "source").where("unmatched <= most").groupBy("source").agg(best.alias("setting"), F.max("detected").alias("detected"))


@query(
    "matched_pick",
    f"WITH s AS ({SWEEP}), x AS (SELECT *, round(abs(ln(greatest(unmatched, 1) / 100.0::DOUBLE)), 9) AS off FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, setting) AS k FROM x) SELECT source, setting, unmatched, k FROM r WHERE k <= 3",
)
def matched_pick(spark, sf_dir):
    """The three settings of each source whose rate is nearest a reference by ratio."""
    x = _sweep(spark, sf_dir).withColumn("off", F.round(F.abs(F.log(F.greatest("unmatched", F.lit(1)) / 100.0)), 9))
    return x.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("off", "setting"))).where("k <= 3").select("source", "setting", "unmatched", "k")


#: Settings of three detectors on seven networks, with their alarms and those on quiet windows.
COUNTS = "SELECT l_linenumber::VARCHAR AS net, l_returnflag AS detector, l_suppkey % 97 AS place, l_suppkey % 89 / 8.0::DOUBLE AS level, count(*) FILTER (l_discount >= 0.05) - 0.25::DOUBLE * count(*) FILTER (l_discount = 0) AS corrected, count(*) FILTER (l_tax >= 0.06) AS unmatched, count(*) FILTER (l_tax = 0.08 AND l_quantity > 25) AS quiet FROM lineitem GROUP BY ALL"


def _counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    corrected = F.count_if(F.expr("l_discount >= 0.05")) - 0.25 * F.count_if(F.expr("l_discount = 0"))
    keys = [F.col("l_linenumber").cast("string").alias("net"), F.col("l_returnflag").alias("detector"), (F.col("l_suppkey") % 97).alias("place"), (F.col("l_suppkey") % 89 / 8.0).alias("level")]
    return l.groupBy(*keys).agg(corrected.alias("corrected"), F.count_if(F.expr("l_tax >= 0.06")).alias("unmatched"), F.count_if(F.expr("l_tax = 0.08 and l_quantity > 25")).alias("quiet"))


CHOICES = f"""WITH c AS ({COUNTS}), s AS (SELECT net || detector AS source, place::VARCHAR || ' ' || level::VARCHAR AS setting, level, corrected, unmatched, CASE WHEN detector <> 'A' THEN quiet END AS quiet FROM c), b AS (SELECT quantile_disc(unmatched, 0.3) AS u, quantile_disc(corrected, 0.7) AS k FROM s),
a AS (SELECT *, unmatched <= u AS few, corrected >= k AS good, quiet <= 1 AS still FROM s, b),
r AS (SELECT 'equal_unmatched' AS rule, row_number() OVER (ORDER BY corrected DESC, unmatched, level DESC, source, setting) AS n, * FROM a WHERE few UNION ALL SELECT 'equal_detections', row_number() OVER (ORDER BY unmatched, corrected DESC, source, setting), * FROM a WHERE good
  UNION ALL SELECT 'equal_quiet', row_number() OVER (ORDER BY corrected DESC, quiet, unmatched, source, setting), * FROM a WHERE still UNION ALL SELECT 'best_of_source', row_number() OVER (PARTITION BY source ORDER BY corrected DESC, unmatched, setting), * FROM a WHERE few),
o AS (SELECT * FROM (SELECT unnest(['equal_unmatched', 'equal_detections', 'equal_quiet']) AS rule) LEFT JOIN (SELECT * FROM r WHERE rule <> 'best_of_source' AND n = 1) USING (rule)),
p AS (SELECT 'best_of_source' AS rule, d.source, r.* EXCLUDE (rule, source) FROM (SELECT DISTINCT source FROM s) d LEFT JOIN (SELECT * FROM r WHERE rule = 'best_of_source' AND n = 1) r USING (source))
SELECT rule, source, setting, level, corrected, unmatched, quiet FROM o UNION ALL SELECT rule, source, setting, level, corrected, unmatched, quiet FROM p"""


@query("setting_choices", CHOICES)
def setting_choices(spark, sf_dir):
    """The settings chosen under equal alarms, equal detections and equal quiet alarms, and the best of every source."""
    c = staged(_counts(spark, sf_dir), "settings")
    s = c.select(F.concat("net", "detector").alias("source"), F.concat(F.col("place").cast("string"), F.lit(" "), F.col("level").cast("string")).alias("setting"), "level", "corrected", "unmatched", F.when(F.col("detector") != "A", F.col("quiet")).alias("quiet"))
    b = s.agg(F.expr("percentile_disc(0.3) within group (order by unmatched)").alias("u"), F.expr("percentile_disc(0.7) within group (order by corrected)").alias("k")).first()
    return settings.choices(s, b.u, b.k, 1)


def _ratio_sql(column: str, rule: str) -> str:
    """The closest of every family's settings for each of the first detector's, by looking at all of them."""
    return f"""SELECT net, learned, family, '{rule}' AS rule, setting, count, CASE WHEN zero THEN 'zero count' WHEN wanted / count BETWEEN 0.8 AND 1.25 THEN 'matched' ELSE printf('not matched (ratio %.2f)', round_even(wanted * 100 / count, 0) / 100) END AS flag, ties > 1 AS tie FROM (
SELECT *, row_number() OVER (PARTITION BY net, learned, family ORDER BY off, place, setting) AS k, count(*) OVER (PARTITION BY net, learned, family, off) AS ties FROM (
SELECT m.net, m.learned, o.family, o.place, o.setting, m.{column} AS wanted, o.{column} AS count, m.{column} = 0 OR o.most = 0 AS zero, CASE WHEN m.{column} = 0 OR o.most = 0 THEN abs(m.{column} - o.{column}) WHEN o.{column} > 0 THEN round(abs(ln(m.{column} / o.{column})), 11) END AS off
FROM m JOIN (SELECT *, max({column}) OVER (PARTITION BY net, family) AS most FROM o) o USING (net)) WHERE off IS NOT NULL) WHERE k = 1"""


MATCHED = f"""WITH c AS ({COUNTS}), d AS (SELECT *, place * 1000 + (level * 8)::BIGINT AS spot FROM c), m AS (SELECT net, spot AS learned, unmatched, quiet FROM d WHERE detector = 'R'), o AS (SELECT net, detector AS family, spot AS place, spot AS setting, unmatched, quiet FROM d WHERE detector <> 'R'),
b AS (SELECT m.net, m.learned, o.family, max(o.unmatched) FILTER (o.unmatched < m.unmatched) AS low, min(o.unmatched) FILTER (o.unmatched > m.unmatched) AS high FROM m JOIN o USING (net) GROUP BY ALL),
t AS (SELECT b.*, o.setting, o.unmatched FROM b JOIN o ON o.net = b.net AND o.family = b.family AND o.unmatched IN (low, high) WHERE low IS NOT NULL AND high IS NOT NULL)
{_ratio_sql("unmatched", "matched_unmatched")} UNION ALL {_ratio_sql("quiet", "matched_quiet")}
UNION ALL SELECT net, learned, family, 'bracket_below', min(setting), low, 'bracket', count(*) > 1 FROM t WHERE unmatched = low GROUP BY net, learned, family, low
UNION ALL SELECT net, learned, family, 'bracket_above', max(setting), high, 'bracket', count(*) > 1 FROM t WHERE unmatched = high GROUP BY net, learned, family, high"""


@query("matched_settings", MATCHED)
def matched_settings(spark, sf_dir):
    """For every setting of one detector the settings of the others with as many alarms by ratio, on all and on quiet
    windows, and those next below and above."""
    c = staged(_counts(spark, sf_dir).withColumn("at", F.col("place") * 1000 + (F.col("level") * 8).cast("long")), "settings")
    m = c.where("detector = 'R'").select("net", F.col("at").alias("learned"), "unmatched", "quiet")
    o = c.where("detector <> 'R'").select("net", F.col("detector").alias("family"), F.col("at").alias("place"), F.col("at").alias("setting"), "unmatched", "quiet")
    return settings.matched(m, o, ["net"], "unmatched", "matched_unmatched", bracket=True).unionByName(settings.matched(m, o, ["net"], "quiet", "matched_quiet"))


GAIN = "f AS (SELECT m.mask, bit_count(m.mask) AS size, count(DISTINCT c.c_nationkey) AS found FROM (SELECT unnest(range(1, 32)) AS mask) m JOIN customer c ON (m.mask >> (c.c_nationkey % 5)::BIGINT) & 1 = 1 AND c.c_acctbal > 0 GROUP BY ALL)"


def _subsets(spark, sf_dir):
    """Each non-empty subset of five stations with what it finds; rows are first reduced to distinct (bit, found)."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select((F.col("c_nationkey") % 5).cast("int").alias("bit"), "c_nationkey").distinct()
    c = c.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(31).cast("long")))).where(F.expr("shiftright(mask, bit) & 1 = 1"))
    return c.groupBy("mask").agg(F.count_distinct("c_nationkey").alias("found")).withColumn("size", F.bit_count("mask"))


@query("subset_powerset", f"WITH {GAIN} SELECT size, arg_max(mask, (found, -mask)) AS best, max(found) AS found, count(*) AS subsets FROM f GROUP BY size")
def subset_powerset(spark, sf_dir):
    """The best subset of each size."""
    f = _subsets(spark, sf_dir)
    return f.groupBy("size").agg(F.max_by("mask", F.struct(F.col("found"), -F.col("mask"))).alias("best"), F.max("found").alias("found"), F.count("*").alias("subsets"))


@query("subset_top_three", f"WITH {GAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY found DESC, mask) AS place FROM f) SELECT size::BIGINT AS size, place, mask, found FROM r WHERE place <= 3")
def subset_top_three(spark, sf_dir):
    """The three best subsets of each size."""
    place = F.row_number().over(W.partitionBy("size").orderBy(F.desc("found"), "mask"))
    return _subsets(spark, sf_dir).withColumn("place", place).where("place <= 3").select(F.col("size").cast("long").alias("size"), "place", "mask", "found")


@query(
    "marginal_gain",
    f"WITH {GAIN}, b AS (SELECT unnest(range(0, 5)) AS bit), w AS (SELECT b.bit, f.found - coalesce(g.found, 0) AS gain FROM b JOIN f ON (f.mask >> b.bit) & 1 = 1 LEFT JOIN f g ON g.mask = f.mask - (1::BIGINT << b.bit)) SELECT bit, count(*) AS n, round(avg(gain), 6) AS gain FROM w GROUP BY bit",
)
def marginal_gain(spark, sf_dir):
    """What a station adds, on average over the subsets without it."""
    f = _subsets(spark, sf_dir)
    w = f.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(F.expr("shiftright(mask, bit) & 1 = 1")).withColumn("other", F.expr("mask - shiftleft(1L, bit)"))
    w = w.join(f.select(F.col("mask").alias("other"), F.col("found").alias("less")), "other", "left")
    return w.groupBy(F.col("bit").cast("long").alias("bit")).agg(F.count("*").alias("n"), r6(F.avg(F.col("found") - F.coalesce("less", F.lit(0)))).alias("gain"))


@query("option_grid", "SELECT a.on_level, b.off_level, c.hold, row_number() OVER (ORDER BY on_level, off_level, hold) AS setting FROM (SELECT unnest([200, 300, 400]) AS on_level) a, (SELECT unnest([50, 100, 250]) AS off_level) b, (SELECT unnest([1, 2, 3]) AS hold) c WHERE off_level < on_level")
def option_grid(spark, sf_dir):
    """All settings of a parameter grid, numbered."""
    g = spark.range(1).select(F.explode(F.array(*map(F.lit, (200, 300, 400)))).alias("on_level"))
    g = g.withColumn("off_level", F.explode(F.array(*map(F.lit, (50, 100, 250))))).withColumn("hold", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("off_level < on_level")
    return g.withColumn("setting", F.row_number().over(W.partitionBy().orderBy("on_level", "off_level", "hold")).cast("long"))


@query(
    "mcnemar_counts",
    f"WITH {CAT}, x AS (SELECT c.cat_id, EXISTS (SELECT 1 FROM det d WHERE d.kind = 'view' AND abs(d.us - c.cat_us) <= 600000000) AS a, EXISTS (SELECT 1 FROM det d WHERE d.kind = 'click' AND abs(d.us - c.cat_us) <= 600000000) AS b FROM cat c) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM x",
)
def mcnemar_counts(spark, sf_dir):
    """Catalogue rows by which of two detectors found them."""
    c, d = _catalogue(spark, sf_dir).select("cat_id", "cat_us"), _detections(spark, sf_dir)
    found = lambda kind, name: ranges.tolerance_join(c, d.where(F.col("kind") == kind).select("us"), "cat_us", "us", 600 * S, how="left_semi").select("cat_id", F.lit(True).alias(name))
    x = c.join(found("view", "a"), "cat_id", "left").join(found("click", "b"), "cat_id", "left").select(F.col("a").isNotNull().alias("a"), F.col("b").isNotNull().alias("b"))
    return x.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("b and not a")).alias("only_b"), F.count_if(F.expr("not a and not b")).alias("neither"))


@query("paired_test")
def paired_test(spark, sf_dir):
    """Exact p of the discordant pairs and the exact interval of the first detector's share, from one row of counts."""
    r = mcnemar_counts(spark, sf_dir).first()
    total = r.both + r.only_a + r.only_b + r.neither
    low, high = inference.clopper_pearson(r.both + r.only_a, total) if total else (0.0, 1.0)
    row = (r.only_a, r.only_b, round(inference.mcnemar(r.only_a, r.only_b), 6), round(low, 6), round(high, 6))
    return spark.createDataFrame([row], "only_a bigint, only_b bigint, p double, low double, high double")


@query(
    "paired_latency",
    f"WITH {CAT}, {MATCH}, x AS (SELECT cat_id, min(d.us) FILTER (d.kind = 'view') AS a, min(d.us) FILTER (d.kind = 'click') AS b FROM m JOIN det d USING (event_id) WHERE m.n = 1 GROUP BY cat_id) SELECT count(*) AS n, round(quantile_cont((a - b) / 1000000.0::DOUBLE, 0.5), 6) AS median, round(quantile_cont((a - b) / 1000000.0::DOUBLE, 0.25), 6) AS q1, count(*) FILTER (a < b) AS first_a, count(*) FILTER (a > b) AS first_b FROM x WHERE a IS NOT NULL AND b IS NOT NULL",
)
def paired_latency(spark, sf_dir):
    """Differences of two detectors' first times over the catalogue rows that both found."""
    m = _matched(spark, sf_dir).select("event_id", "cat_id").join(_detections(spark, sf_dir).select("event_id", "us", "kind"), "event_id")
    x = m.groupBy("cat_id").agg(F.min(F.when(F.col("kind") == "view", F.col("us"))).alias("a"), F.min(F.when(F.col("kind") == "click", F.col("us"))).alias("b")).where("a is not null and b is not null")
    x = x.withColumn("d", (F.col("a") - F.col("b")) / 1_000_000.0)
    n = x.agg(F.count("*").alias("n"), F.count_if(F.expr("a < b")).alias("first_a"), F.count_if(F.expr("a > b")).alias("first_b"))
    q = stats.interpolated_all(x, "d", {"median": 0.5, "q1": 0.25})
    return n.join(F.broadcast(q)).select("n", r6(F.col("median")).alias("median"), r6(F.col("q1")).alias("q1"), "first_a", "first_b")  # one row each


@query(
    "grid_locate",
    f"""WITH st AS (SELECT s_nationkey AS ev, {LAT.format(k='s_suppkey')} AS la, {LON.format(k='s_suppkey')} AS lo, {km_sql(LAT.format(k='s_suppkey'), LON.format(k='s_suppkey'), LAT.format(k='s_nationkey'), LON.format(k='s_nationkey'))} / 6 + (s_suppkey % 5) / 10.0::DOUBLE AS t FROM supplier),
g AS (SELECT a AS i, b AS j, 36.0::DOUBLE + a * 0.5 AS gla, 26.0::DOUBLE + b AS glo FROM (SELECT unnest(range(0, 13)) AS a), (SELECT unnest(range(0, 13)) AS b)),
r AS (SELECT ev, i, j, count(*) AS n, var_pop(t - {km_sql('la', 'lo', 'gla', 'glo')} / 6) AS v FROM st, g GROUP BY ALL), q AS (SELECT ev, i, j, n, round(sqrt(v), 5) AS rms FROM r WHERE n >= 2)
SELECT ev, n, arg_min(i, (rms, i, j)) AS i, arg_min(j, (rms, i, j)) AS j, min(rms) AS rms FROM q GROUP BY ev, n""",
)
def grid_locate(spark, sf_dir):
    """The grid node whose predicted times leave the least residual spread, and that spread; earlier node on ties.

    Every pick is repeated for the fixed number of nodes, and the spread is a partial aggregate.
    """
    k, ev = F.col("s_suppkey"), F.col("s_nationkey")
    (la, lo), (ela, elo) = place(k), place(ev)
    st = table(spark, sf_dir, "supplier").select(ev.alias("ev"), la.alias("la"), lo.alias("lo"), (geo.distance_km(la, lo, ela, elo) / 6 + (k % 5) / 10.0).alias("t"))
    g = st.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(12))))
    miss = F.col("t") - geo.distance_km(F.col("la"), F.col("lo"), 36.0 + F.col("i") * 0.5, 26.0 + F.col("j").cast("double")) / 6
    r = g.groupBy("ev", "i", "j").agg(F.count("*").alias("n"), F.var_pop(miss).alias("v")).where("n >= 2").withColumn("rms", F.round(F.sqrt("v"), 5))
    best = F.struct("rms", "i", "j")
    return r.groupBy("ev", "n").agg(F.min(best).alias("b")).select("ev", "n", F.col("b.i").cast("long").alias("i"), F.col("b.j").cast("long").alias("j"), "b.rms")


@query(
    "two_source_test",
    f"""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nk, {LAT.format(k='s_suppkey')} AS la, {LON.format(k='s_suppkey')} AS lo, abs(s_acctbal) / 20 AS d FROM supplier), p AS (SELECT a.k AS a_key, b.k AS b_key, a.d AS da, b.d AS db, {km_sql('a.la', 'a.lo', 'b.la', 'b.lo')} AS km FROM s a JOIN s b ON a.nk = b.nk AND a.k < b.k)
SELECT a_key, b_key, CASE WHEN da > 400 OR db > 400 THEN 'unclassified' WHEN km > da + db + 5 THEN 'apart' WHEN km < abs(da - db) - 5 THEN 'inside' ELSE 'one source' END AS verdict FROM p""",
)
def two_source_test(spark, sf_dir):
    """Whether two distances can meet in one source, for the pairs of a group of stations."""
    k = F.col("s_suppkey")
    la, lo = place(k)
    s = table(spark, sf_dir, "supplier").select("s_nationkey", k.alias("k"), la.alias("la"), lo.alias("lo"), (F.abs("s_acctbal") / 20).alias("d"))
    b = s.select("s_nationkey", *[F.col(c).alias(f"b_{c}") for c in ("k", "la", "lo", "d")])
    km = geo.distance_km(F.col("la"), F.col("lo"), F.col("b_la"), F.col("b_lo"))
    p = s.join(b, "s_nationkey").where("k < b_k").withColumn("km", km)
    verdict = F.when(F.expr("d > 400 or b_d > 400"), "unclassified").when(F.expr("km > d + b_d + 5"), "apart").when(F.expr("km < abs(d - b_d) - 5"), "inside").otherwise("one source")
    return p.select(F.col("k").alias("a_key"), F.col("b_k").alias("b_key"), verdict.alias("verdict"))


@query(
    "station_terms",
    """WITH d AS (SELECT l_suppkey AS station, log10(l_extendedprice::DOUBLE) AS y, l_quantity::DOUBLE AS x1, greatest(l_quantity::DOUBLE - 25, 0) AS x2, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS w FROM lineitem),
m AS (SELECT station, count(*) AS n, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * y) / sum(w) AS my FROM d GROUP BY station),
c AS (SELECT sum(w * (x1 - m1) * (x1 - m1)) AS a11, sum(w * (x1 - m1) * (x2 - m2)) AS a12, sum(w * (x2 - m2) * (x2 - m2)) AS a22, sum(w * (x1 - m1) * (y - my)) AS b1, sum(w * (x2 - m2) * (y - my)) AS b2 FROM d JOIN m USING (station)),
k AS (SELECT (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS c1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS c2 FROM c),
t AS (SELECT station, n, my - c1 * m1 - c2 * m2 AS level, c1, c2 FROM m, k)
SELECT station, n, round(level - avg(level) OVER (), 6) AS term, round(avg(level) OVER (), 6) AS constant, round(c1, 6) AS slope, round(c2, 6) AS bend FROM t""",
)
def station_terms(spark, sf_dir):
    """Price against quantity with a bend, lines weighted so that every order counts once, and a term per supplier."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("double").alias("slope"))
    d = l.withColumn("y", F.log10(F.col("l_extendedprice").cast("double"))).withColumn("bend", F.greatest(F.col("slope") - 25, F.lit(0.0)))
    d = d.withColumn("w", 1.0 / F.count("*").over(W.partitionBy("l_orderkey")))
    fit, terms = regression.station_fit(d, "l_suppkey", "y", ["slope", "bend"], "w")
    return terms.select(F.col("l_suppkey").alias("station"), "n", r6(F.col("term")).alias("term"), *[F.lit(round(fit[c], 6)).alias(c) for c in ("constant", "slope", "bend")])
