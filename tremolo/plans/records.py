"""Queries of the record source and of the sinks. The driver's tables have no record files, so records are made from events first."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.functions import clock
from tremolo.plans.registry import DETECTIONS, detections, query, table
from tremolo.sources import records, sinks
from tremolo.sources.shared import shared_folder

CHUNK = 100
SERIES = f"{DETECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY us, event_id) - 1 AS i FROM e), x AS (SELECT station, i // {CHUNK} AS chunk, i % {CHUNK} AS seq, us, CAST(floor(value * 100) AS BIGINT) % 30000 - 10000 AS sample FROM n)"


def _records(spark, sf_dir, encodings):
    """Every hundred rows of a station as one record: each group has a hundred rows at most."""
    e = detections(spark, sf_dir)
    n = e.withColumn("i", F.row_number().over(W.partitionBy("station").orderBy("us", "event_id")) - 1)
    x = n.select("station", F.floor(F.col("i") / CHUNK).cast("int").alias("chunk"), F.struct("i", (F.floor(F.col("value") * 100).cast("long") % 30_000 - 10_000).cast("int").alias("sample")).alias("s"), "us")
    g = x.groupBy("station", "chunk").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["sample"]).alias("samples"), F.min("us").alias("start_us"))
    choice = F.element_at(F.array(*map(F.lit, encodings)), F.col("chunk") % len(encodings) + 1)
    g = g.withColumn("encoding", choice).withColumn("code", F.concat(F.lit("S"), F.lpad((F.col("station") % 10_000).cast("string"), 4, "0")))
    return records.encode_records(g, ("station", "chunk"))


@query("record_headers", f"WITH {SERIES} SELECT station, chunk, 'S' || lpad((station % 10000)::VARCHAR, 4, '0') AS code, min(us) AS start_us, 100.0::DOUBLE AS rate, count(*) AS n_samples, CASE chunk % 4 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 1 ELSE 3 END AS encoding, '' AS reason FROM x GROUP BY station, chunk")
def record_headers(spark, sf_dir):
    """Fields of every record's header."""
    h = records.decode_records(_records(spark, sf_dir, (10, 11, 1, 3)).withColumnRenamed("station", "key"), ("key", "chunk"))
    return h.toDF("key", "chunk", "code", "location", "channel", "network", "start_us", "rate", "n_samples", "encoding", "reason", "samples").select(F.col("key").alias("station"), "chunk", "code", "start_us", "rate", "n_samples", "encoding", "reason")


def _samples(spark, sf_dir, encodings):
    h = records.decode_records(_records(spark, sf_dir, encodings).withColumnRenamed("station", "key"), ("key", "chunk"))
    return h.select(F.col("key").alias("station"), "chunk", F.posexplode("samples").alias("seq", "sample"))


SAMPLES = f"WITH {SERIES} SELECT station, chunk, seq, sample FROM x"


@query("decode_steim1", SAMPLES)
def decode_steim1(spark, sf_dir):
    """Samples read back from records of the first delta compression."""
    return _samples(spark, sf_dir, (records.STEIM1,))


@query("decode_steim2", SAMPLES)
def decode_steim2(spark, sf_dir):
    """Samples read back from records of the second delta compression."""
    return _samples(spark, sf_dir, (records.STEIM2,))


@query("decode_integers", SAMPLES)
def decode_integers(spark, sf_dir):
    """Samples read back from records of plain 16- and 32-bit integers."""
    return _samples(spark, sf_dir, (records.INT16, records.INT32))


@query("record_window", f"WITH {SERIES}, w AS (SELECT min(us) + 7200000000 AS lo FROM x), s AS (SELECT station, chunk, min(us) AS start_us FROM x GROUP BY ALL) SELECT station, count(*) AS samples, sum(sample)::BIGINT AS total FROM x JOIN s USING (station, chunk), w WHERE s.start_us >= w.lo AND s.start_us < w.lo + 432000000000 GROUP BY station")
def record_window(spark, sf_dir):
    """Samples of the records that start in a window: other records are left out before they are decoded twice."""
    h = records.decode_records(_records(spark, sf_dir, (10, 11)).withColumnRenamed("station", "key"), ("key",))
    low = detections(spark, sf_dir).agg((F.min("us") + 7_200_000_000).alias("lo"))
    inside = h.join(F.broadcast(low)).where("start_us >= lo and start_us < lo + 432000000000")
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + v)
    return inside.groupBy(F.col("key").alias("station")).agg(F.sum("n_samples").alias("samples"), F.sum(total).alias("total"))


@query("record_clock", "SELECT o_orderkey, epoch_us(make_timestamp(1900 + o_orderkey % 200, 1, 1, 0, 0, 0) + to_days(CAST(o_custkey % 366 AS INT))) * 1000 + (o_orderkey % 24) * 3600000000000 + (o_custkey % 60) * 60000000000 + (o_orderkey % 61) * 1000000000 + (o_custkey % 10000) * 100000 + (o_orderkey % 100 - 50) * 1000 AS ns, round(CASE WHEN f = 0 OR m = 0 THEN 0 WHEN f > 0 AND m > 0 THEN f * m WHEN f > 0 THEN -f / m WHEN m > 0 THEN -m / f ELSE 1 / (f * m) END, 9) AS rate FROM (SELECT *, (o_orderkey % 7 - 3)::DOUBLE AS f, (o_custkey % 5 - 2)::DOUBLE AS m FROM orders)")
def record_clock(spark, sf_dir):
    """Start times from their parts and rates from factor and multiplier, as column expressions."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ns = clock.day_of_year_ns(1900 + k % 200, c % 366 + 1, k % 24, c % 60, k % 61, c % 10_000, k % 100 - 50)
    return o.select("o_orderkey", ns.alias("ns"), F.round(clock.rate_of(k % 7 - 3, c % 5 - 2), 9).alias("rate"))


@query("sign_extension", "SELECT l_orderkey, l_linenumber, CASE WHEN v >= 16384 THEN v - 32768 ELSE v END AS signed FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100) AS BIGINT) % 32768 AS v FROM lineitem)")
def sign_extension(spark, sf_dir):
    """Two's complement of 15-bit fields."""
    v = F.floor(F.col("l_extendedprice") * 100).cast("long") % 32_768
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clock.sign_extend(v, 15).alias("signed"))


@query("wrapping_integration", f"WITH {SERIES}, d AS (SELECT station, chunk, seq, sample * 300000 AS d FROM x), s AS (SELECT station, chunk, seq, (sum(d) OVER (PARTITION BY station, chunk ORDER BY seq))::BIGINT AS s FROM d) SELECT station, chunk, seq, CASE WHEN ((s % 4294967296) + 4294967296) % 4294967296 >= 2147483648 THEN ((s % 4294967296) + 4294967296) % 4294967296 - 4294967296 ELSE ((s % 4294967296) + 4294967296) % 4294967296 END AS sample FROM s")
def wrapping_integration(spark, sf_dir):
    """Samples as running sums of differences, modulo 32 bits."""
    e = detections(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("station").orderBy("us", "event_id")) - 1)
    x = e.select("station", F.floor(F.col("i") / CHUNK).cast("int").alias("chunk"), (F.col("i") % CHUNK).alias("seq"), ((F.floor(F.col("value") * 100).cast("long") % 30_000 - 10_000) * 300_000).alias("d"))
    s = F.sum("d").over(W.partitionBy("station", "chunk").orderBy("seq"))
    return x.select("station", "chunk", "seq", clock.sign_extend(F.pmod(s, F.lit(1 << 32)), 32).alias("sample"))


@query("catalogue_text", "SELECT o_orderkey AS id, epoch_us(o_orderdate) AS us, CASE WHEN o_custkey % 5 > 0 THEN round(o_totalprice / 5000, 2) END AS depth, round(o_totalprice / 50000, 2) AS mag FROM orders WHERE o_custkey % 7 > 0")
def catalogue_text(spark, sf_dir):
    """A catalogue in text with bars between fields: rows without a size are dropped, an empty depth is null."""
    o = table(spark, sf_dir, "orders")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    depth, mag = F.when(F.col("o_custkey") % 5 > 0, F.round(F.col("o_totalprice") / 5000, 2)), F.when(F.col("o_custkey") % 7 > 0, F.round(F.col("o_totalprice") / 50_000, 2))
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), text(depth), text(mag))
    row = F.from_csv(line, "id bigint, time string, depth double, mag double", {"sep": "|"})
    return o.select(row.alias("r")).select("r.*").where("mag is not null").select("id", clock.parse_utc(F.col("time")).alias("us"), "depth", "mag")


ENDPOINT = r"^([A-Za-z0-9.-]+)(?::([0-9]{1,5}))?$"


@query("parse_endpoints", r"WITH u AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) || CASE WHEN page_id % 3 = 0 THEN ':' || (page_id * 97 % 80000)::VARCHAR WHEN page_id % 3 = 1 THEN ':x' ELSE '' END AS t FROM pages), p AS (SELECT page_id, regexp_extract(t, '^([A-Za-z0-9.-]+)(?::([0-9]{1,5}))?$', 1) AS host, regexp_extract(t, '^([A-Za-z0-9.-]+)(?::([0-9]{1,5}))?$', 2) AS port FROM u) SELECT page_id, CASE WHEN host <> '' AND (port = '' OR TRY_CAST(NULLIF(port, '') AS INT) BETWEEN 1 AND 65535) THEN host END AS host, CASE WHEN host <> '' AND (port = '' OR TRY_CAST(NULLIF(port, '') AS INT) BETWEEN 1 AND 65535) THEN CASE WHEN port = '' THEN 18000 ELSE TRY_CAST(NULLIF(port, '') AS INT) END END AS port FROM p")
def parse_endpoints(spark, sf_dir):
    """Host and port of an endpoint text; 18000 where none is given, null where the text is none."""
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.regexp_extract("url", "://([^/]+)", 1), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(":"), (F.col("page_id") * 97 % 80_000).cast("string"))).when(F.col("page_id") % 3 == 1, ":x").otherwise(""))
    host, port = F.regexp_extract(text, ENDPOINT, 1), F.regexp_extract(text, ENDPOINT, 2)
    number = F.when(port == "", F.lit(18_000)).otherwise(port.try_cast("int"))
    ok = (host != "") & number.between(1, 65_535)
    return p.select("page_id", F.when(ok, host).alias("host"), F.when(ok, number).alias("port"))


@query("parse_stream_list", "WITH s AS (SELECT c_custkey, 'AB_' || c_mktsegment || ':HH?,' || c_nationkey::VARCHAR || '_X:BHZ' AS t FROM customer), x AS (SELECT c_custkey, unnest(string_split(t, ',')) AS part FROM s) SELECT c_custkey, split_part(split_part(part, ':', 1), '_', 1) AS network, split_part(split_part(part, ':', 1), '_', 2) AS station, split_part(part, ':', 2) AS selector FROM x")
def parse_stream_list(spark, sf_dir):
    """Streams of a list: network, station and selector of each entry."""
    t = F.concat(F.lit("AB_"), F.col("c_mktsegment"), F.lit(":HH?,"), F.col("c_nationkey").cast("string"), F.lit("_X:BHZ"))
    x = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.split(t, ",")).alias("part"))
    name = F.split_part("part", F.lit(":"), F.lit(1))
    return x.select("c_custkey", F.split_part(name, F.lit("_"), F.lit(1)).alias("network"), F.split_part(name, F.lit("_"), F.lit(2)).alias("station"), F.split_part("part", F.lit(":"), F.lit(2)).alias("selector"))


@query("message_sink", "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY kind")
def message_sink(spark, sf_dir):
    """Messages written by tag and read back."""
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    sinks.write_messages(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "value"), path, "kind")
    back = spark.read.schema(T.StructType.fromDDL("event_id bigint, value double, kind string")).parquet(path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
