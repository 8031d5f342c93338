"""Queries of ordering, gaps, runs, triggers and interval sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.operators import fold, islands, stats
from tremolo.plans.registry import DETECTIONS, detections, query, r6, table
from tremolo.functions import clock

S = 1_000_000  # microseconds in a second

ARRIVALS = f"WITH {DETECTIONS}, r AS (SELECT event_id, station % 10 AS channel, us AS lo, us + 600000000 AS hi, us + ((event_id * 7919) % 601) * 10000000 AS arrival FROM e)"


def _records(spark, sf_dir):
    """Events as records of ten minutes on ten channels, in a synthetic order of arrival."""
    e = detections(spark, sf_dir)
    return e.select("event_id", (F.col("station") % 10).alias("channel"), F.col("us").alias("lo"), (F.col("us") + 600 * S).alias("hi"), (F.col("us") + F.pmod(F.col("event_id") * 7919, F.lit(601)) * 10 * S).alias("arrival"))


@query(
    "reorder_gaps",
    ARRIVALS
    + """, f AS (SELECT *, max(hi) OVER (PARTITION BY channel ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM r)
SELECT channel, event_id, front, lo - front AS gap FROM f WHERE lo > front""",
)
def reorder_gaps(spark, sf_dir):
    """Gaps that a reorder buffer without patience declares."""
    out = islands.arrival_gaps(_records(spark, sf_dir), "lo", "hi", ["arrival", "event_id"], ["channel"])
    return out.where("gap > 0").select("channel", "event_id", "front", "gap")


@query(
    "reorder_stats",
    ARRIVALS
    + """, f AS (SELECT *, max(hi) OVER (PARTITION BY channel ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM r)
SELECT channel, count(*) AS records, count(*) FILTER (hi <= front) AS stale, count(*) FILTER (lo > front) AS gaps,
       count(*) FILTER (lo < front AND hi > front) AS trimmed, coalesce(sum(lo - front) FILTER (lo > front), 0)::BIGINT AS missing,
       coalesce(max(front - lo) FILTER (lo < front), 0) AS max_lateness
FROM f GROUP BY channel""",
)
def reorder_stats(spark, sf_dir):
    """Per channel: records, stale and trimmed ones, gaps, what is missing and the most lateness."""
    out = islands.arrival_gaps(_records(spark, sf_dir), "lo", "hi", ["arrival", "event_id"], ["channel"])
    late = F.when(F.col("lo") < F.col("front"), F.col("front") - F.col("lo"))
    return out.groupBy("channel").agg(
        F.count("*").alias("records"), F.count_if("stale").alias("stale"), F.count_if(F.col("gap") > 0).alias("gaps"),
        F.count_if((F.col("lo") < F.col("front")) & (F.col("hi") > F.col("front"))).alias("trimmed"), F.sum("gap").alias("missing"), F.coalesce(F.max(late), F.lit(0)).alias("max_lateness"),
    )


@query(
    "reorder_check",
    ARRIVALS
    + """, f AS (SELECT *, max(hi) OVER (PARTITION BY channel ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM r),
k AS (SELECT channel, event_id, arrival - hi AS delay FROM f WHERE front IS NULL OR hi > front)
SELECT r.channel, count(*) AS records, count(k.event_id) AS kept, round(quantile_cont(k.delay, 0.5), 3) AS delay_p50, round(quantile_cont(k.delay, 0.99), 3) AS delay_p99
FROM r LEFT JOIN k ON r.event_id = k.event_id GROUP BY r.channel""",
)
def reorder_check(spark, sf_dir):
    """What reordering kept of all records, and the delays of what it kept."""
    r = _records(spark, sf_dir)
    kept = islands.arrival_gaps(r, "lo", "hi", ["arrival", "event_id"], ["channel"]).where("not stale").select("event_id", (F.col("arrival") - F.col("hi")).alias("delay"))
    both = r.join(kept, "event_id", "left")
    n = both.groupBy("channel").agg(F.count("*").alias("records"), F.count("delay").alias("kept"))
    q = stats.interpolated_all(both, "delay", {"delay_p50": 0.5, "delay_p99": 0.99}, ["channel"])
    return n.join(q, "channel", "left").select("channel", "records", "kept", *[F.round(c, 3).alias(c) for c in ("delay_p50", "delay_p99")])


@query(
    "gap_scan",
    f"""WITH {DETECTIONS}, r AS (SELECT station % 10 AS channel, us AS lo, us + 600000000 AS hi FROM e),
g AS (SELECT channel, hi AS gap_start, lead(lo) OVER (PARTITION BY channel ORDER BY lo, hi) AS gap_end FROM r)
SELECT channel, count(*) AS gaps, sum(gap_end - gap_start)::BIGINT AS total, max(gap_end - gap_start) AS longest, arg_max(gap_start, (gap_end - gap_start, gap_start)) AS longest_at
FROM g WHERE gap_end - gap_start > 1000000 GROUP BY channel""",
)
def gap_scan(spark, sf_dir):
    """Gaps of more than a second between a channel's records: number, total and the longest."""
    g = islands.gaps(_records(spark, sf_dir), "lo", "hi", ["channel"], S).withColumn("n", F.col("gap_end") - F.col("gap_start"))
    return g.groupBy("channel").agg(F.count("*").alias("gaps"), F.sum("n").alias("total"), F.max("n").alias("longest"), F.max_by("gap_start", F.struct("n", "gap_start")).alias("longest_at"))


SPANS = "s AS (SELECT o_custkey % 50 AS grp, epoch_us(o_orderdate) AS lo, epoch_us(o_orderdate) + (1 + o_orderkey % 5) * 86400000000 AS hi FROM orders)"
MERGED = (
    SPANS
    + """, m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY grp ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM m),
u AS (SELECT grp, min(lo) AS lo, max(hi) AS hi, count(*) AS pieces FROM i GROUP BY grp, isl)"""
)


def _spans(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    us = clock.micros(F.col("o_orderdate"))
    return o.select((F.col("o_custkey") % 50).alias("grp"), us.alias("lo"), (us + (F.col("o_orderkey") % 5 + 1) * F.lit(86_400 * S)).alias("hi"))


@query("interval_union", f"WITH {MERGED} SELECT * FROM u")
def interval_union(spark, sf_dir):
    """Overlapping spans of a group merged."""
    return islands.merge_intervals(_spans(spark, sf_dir), "lo", "hi", ["grp"])


@query(
    "interval_complement",
    f"""WITH {MERGED}, q AS (SELECT grp, hi + 3600000000 AS low, lead(lo) OVER (PARTITION BY grp ORDER BY lo) - 3600000000 AS high FROM u)
SELECT grp, low, high FROM q WHERE high - low >= 86400000000""",
)
def interval_complement(spark, sf_dir):
    """Quiet spans between merged ones, an hour away from them and a day long at least."""
    u = islands.merge_intervals(_spans(spark, sf_dir), "lo", "hi", ["grp"])
    nxt = F.lead("lo").over(W.partitionBy("grp").orderBy("lo"))
    q = u.select("grp", (F.col("hi") + 3600 * S).alias("low"), (nxt - 3600 * S).alias("high"))
    return q.where(F.col("high") - F.col("low") >= 86_400 * S)


@query(
    "interval_coverage",
    f"""WITH {MERGED}, b AS (SELECT 852076800000000 AS l, 883612800000000 AS h)
SELECT grp, round(sum(greatest(0, least(hi, h) - greatest(lo, l)))::DOUBLE / (883612800000000 - 852076800000000)::DOUBLE, 6) AS covered FROM u, b GROUP BY grp""",
)
def interval_coverage(spark, sf_dir):
    """Share of one year that a group's merged spans cover."""
    low, high = 852_076_800 * S, 883_612_800 * S
    u = islands.merge_intervals(_spans(spark, sf_dir), "lo", "hi", ["grp"])
    part = F.greatest(F.lit(0), F.least("hi", F.lit(high)) - F.greatest("lo", F.lit(low)))
    return u.groupBy("grp").agg(r6(F.sum(part).cast("double") / F.lit(float(high - low))).alias("covered"))


@query(
    "fill_policy",
    f"""WITH {DETECTIONS}, r AS (SELECT station % 10 AS channel, us AS lo, us + 600000000 AS hi FROM e),
g AS (SELECT channel, hi AS a, lead(lo) OVER (PARTITION BY channel ORDER BY lo, hi) AS b FROM r),
l AS (SELECT unnest([0, 600, 3600, 14400]) AS fill),
k AS (SELECT fill, a - 6000000 AS lo, b AS hi FROM g, l WHERE b - a > fill * 1000000::BIGINT AND b > a),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY fill ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY fill ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM m),
u AS (SELECT fill, isl, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY fill, isl)
SELECT fill, sum(hi - lo)::BIGINT AS blocked, count(*) AS spans FROM u GROUP BY fill""",
)
def fill_policy(spark, sf_dir):
    """Window starts blocked by gaps on any channel, if gaps up to a length were bridged."""
    g = islands.gaps(_records(spark, sf_dir), "lo", "hi", ["channel"])
    fills = spark.createDataFrame([(f,) for f in (0, 600, 3600, 14_400)], "fill int")
    k = g.join(F.broadcast(fills), F.col("gap_end") - F.col("gap_start") > F.col("fill").cast("long") * S).select("fill", (F.col("gap_start") - 6 * S).alias("lo"), F.col("gap_end").alias("hi"))
    return islands.coverage(k, "lo", "hi", ["fill"], 86_400 * S).withColumnRenamed("covered", "blocked")


@query(
    "hysteresis_triggers",
    f"""WITH {DETECTIONS}, x AS (SELECT *, CASE WHEN value >= 80 THEN 'on' WHEN value < 20 THEN 'off' END AS ev FROM e),
l AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY station ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM x)
SELECT station, event_id, us, value FROM l WHERE ev = 'on' AND coalesce(last, 'off') = 'off'""",
)
def hysteresis_triggers(spark, sf_dir):
    """Onsets: at or above the on level, armed by a value below the off level."""
    return islands.hysteresis(detections(spark, sf_dir), "value", 80.0, 20.0, ["us", "event_id"], ["station"]).select("station", "event_id", "us", "value")


@query(
    "persistence_runs",
    f"""WITH {DETECTIONS}, f AS (SELECT *, value >= 30 AS flag, coalesce(lag(value >= 30) OVER (PARTITION BY station ORDER BY us, event_id), false) AS prev FROM e),
r AS (SELECT *, sum(CASE WHEN flag AND NOT prev THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f)
SELECT station, min(us) AS first, max(us) AS last, count(*) AS n, max(value) AS peak FROM r WHERE flag GROUP BY station, run HAVING count(*) >= 4 OR max(value) >= 200""",
)
def persistence_runs(spark, sf_dir):
    """Runs of four rows at the level, or with one at the instant level."""
    return islands.persistence_runs(detections(spark, sf_dir), "value", 30.0, 200.0, 4, ["us", "event_id"], ["station"]).drop("run")


@query(
    "persistence_trigger",
    f"""WITH RECURSIVE {DETECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY us, event_id) AS k FROM e),
w AS (
  SELECT station, 0::BIGINT AS k, 0 AS run, NULL::BIGINT AS start, 0.0::DOUBLE AS peak, true AS armed, 0 AS low, NULL::BIGINT AS last, false AS fired, NULL::BIGINT AS us FROM o WHERE k = 1
  UNION ALL
  SELECT station, k, CASE WHEN fire THEN run ELSE run END, start, peak, CASE WHEN fire THEN false ELSE armed END, low, CASE WHEN fire THEN start ELSE last END, fire, us FROM (
    SELECT *, armed AND run > 0 AND (run >= 3 OR peak >= 150) AND (last IS NULL OR start - last > 7200000000) AS fire FROM (
      SELECT o.station, o.k, CASE WHEN o.value >= 30 THEN w.run + 1 ELSE 0 END AS run, CASE WHEN o.value >= 30 AND w.run = 0 THEN o.us ELSE w.start END AS start,
             CASE WHEN o.value < 30 THEN 0.0 WHEN w.run = 0 THEN o.value ELSE greatest(w.peak, o.value) END AS peak,
             w.armed OR (CASE WHEN o.value < 15 THEN w.low + 1 ELSE 0 END) >= 2 AS armed, CASE WHEN o.value < 15 THEN w.low + 1 ELSE 0 END AS low, w.last, o.us
      FROM w JOIN o ON o.station = w.station AND o.k = w.k + 1)))
SELECT station, start, us AS declared, peak FROM w WHERE fired""",
)
def persistence_trigger(spark, sf_dir):
    """The stateful trigger: runs, instant level, release after two low rows and a least distance."""
    e = detections(spark, sf_dir).select("station", "us", "event_id", "value")
    step = fold.trigger_step("us", "value", ["station"], 30.0, 3, 150.0, 15.0, 2, 7200 * S)
    return fold.ordered_fold(e, ["station"], ["us", "event_id"], step, "station bigint, start bigint, declared bigint, peak double")


@query(
    "greedy_min_gap",
    f"""WITH RECURSIVE {DETECTIONS}, o AS (SELECT station, us, event_id FROM e),
w AS (
  SELECT station, min(us) AS us FROM o GROUP BY station
  UNION ALL
  SELECT w.station, (SELECT min(o.us) FROM o WHERE o.station = w.station AND o.us > w.us + 86400000000) AS us FROM w WHERE w.us IS NOT NULL)
SELECT station, us FROM w WHERE us IS NOT NULL""",
)
def greedy_min_gap(spark, sf_dir):
    """Rows of a station kept if a day after the last kept one."""
    return fold.greedy_min_gap(detections(spark, sf_dir), "us", 86_400 * S, ["station"], ["station", "us"])


@query(
    "session_bursts",
    f"""WITH {DETECTIONS}, n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY station ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM n)
SELECT station, min(us) AS start, max(us) AS "end", count(*) AS n FROM b GROUP BY station, burst""",
)
def session_bursts(spark, sf_dir):
    """Sessions of a station: rows within an hour of the row before."""
    return islands.bursts(detections(spark, sf_dir), "us", 3600 * S, ["station"])


@query(
    "sliding_window_counts",
    f"""WITH {DETECTIONS}, w AS (SELECT unnest(generate_series((us // 21600000000 - 3) * 21600000000, (us // 21600000000) * 21600000000, 21600000000)) AS start, us, value FROM e)
SELECT start, count(*) AS n, max(value) AS peak FROM w WHERE us >= start AND us < start + 86400000000 GROUP BY start""",
)
def sliding_window_counts(spark, sf_dir):
    """Windows of a day that step by six hours on an absolute grid."""
    step, size = 21_600 * S, 86_400 * S
    last = F.floor(F.col("us") / F.lit(step)).cast("long") * step
    e = detections(spark, sf_dir).withColumn("start", F.explode(F.sequence(last - (size - step), last, F.lit(step))))
    return e.groupBy("start").agg(F.count("*").alias("n"), F.max("value").alias("peak"))


@query(
    "tumbling_peak",
    f"""WITH {DETECTIONS} SELECT station, us // 86400000000 AS bin, CASE WHEN count(*) >= 2 THEN max(value) END AS peak, count(*) AS n FROM e GROUP BY 1, 2""",
)
def tumbling_peak(spark, sf_dir):
    """Peaks of tumbling bins, null where a bin is incomplete."""
    e = detections(spark, sf_dir).withColumn("bin", F.floor(F.col("us") / F.lit(86_400 * S)).cast("long"))
    return e.groupBy("station", "bin").agg(F.when(F.count("*") >= 2, F.max("value")).alias("peak"), F.count("*").alias("n"))


@query(
    "complete_windows",
    f"""WITH {DETECTIONS}, h AS (SELECT station % 10 AS channel, us // 3600000000 AS pos, count(*) AS n FROM e GROUP BY 1, 2),
w AS (SELECT channel, pos - o AS start, pos FROM h, (SELECT unnest(range(6)) AS o))
SELECT channel, start FROM w GROUP BY channel, start HAVING count(*) = 6""",
)
def complete_windows(spark, sf_dir):
    """Windows of six hours without an empty hour: no window that touches a gap is given out."""
    h = detections(spark, sf_dir).select((F.col("station") % 10).alias("channel"), F.floor(F.col("us") / F.lit(3600 * S)).cast("long").alias("pos")).distinct()
    w = h.withColumn("start", F.explode(F.sequence(F.col("pos") - 5, F.col("pos"))))
    return w.groupBy("channel", "start").agg(F.count("*").alias("n")).where("n = 6").drop("n")


@query(
    "trailing_min_anchor",
    f"""WITH {DETECTIONS}, m AS (SELECT *, min(value) OVER (PARTITION BY station ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS low FROM e)
SELECT station, min(us) AS anchor, arg_min(value, us) AS value FROM m WHERE value >= 60 AND low < 10 GROUP BY station""",
)
def trailing_min_anchor(spark, sf_dir):
    """The first row at a level after a quiet trailing frame."""
    low = F.min("value").over(W.partitionBy("station").orderBy("us", "event_id").rowsBetween(-5, -1))
    m = detections(spark, sf_dir).withColumn("low", low).where("value >= 60 and low < 10")
    return m.groupBy("station").agg(F.min("us").alias("anchor"), F.min_by("value", "us").alias("value"))


@query(
    "retention_counts",
    f"""WITH {DETECTIONS} SELECT event_id, count(*) OVER (PARTITION BY station ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS kept,
       max(value) OVER (PARTITION BY station ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS peak FROM e""",
)
def retention_counts(spark, sf_dir):
    """What a buffer of the last day holds at every row."""
    w = W.partitionBy("station").orderBy("us").rangeBetween(-86_400 * S, 0)
    return detections(spark, sf_dir).select("event_id", F.count("*").over(w).alias("kept"), F.max("value").over(w).alias("peak"))


@query("total_order", f"WITH {DETECTIONS} SELECT event_id, row_number() OVER (ORDER BY us, station, event_id) AS seq FROM e")
def total_order(spark, sf_dir):
    """Every row's place in the stream's total order (time, station, sequence)."""
    return stats.row_numbers(detections(spark, sf_dir).select("us", "station", "event_id"), ["us", "station", "event_id"]).select("event_id", "seq")


@query(
    "watermark_lateness",
    f"""WITH {DETECTIONS}, a AS (SELECT *, us + ((event_id * 7919) % 601) * 1000000 AS arrival FROM e),
p AS (SELECT *, max(us) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT station, count(*) FILTER (us < seen - 300000000) AS late, count(*) AS n FROM p GROUP BY station""",
)
def watermark_lateness(spark, sf_dir):
    """Rows that arrive behind a watermark of five minutes: counted, not dropped. The running maximum over all
    stations is that of hours plus that of the rows before in the hour, so that no task holds all rows."""
    a = detections(spark, sf_dir).withColumn("arrival", F.col("us") + F.pmod(F.col("event_id") * 7919, F.lit(601)) * S)
    a = a.withColumn("hour", F.floor(F.col("arrival") / F.lit(3600 * S)).cast("long"))
    hours = a.groupBy("hour").agg(F.max("us").alias("m"))
    hours = hours.select("hour", F.max("m").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = F.max("us").over(W.partitionBy("hour").orderBy("arrival", "event_id").rowsBetween(W.unboundedPreceding, -1))
    p = a.withColumn("inside", inside).join(hours, "hour").withColumn("seen", F.greatest("inside", "before"))
    return p.groupBy("station").agg(F.count_if(F.col("us") < F.col("seen") - 300 * S).alias("late"), F.count("*").alias("n"))


@query(
    "latency_histogram",
    f"""WITH {DETECTIONS}, l AS (SELECT station % 10 AS channel, ((event_id * 7919) % 1301) / 10.0::DOUBLE AS s FROM e),
b AS (SELECT channel, CASE WHEN s >= 120 THEN 1200 ELSE floor(s * 10)::BIGINT END AS bin, count(*) AS n FROM l GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY channel ORDER BY bin) AS run, sum(n) OVER (PARTITION BY channel) AS total FROM b)
SELECT channel, min(bin) FILTER (2 * run >= total) AS median_bin, max(total)::BIGINT AS n, coalesce(sum(n) FILTER (bin = 1200), 0)::BIGINT AS beyond FROM c GROUP BY channel""",
)
def latency_histogram(spark, sf_dir):
    """Latencies in bins of 0.1 s up to 120 s, and the bin of the median."""
    s = F.pmod(F.col("event_id") * 7919, F.lit(1301)) / F.lit(10.0)
    b = detections(spark, sf_dir).select((F.col("station") % 10).alias("channel"), F.when(s >= 120, F.lit(1200)).otherwise(F.floor(s * 10)).cast("long").alias("bin")).groupBy("channel", "bin").agg(F.count("*").alias("n"))
    c = b.withColumn("run", F.sum("n").over(W.partitionBy("channel").orderBy("bin"))).withColumn("total", F.sum("n").over(W.partitionBy("channel")))
    return c.groupBy("channel").agg(F.min(F.when(F.col("run") * 2 >= F.col("total"), F.col("bin"))).alias("median_bin"), F.max("total").alias("n"), F.coalesce(F.sum(F.when(F.col("bin") == 1200, F.col("n"))), F.lit(0)).alias("beyond"))


@query(
    "record_admission",
    f"""WITH {DETECTIONS}, r AS (SELECT *, event_id % 3 AS loc, CASE WHEN kind = 'error' THEN 'channel' WHEN event_id % 17 = 0 THEN 'rate' END AS bad FROM e),
f AS (SELECT *, first_value(loc) OVER (PARTITION BY station ORDER BY (bad IS NOT NULL), us, event_id) AS first FROM r)
SELECT station, coalesce(bad, CASE WHEN loc <> first THEN 'location' ELSE 'accepted' END) AS reason, count(*) AS n FROM f GROUP BY 1, 2""",
)
def record_admission(spark, sf_dir):
    """Why records are let in or not: channel, rate, and the first admitted location of a station."""
    bad = F.when(F.col("kind") == "error", "channel").when(F.col("event_id") % 17 == 0, "rate")
    r = detections(spark, sf_dir).withColumn("loc", F.col("event_id") % 3).withColumn("bad", bad)
    first = F.first("loc").over(W.partitionBy("station").orderBy(F.col("bad").isNotNull(), "us", "event_id"))
    reason = F.coalesce("bad", F.when(F.col("loc") != first, "location").otherwise("accepted"))
    return r.withColumn("reason", reason).groupBy("station", "reason").agg(F.count("*").alias("n"))


@query(
    "sequence_dedup",
    f"""WITH {DETECTIONS}, s AS (SELECT station, event_id, (event_id * 65537) % 16777216 AS seq, us FROM e),
l AS (SELECT *, lag(seq) OVER (PARTITION BY station ORDER BY us, event_id) AS last FROM s)
SELECT station, event_id, seq, (((seq - last) % 16777216) + 16777216) % 16777216 BETWEEN 1 AND 8388607 AS after FROM l WHERE last IS NOT NULL""",
)
def sequence_dedup(spark, sf_dir):
    """Wrapping 24-bit sequence numbers: whether each is after the one before."""
    s = detections(spark, sf_dir).select("station", "event_id", "us", F.pmod(F.col("event_id") * 65_537, F.lit(1 << 24)).alias("seq"))
    last = F.lag("seq").over(W.partitionBy("station").orderBy("us", "event_id"))
    return s.withColumn("last", last).where("last is not null").select("station", "event_id", "seq", clock.sequence_after(F.col("seq"), F.col("last")).alias("after"))


@query(
    "clock_functions",
    f"""WITH {DETECTIONS}, m AS (SELECT event_id, us, (us + 500) // 1000 % 86400000 AS ms, us // 10000 AS pos, us / 1000000 % 86400.0::DOUBLE AS sod FROM e)
SELECT event_id, pos, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000 // 10)::VARCHAR, 2, '0') AS hms,
       round(((sod - 80000 + 43200) % 86400.0::DOUBLE + 86400.0::DOUBLE) % 86400.0::DOUBLE - 43200, 4) AS after,
       round(((sod - 391) % 86400.0::DOUBLE + 86400.0::DOUBLE) % 86400.0::DOUBLE, 4) AS unshifted
FROM m""",
)
def clock_functions(spark, sf_dir):
    """Positions, printed times of day and differences around midnight."""
    e = detections(spark, sf_dir)
    sod = F.col("us") / F.lit(1e6) % F.lit(86_400.0)
    return e.select("event_id", clock.position(F.col("us")).alias("pos"), clock.hms(F.col("us")).alias("hms"), F.round(clock.seconds_after(sod, F.lit(80_000.0)), 4).alias("after"), F.round(clock.unshift(sod, F.lit(391.0)), 4).alias("unshifted"))
