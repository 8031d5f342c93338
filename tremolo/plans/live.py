"""Streaming queries, each equal to a batch one, and queries of live operation: reordering, restarts, lateness, schedules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.functions.clock import micros
from tremolo.operators import fold, parts, ranges, rules
from tremolo.plans import intervals
from tremolo.plans.registry import DETECTIONS, ORACLES, detections, query
from tremolo.sources.shared import staged
from tremolo.streaming import buffer, folds

S, HOUR = 1_000_000, 3_600_000_000


def _stream(spark, sf_dir):
    e = folds.stream_table(spark, f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("user_id").alias("station"), micros(F.col("ts")).alias("us"), F.col("event_type").alias("kind"), "value")


@query("stream_min_gap", ORACLES["greedy_min_gap"])
def stream_min_gap(spark, sf_dir):
    """``greedy_min_gap`` on a stream."""
    step = fold.min_gap_step("us", 86_400 * S, ["station", "us"])
    out = folds.stateful(_stream(spark, sf_dir).select("station", "us", "event_id"), ["station"], ["us", "event_id"], step, "station bigint, us bigint")
    return folds.drained(out, spark, "stream-min-gap")


@query("stream_trigger", ORACLES["persistence_trigger"])
def stream_trigger(spark, sf_dir):
    """``persistence_trigger`` on a stream."""
    step = fold.trigger_step("us", "value", ["station"], 30.0, 3, 150.0, 15.0, 2, 7200 * S)
    out = folds.stateful(_stream(spark, sf_dir).select("station", "us", "event_id", "value"), ["station"], ["us", "event_id"], step, "station bigint, start bigint, declared bigint, peak double")
    return folds.drained(out, spark, "stream-trigger")


@query("stream_filter", f"WITH {DETECTIONS} SELECT event_id, station, us FROM e WHERE kind = 'error' AND value > 100")
def stream_filter(spark, sf_dir):
    """Rows of a stream that pass a filter, appended to an archive as they are."""
    return folds.drained(_stream(spark, sf_dir).where("kind = 'error' and value > 100").select("event_id", "station", "us"), spark, "stream-filter")


@query("stream_distinct", "SELECT DISTINCT user_id AS station, event_type AS kind FROM events")
def stream_distinct(spark, sf_dir):
    """The first row of each station and kind of a stream; what comes again is dropped."""
    return folds.drained(_stream(spark, sf_dir).dropDuplicates(["station", "kind"]).select("station", "kind"), spark, "stream-distinct")


def _late_step(rows_columns):
    def step(newest, rows):
        top = rows["us"].cummax()
        before = top.shift().fillna(newest if newest is not None else rows["us"].iloc[0]).clip(lower=newest).astype("int64")
        late = rows["us"] < before - 600 * S
        out = rows.assign(late_us=(before - rows["us"])).loc[late, [*rows_columns, "late_us"]]
        return int(max(top.iloc[-1], newest if newest is not None else top.iloc[-1])), out

    return step


LATE = f"WITH {DETECTIONS}, f AS (SELECT station % 10 AS channel, event_id, us, max(us) OVER (PARTITION BY station % 10 ORDER BY us + (event_id * 7919) % 601 * 10000000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e) SELECT channel, event_id, us, newest - us AS late_us FROM f WHERE us < newest - 600000000"


@query("stream_late_rows", LATE)
def stream_late_rows(spark, sf_dir):
    """Rows that come more than ten minutes behind the newest of their channel, kept beside the stream instead of dropped."""
    arrival = F.col("us") + F.pmod(F.col("event_id") * 7919, F.lit(601)) * 10 * S
    s = _stream(spark, sf_dir).select((F.col("station") % 10).alias("channel"), "event_id", "us", arrival.alias("arrival"))
    out = folds.stateful(s, ["channel"], ["arrival", "event_id"], _late_step(["channel", "event_id", "us"]), "channel bigint, event_id bigint, us bigint, late_us bigint")
    return folds.drained(out, spark, "stream-late")


#: What a channel holds is given out when nothing has come from it for so long.
IDLE = 2 * HOUR
_LISTED = "STRUCT(front BIGINT, n BIGINT, length BIGINT, gaps BIGINT, missing BIGINT, stale BIGINT, old BIGINT)"


def _listed(spans: str, start: str, wait: str) -> str:
    """The buffer's rule stated over the list of spans in the order of their starts: one is let out if the front has
    reached it or the data are more than ``wait`` beyond its start."""
    begin = "coalesce(a.front, z.lo)"
    front = f"greatest({begin}, z.lo)"
    let = (
        f"struct_pack(front := greatest({front}, z.hi), n := a.n + (z.hi > {front})::BIGINT, length := a.length + greatest(z.hi - {front}, 0), gaps := a.gaps + (z.lo > {begin})::BIGINT, "
        f"missing := a.missing + greatest(z.lo - {begin}, 0), stale := a.stale + (z.hi <= {front})::BIGINT, old := a.old + CASE WHEN z.hi <= {front} THEN z.hi - z.lo ELSE 0 END)"
    )
    each = f"list_transform({spans}, lambda z: struct_pack(lo := z.lo, hi := z.hi, t := {start}))"
    first = f"struct_pack(lo := NULL::BIGINT, hi := NULL::BIGINT, t := {start})"
    step = f"CASE WHEN coalesce(z.lo <= a.t.front, false) OR seen - z.lo > {wait} THEN {let.replace('a.', 'a.t.')} ELSE a.t END"
    return f"list_reduce(list_prepend({first}, {each}), lambda a, z: struct_pack(lo := z.lo, hi := z.hi, t := {step})).t"


PATIENT = (
    intervals.ARRIVALS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", x AS (SELECT channel, lo, hi, row_number() OVER w AS k, max(hi) OVER w AS top, coalesce(arrival - lag(arrival) OVER w > {IDLE}, false) AS silent FROM r WINDOW w AS (PARTITION BY channel ORDER BY arrival, event_id)),
m AS (SELECT channel, max(k) AS most FROM x GROUP BY channel),
s AS (
  SELECT channel, 0::BIGINT AS k, []::STRUCT(lo BIGINT, hi BIGINT)[] AS held, struct_pack(front := NULL::BIGINT, n := 0, length := 0, gaps := 0, missing := 0, stale := 0, old := 0)::{_LISTED} AS t FROM m
  UNION ALL
  SELECT channel, k, list_filter(here, lambda z: coalesce(z.lo > t.front, true)) AS held, t FROM (
    SELECT channel, k, here, ({_listed("here", "t", "patience")})::{_LISTED} AS t FROM (
      SELECT channel, k, seen, patience, t, list_sort(list_append(list_filter(held, lambda z: coalesce(z.lo > t.front, true)), struct_pack(lo := lo, hi := hi))) AS here FROM (
        SELECT channel, k, seen, patience, lo, hi, held, (CASE WHEN silent THEN {_listed("held", "t", "-4000000000000000")} ELSE t END)::{_LISTED} AS t FROM (
          SELECT s.channel, x.k, x.top AS seen, x.lo, x.hi, x.silent, s.held, s.t, CASE WHEN x.k = m.most THEN -4000000000000000 ELSE {HOUR} END AS patience
          FROM s JOIN x ON x.channel = s.channel AND x.k = s.k + 1 JOIN m ON m.channel = s.channel))))),
f AS (SELECT s.channel, s.t FROM s JOIN m ON s.channel = m.channel AND s.k = m.most)
SELECT * FROM (SELECT channel, 'data' AS released, t.n AS n, t.length AS length FROM f UNION ALL SELECT channel, 'gap', t.gaps, t.missing FROM f UNION ALL SELECT channel, 'stale', t.stale, t.old FROM f) WHERE n > 0"""
)


def _summed(out):
    return out.groupBy("channel", "released").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("length"))


@query("reorder_patient", PATIENT)
def reorder_patient(spark, sf_dir):
    """The reorder buffer with an hour's patience: spans, stale ones and gaps by channel, all held ones flushed at the
    end. Channels are cut where they are silent for longer than the buffer remembers."""
    cut = parts.time_parts(intervals._records(spark, sf_dir), ["channel"], "arrival", "lo", "hi", HOUR, 24 * HOUR)
    step, end = fold.reorder_steps("channel", "lo", "hi", "event_id", HOUR, at="arrival", idle=IDLE, front="before")
    return _summed(fold.ordered_fold(cut, ["channel", "part"], ["arrival", "event_id"], step, f"channel bigint, {fold.RELEASED}", end))


@query("stream_release", PATIENT)
def stream_release(spark, sf_dir):
    """``reorder_patient`` on a stream of six micro-batches, state in Spark's state store: silent channels give out
    what they hold when a timer ends, and all do after the closing rows, which tell every channel a later time."""
    r = intervals._records(spark, sf_dir).select("channel", F.col("event_id").alias("id"), "lo", "hi", "arrival")
    late = r.groupBy("channel").agg(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.max("arrival").alias("arrival"))
    end = r.agg(F.max("arrival").alias("end"))
    close = late.crossJoin(F.broadcast(end)).withColumn("arrival", F.col("end") + 2 * IDLE)
    return _summed(folds.drained(buffer.reorder_stream(folds.replayed(r, "arrival", 6, "stream-records", close), ["channel"], HOUR, IDLE), spark, "stream-release"))


@query("reorder_release", ORACLES["reorder_gaps"])
def reorder_release(spark, sf_dir):
    """Gaps that the reorder buffer declares without patience, with the record after each."""
    step, end = fold.reorder_steps("channel", "lo", "hi", "event_id", 0)
    out = fold.ordered_fold(intervals._records(spark, sf_dir), ["channel"], ["arrival", "event_id"], step, f"channel bigint, {fold.RELEASED}", end)
    gaps = out.where("released = 'gap'").select("channel", F.col("lo").alias("front"), F.col("hi").alias("at"))
    data = out.where("released = 'data'").select("channel", F.col("id").alias("event_id"), F.col("lo").alias("at"))
    return gaps.join(data, ["channel", "at"]).select("channel", "event_id", "front", (F.col("at") - F.col("front")).alias("gap"))


@query("live_dedup", f"WITH {DETECTIONS} SELECT station, event_id, us FROM e")
def live_dedup(spark, sf_dir):
    """Records of a live source without repeats; a numbering that starts again with data newer than all of their channel
    is let in."""
    e = detections(spark, sf_dir).select("station", "event_id", "us", "kind", F.pmod(F.col("event_id") * 65_537, F.lit(1 << 24)).alias("seq"))
    e = e.withColumn("arrival", 2 * F.col("us"))
    again = e.where("event_id % 5 = 0").withColumn("us", F.col("us") - 1).withColumn("arrival", F.col("arrival") + 1)
    step = fold.live_dedup_step("seq", "us", ["station", "event_id", "us"], channel="kind")
    return fold.ordered_fold(e.unionByName(again), ["station"], ["arrival", "event_id"], step, "station bigint, event_id bigint, us bigint")


#: The rule as a fold of each station's list of tokens.
TOKENS = f"""WITH {DETECTIONS}, l AS (SELECT station, list(struct_pack(t := us, p := value % 100 / 100, d := (event_id % 9)::DOUBLE) ORDER BY us, event_id) AS rows FROM e GROUP BY station),
i AS (SELECT station, rows, struct_pack(armed := true, top := 0::DOUBLE, n := 0, fired := []::STRUCT(us BIGINT, restart BOOLEAN)[]) AS a FROM l),
f AS (SELECT station, list_reduce(list_prepend(struct_pack(t := 0::BIGINT, p := 0::DOUBLE, d := 0::DOUBLE, a := a), list_transform(rows, lambda z: struct_pack(t := z.t, p := z.p, d := z.d, a := a))),
  lambda s, z: struct_pack(t := z.t, p := z.p, d := z.d, a := CASE
    WHEN z.p < 0.3 THEN struct_pack(armed := true, top := 0::DOUBLE, n := 0, fired := s.a.fired)
    WHEN z.p < 0.5 THEN struct_pack(armed := s.a.armed, top := greatest(s.a.top, z.d), n := 0, fired := s.a.fired)
    WHEN s.a.armed THEN struct_pack(armed := false, top := z.d, n := 0, fired := list_append(s.a.fired, struct_pack(us := z.t, restart := false)))
    WHEN s.a.top >= 5 AND z.d <= 2 AND s.a.n >= 1 THEN struct_pack(armed := false, top := z.d, n := 0, fired := list_append(s.a.fired, struct_pack(us := z.t, restart := true)))
    ELSE struct_pack(armed := false, top := greatest(s.a.top, z.d), n := CASE WHEN s.a.top >= 5 AND z.d <= 2 THEN s.a.n + 1 ELSE 0 END, fired := s.a.fired) END)).a.fired AS fired FROM i)
SELECT station, x.us AS us, x.restart AS restart FROM (SELECT station, unnest(fired) AS x FROM f)"""


@query("token_trigger", TOKENS)
def token_trigger(spark, sf_dir):
    """Rising edges and restarts of tokens with a probability and a time since onset."""
    e = detections(spark, sf_dir).select("station", "event_id", "us", (F.col("value") % 100 / 100).alias("p"), (F.col("event_id") % 9).cast("double").alias("dt"))
    return fold.ordered_fold(e, ["station"], ["us", "event_id"], fold.token_trigger_step("us", "p", "dt", ["station"], level=0.5, release=0.3), "station bigint, us bigint, restart boolean")


GRID = rules.rule_grid(0.5, 0.3, (1, 2, 4), (5, 7), (1, 2))
#: Onsets that count are so far apart; an arrival is looked for from a little before to a while after it.
GATE, EARLY, LATE, LONG = 20 * HOUR, 3 * HOUR, 20 * HOUR, 60 * HOUR
_FIRED = "STRUCT(us BIGINT, onset BIGINT, restart BOOLEAN)[]"


def _fires(restart: str) -> str:
    onset = f"(z.t - (least(z.d, 10) * {HOUR})::BIGINT)"
    ok = f"{onset} - s.a.last >= {GATE}"
    return f"struct_pack(armed := false, top := z.d, n := 0, last := CASE WHEN {ok} THEN {onset} ELSE s.a.last END, fired := CASE WHEN {ok} THEN list_append(s.a.fired, struct_pack(us := z.t, onset := {onset}, restart := {restart})) ELSE s.a.fired END)"


def _stays(armed: str, top: str, n: str) -> str:
    return f"struct_pack(armed := {armed}, top := {top}, n := {n}, last := s.a.last, fired := s.a.fired)"


#: Each rule by itself as a fold of each station's list of tokens.
RULES = f"""WITH {DETECTIONS}, g AS (SELECT row_number() OVER (ORDER BY below, since, tokens) AS rule, * FROM (SELECT unnest([1, 2, 4]) AS below) CROSS JOIN (SELECT unnest([5, 7]) AS since) CROSS JOIN (SELECT unnest([1, 2]) AS tokens) UNION ALL SELECT 0, 0, 0, 1000000000),
k AS (SELECT station, us, event_id, value % 100 / 100 AS p, (event_id % 9)::DOUBLE AS d FROM e WHERE kind <> 'purchase'),
l AS (SELECT station, list(struct_pack(t := us, p := p, d := d) ORDER BY us, event_id) AS rows FROM k GROUP BY station),
i AS (SELECT rule, below, since, tokens, station, rows, struct_pack(armed := true, top := 0::DOUBLE, n := 0, last := -4611686018427387904::BIGINT, fired := []::{_FIRED}) AS a FROM l, g),
f AS (SELECT rule, station, list_reduce(list_prepend(struct_pack(t := 0::BIGINT, p := 0::DOUBLE, d := 0::DOUBLE, a := a), list_transform(rows, lambda z: struct_pack(t := z.t, p := z.p, d := z.d, a := a))),
  lambda s, z: struct_pack(t := z.t, p := z.p, d := z.d, a := CASE
    WHEN z.p < 0.3 THEN {_stays("true", "0::DOUBLE", "0")}
    WHEN z.p < 0.5 THEN {_stays("s.a.armed", "greatest(s.a.top, z.d)", "0")}
    WHEN s.a.armed THEN {_fires("false")}
    WHEN s.a.top >= since AND z.d <= below AND s.a.n + 1 >= tokens THEN {_fires("true")}
    ELSE {_stays("false", "greatest(s.a.top, z.d)", "CASE WHEN s.a.top >= since AND z.d <= below THEN s.a.n + 1 ELSE 0 END")} END)).a.fired AS fired FROM i),
r AS (SELECT rule, station, x.us AS us, x.onset AS onset, x.restart AS restart FROM (SELECT rule, station, unnest(fired) AS x FROM f))"""


def _ruled(spark, sf_dir):
    e = detections(spark, sf_dir)
    t = e.where("kind <> 'purchase'").select("station", "event_id", "us", (F.col("value") % 100 / 100).alias("p"), (F.col("event_id") % 9).cast("double").alias("dt"))
    a = e.where("kind = 'purchase'").select("station", F.col("event_id").alias("arrival"), F.col("us").alias("time"))
    return t, a, rules.rule_triggers(t, ["station"], "us", "p", "dt", ["event_id"], GRID, GATE, HOUR)


@query("rule_triggers", f"{RULES} SELECT rule::INT AS rule, station, us, onset, restart FROM r")
def rule_triggers(spark, sf_dir):
    """Triggers of thirteen token rules from one pass over each station's tokens."""
    return _ruled(spark, sf_dir)[2].select("rule", "station", "us", "onset", "restart")


@query(
    "rule_scores",
    f"""{RULES}, a AS (SELECT station, event_id AS arrival, us AS time FROM e WHERE kind = 'purchase'),
s AS (SELECT g.rule, EXISTS (SELECT 1 FROM r WHERE r.rule = g.rule AND r.station = a.station AND r.us BETWEEN a.time - {EARLY} AND a.time + {LATE}) AS hit, EXISTS (SELECT 1 FROM k WHERE k.station = a.station AND k.p >= 0.5 AND k.us BETWEEN a.time - {EARLY} AND a.time + {LATE}) AS reached FROM a, g),
o AS (SELECT rule, count(*) AS arrivals, count(*) FILTER (hit) AS detected, count(*) FILTER (NOT hit AND NOT reached) AS never_reached, count(*) FILTER (NOT hit AND reached) AS not_rearmed FROM s GROUP BY rule),
u AS (SELECT rule, count(*) AS triggers, count(*) FILTER (restart) AS restarts, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.station = r.station AND r.us BETWEEN a.time - {EARLY} AND a.time + {LONG})) AS unmatched FROM r GROUP BY rule)
SELECT g.rule::INT AS rule, coalesce(arrivals, 0) AS arrivals, coalesce(detected, 0) AS detected, coalesce(never_reached, 0) AS never_reached, coalesce(not_rearmed, 0) AS not_rearmed, coalesce(triggers, 0) AS triggers, coalesce(restarts, 0) AS restarts, coalesce(unmatched, 0) AS unmatched, (SELECT count(*) FROM k) AS tokens FROM g LEFT JOIN o USING (rule) LEFT JOIN u USING (rule)""",
)
def rule_scores(spark, sf_dir):
    """What thirteen token rules detect of the arrivals, what they miss and why, and their triggers that no arrival explains."""
    t, a, fired = _ruled(spark, sf_dir)
    fired = staged(fired, "rule-triggers")
    return rules.rule_scores(t, a, fired, "station", "us", "p", GRID, EARLY, LATE, LONG)


@query("scheduled_jobs", f"WITH {DETECTIONS} SELECT t.event_id, min(w.us) AS ran FROM e t LEFT JOIN e w ON w.station = t.station AND w.us >= t.us + {HOUR} WHERE t.kind = 'error' GROUP BY t.event_id")
def scheduled_jobs(spark, sf_dir):
    """Jobs that run when their station's data reach their end: the first row an hour or more after the trigger, however
    long it takes; an as-of join with the time line turned round."""
    e = detections(spark, sf_dir)
    t = e.where("kind = 'error'").select("event_id", "station", (-(F.col("us") + HOUR)).alias("due"))
    back = e.select("station", (-F.col("us")).alias("came"), F.col("us").alias("ran"))
    return ranges.asof_join(t, back, "due", "came", ["station"], ["ran"]).select("event_id", "ran")


@query("coda_absorption", f"WITH {DETECTIONS}, d AS (SELECT event_id, station, us FROM e WHERE kind = 'purchase'), x AS (SELECT e.event_id, e.us, e.value, d.event_id AS into_id, d.us AS at_us FROM (SELECT * FROM e WHERE kind <> 'purchase') e ASOF LEFT JOIN d ON e.station = d.station AND e.us >= d.us) SELECT event_id, CASE WHEN us - at_us <= {24 * HOUR} AND value < 150 THEN into_id END AS into_id FROM x")
def coda_absorption(spark, sf_dir):
    """Later detections of a station that join its last declared one within a span, unless they are strong restarts."""
    e = detections(spark, sf_dir)
    d = e.where("kind = 'purchase'").select("station", F.col("us").alias("at"), F.col("event_id").alias("into_id"))
    x = ranges.asof_join(e.where("kind <> 'purchase'").select("station", "event_id", "us", "value"), d, "us", "at", ["station"], ["at", "into_id"])
    return x.select("event_id", F.when((F.col("us") - F.col("at") <= 24 * HOUR) & (F.col("value") < 150), F.col("into_id")).alias("into_id"))


@query("emission_schedule", f"WITH {DETECTIONS}, r AS (SELECT t.event_id, t.us, (SELECT min(c.us) FROM e c WHERE c.station = t.station AND c.kind = 'click' AND c.us > t.us AND c.us <= t.us + {20 * HOUR}) AS release FROM e t WHERE t.kind = 'error') SELECT event_id, least(20, coalesce((release - us) // {HOUR}, 20)) AS emissions, release IS NOT NULL AS released FROM r")
def emission_schedule(spark, sf_dir):
    """How often an onset gives out its geometry: every hour until released, twenty times at most."""
    e = detections(spark, sf_dir)
    t = e.where("kind = 'error'").select("event_id", "station", (-F.col("us")).alias("at"))
    c = e.where("kind = 'click'").select("station", (-F.col("us")).alias("came"))
    r = ranges.asof_join(t, c, "at", "came", ["station"], ["came"], strict=True, tolerance=20 * HOUR)
    k = F.floor((F.col("at") - F.col("came")) / HOUR).cast("long")
    return r.select("event_id", F.least(F.lit(20), F.coalesce(k, F.lit(20))).cast("long").alias("emissions"), F.col("came").isNotNull().alias("released"))


@query("watermark_release", f"WITH {DETECTIONS}, m AS (SELECT min(last) AS until FROM (SELECT station % 10 AS channel, max(us) AS last FROM e GROUP BY 1)) SELECT count(*) FILTER (us < until) AS released, count(*) FILTER (us >= until) AS waiting, any_value(until) AS until FROM e, m")
def watermark_release(spark, sf_dir):
    """Messages before the time that every channel has reached, which may go on in order, and those that wait."""
    e = detections(spark, sf_dir)
    until = e.groupBy((F.col("station") % 10).alias("channel")).agg(F.max("us").alias("last")).agg(F.min("last").alias("until"))
    return e.join(F.broadcast(until)).groupBy("until").agg(F.count_if(F.col("us") < F.col("until")).alias("released"), F.count_if(F.col("us") >= F.col("until")).alias("waiting")).select("released", "waiting", "until")
