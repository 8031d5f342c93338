"""The final report of alarms against a catalogue, as lines, and the table of declared alarms, as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions.clock import hms
from tremolo.operators import stats
from tremolo.sources.shared import staged


def tenths(n: Column, of: Column) -> Column:
    """``n / of`` with one decimal, halves up, in whole numbers; a dash where ``of`` is 0 or null."""
    t = F.floor(F.try_divide(20 * n + of, 2 * of)).cast("long")
    return F.coalesce(F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")), F.lit("-"))


def _padded(name: str, *parts: Column) -> Column:
    return F.concat(F.lit(name.ljust(34)), *[F.lpad(p.cast("string"), 9, " ") for p in parts])


def scored(alarms: DataFrame, events: DataFrame) -> DataFrame:
    """Every event with the first alarm that matches it (null: missed): ``events`` with alarm, declared."""
    first = alarms.where("event is not null").groupBy("event").agg(F.min(F.struct("declared", "alarm")).alias("first"))
    return events.join(first, "event", "left").select(*events.columns, "first.alarm", "first.declared")


def lines(alarms: DataFrame, events: DataFrame, bands: list[float]) -> DataFrame:
    """Lines of the report: section, us and id (the order inside a section), line.

    ``alarms``: alarm, declared (us), stations, event (null: matches none); ``events``: event, us, size, km. Sections: 0
    counts with shares in per cent, 1 bands of size that hold events, 2 the alarms' median delay, 3 missed events, 4 alarms
    without an event. Sections 0 to 2 are aggregates; 3 and 4 hold a line a row and stay distributed. A null size is in
    no band and shown as a question mark. Both tables are written once and read for each section. Empty tables give the counts, 0 and a dash, and no delay.
    """
    alarms = staged(alarms, "report-alarms")
    s = staged(scored(alarms, events), "report-events")
    a = alarms.agg(F.count("*").alias("alarms"), F.count("event").alias("correct"))
    e = s.agg(F.count("*").alias("events"), F.count("alarm").alias("detected"))
    row = lambda n, name, v, of=None: F.struct(F.lit(n).cast("long").alias("us"), _padded(name, v, *([F.concat(tenths(100 * v, of), F.lit("%"))] if of is not None else [])).alias("line"))
    c = {x: F.col(x) for x in ("alarms", "correct", "events", "detected")}
    counts = F.array(
        row(0, "alarms", c["alarms"]), row(1, "correct (match an event)", c["correct"], c["alarms"]), row(2, "false (no event)", c["alarms"] - c["correct"], c["alarms"]),
        row(3, "events", c["events"]), row(4, "detected", c["detected"], c["events"]), row(5, "missed", c["events"] - c["detected"], c["events"]),
    )
    section = lambda df, n: df.select(F.lit(n).alias("section"), F.col("us").cast("long").alias("us"), F.col("id").cast("long").alias("id"), "line")
    zero = F.lit(0).alias("id")
    out = section(a.crossJoin(F.broadcast(e)).select(F.explode(counts).alias("r")).select("r.us", zero, "r.line"), 0)
    b = s.where("size is not null").groupBy(stats.bands(F.col("size"), bands).alias("us")).agg(F.count("*").alias("n"), F.count("alarm").alias("hit"))
    names = F.element_at(F.array(*[F.lit(x) for x in _names(bands)]), F.col("us") + 1)
    out = out.unionByName(section(b.select("us", zero, F.concat(F.rpad(names, 34, " "), *[F.lpad(x.cast("string"), 9, " ") for x in (F.col("n"), F.col("hit"), F.col("n") - F.col("hit"))]).alias("line")), 1))
    delays = s.where("alarm is not null").select((F.col("declared") - F.col("us")).alias("delay"))
    late = stats.interpolated_all(delays, "delay", {"median": 0.5}).where("median is not null")
    median = tenths(F.floor(F.col("median") / 1000 + 0.5).cast("long"), F.lit(1000))
    out = out.unionByName(section(late.select(F.lit(0).alias("us"), zero, F.concat(F.lit("alarm after the event, median"), F.lpad(median, 14, " "), F.lit(" s")).alias("line")), 2))
    size = _size()
    missed = s.where("alarm is null").select("us", F.col("event").alias("id"), F.concat(hms(F.col("us")), F.lit(" UTC"), F.lpad(size, 8, " "), F.lpad(F.coalesce(F.floor(F.col("km") + 0.5).cast("string"), F.lit("?")), 7, " "), F.lit(" km")).alias("line"))
    false = alarms.where("event is null").select(F.col("declared").alias("us"), F.col("alarm").alias("id"), F.concat(hms(F.col("declared")), F.lit(" UTC  #"), F.col("alarm").cast("string"), F.lit("  "), F.col("stations").cast("string"), F.lit(" stations")).alias("line"))
    return out.unionByName(section(missed, 3)).unionByName(section(false, 4))


def _size() -> Column:
    return F.when(F.col("size").isNotNull(), tenths(F.floor(F.col("size") * 10 + 0.5).cast("long"), F.lit(10))).otherwise("?")


def _names(bands: list[float]) -> list[str]:
    return [f"below {bands[0]:g}", *[f"{a:g} to {b:g}" for a, b in zip(bands, bands[1:])], f"{bands[-1]:g} and more"]


def write_lines(report: DataFrame, path: str, parts: int | None = None) -> None:
    """The lines in order as text: the files' names are in the order of their lines."""
    order = ["section", "us", "id", "line"]
    dealt = report.repartitionByRange(parts, *order) if parts else report.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("line").write.mode("errorifexists").text(path)


def declared_table(alarms: DataFrame, detections: DataFrame, events: DataFrame) -> DataFrame:
    """One row per declared alarm, as text for a CSV: alarm, alarm_utc, matched (size and time; empty: none), stations in
    the order of their detections, the first two with their difference in seconds (two decimals, empty: one station).

    ``detections``: alarm, station, us, one a station and at most some hundreds an alarm; ``alarms`` and ``events`` as in
    ``lines``. Alarms without detections have empty texts.
    """
    d = detections.where("us is not null").groupBy("alarm").agg(F.array_sort(F.collect_list(F.struct("us", "station"))).alias("seen"))
    e = events.select("event", F.col("us").alias("event_us"), "size")
    j = alarms.join(e, "event", "left").join(d, "alarm", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<us:bigint,station:bigint>>")))
    at = lambda k, c: F.get("seen", F.lit(k))[c]
    names = F.array_join(F.transform("seen", lambda x: x["station"].cast("string")), " ")
    return table_rows(j.select("alarm", "declared", "event_us", "size", names.alias("names"), at(0, "station").alias("a"), at(1, "station").alias("b"), (at(1, "us") - at(0, "us")).alias("apart")))


def table_rows(alarms: DataFrame) -> DataFrame:
    """The texts of ``declared_table`` from one row an alarm: alarm, declared, event_us and size (null: no event), names of
    its stations, the first two (a, b) and the microseconds between them."""
    hundredths = F.floor(F.col("apart") / 10_000 + 0.5).cast("long")
    difference = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    text = lambda x: F.coalesce(x, F.lit(""))
    return alarms.select(
        "alarm", F.date_format(F.timestamp_micros("declared"), "yyyy-MM-dd HH:mm:ss").alias("alarm_utc"), text(F.when(F.col("event_us").isNotNull(), F.concat(_size(), F.lit(" "), hms(F.col("event_us"))))).alias("matched"),
        F.col("names").alias("stations"), text(F.col("a").cast("string")).alias("station_a"), text(F.col("b").cast("string")).alias("station_b"), text(difference).alias("dt_s"),
    )
