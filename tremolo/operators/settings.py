"""Choosing among the settings of detectors: the best under each of several rules, and of other detectors those that
raise as many alarms as a given one. Candidates are found by aggregates and as-of joins over counts, not by pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.operators import ranges

#: Ratios of counts that are called matched.
LOW, HIGH = 0.8, 1.25


def choices(settings: DataFrame, unmatched: float, corrected: float, quiet: float | None = None) -> DataFrame:
    """One row a rule over all sources, and one a source: rule, source, and the chosen setting, level, corrected, unmatched, quiet.

    ``equal_unmatched``: most corrected detections with ``unmatched`` alarms or fewer, then fewer alarms, then the higher
    level. ``equal_detections``: fewest alarms with ``corrected`` or more, then more detections. ``equal_quiet`` (only with
    ``quiet``): most detections with that many quiet alarms or fewer, then fewer quiet ones, then fewer alarms; settings
    without a quiet count take no part. ``best_of_source``: as the first, without level. What is still equal goes to the
    lesser source and setting; a rule that nothing satisfies has nulls.
    """
    c, u, q = F.col("corrected"), F.col("unmatched"), F.col("quiet")
    row = F.struct("source", "setting", "level", "corrected", "unmatched", "quiet")
    when = lambda ok, *key: F.when(ok, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], row.alias("row")))
    rules = {"equal_unmatched": when(u <= unmatched, -c, u, -F.col("level")), "equal_detections": when(c >= corrected, u, -c)}
    if quiet is not None:
        rules["equal_quiet"] = when(q <= quiet, -c, q, u)
    per = settings.groupBy("source").agg(F.min(when(u <= unmatched, -c, u)).alias("best_of_source"), *[F.min(k).alias(n) for n, k in rules.items()])
    rest = ["setting", "level", "corrected", "unmatched", "quiet"]
    own = per.select(F.lit("best_of_source").alias("rule"), "source", *[F.col(f"best_of_source.row.{x}").alias(x) for x in rest])
    every = per.agg(*[F.min(n).alias(n) for n in rules])
    every = every.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}.row").alias("row")) for n in rules])).alias("r")).select("r.rule", "r.row.*")
    return every.unionByName(own)


def _flag(wanted: Column, count: Column) -> Column:
    ratio = wanted / count
    return F.when(ratio.between(LOW, HIGH), F.lit("matched")).otherwise(F.format_string("not matched (ratio %.2f)", F.rint(wanted * 100 / count) / 100))


def matched(learned: DataFrame, others: DataFrame, on: list[str], count: str, rule: str, bracket: bool = False) -> DataFrame:
    """For each row of ``learned`` (``on``, learned, ``count``) and each family of ``others`` (``on``, family, place, setting,
    ``count``; place is unique in a family and gives the order) the setting whose count is closest by ratio.

    Returns ``on``, learned, family, rule, setting, count, flag, tie. Flags: ``matched``, ``not matched (ratio r)``, halves to even; where the row's
    count is 0, or all counts of the family are, the closest by difference, ``zero count``. Equal distances go to the first
    place, and are ties. With ``bracket`` also the settings next below and above in count, where both exist: of equal
    counts the first place below and the last above. Rows without a count take no part.
    """
    keys = [*on, "family"]
    known = others.where(F.col(count).isNotNull())
    levels = known.groupBy(*keys, F.col(count).cast("long").alias("n")).agg(F.min(F.struct("place", "setting")).alias("first"), F.max(F.struct("place", "setting")).alias("final"), (F.count("*") > 1).alias("many"))
    mine = learned.select(*on, "learned", F.col(count).cast("long").alias("wanted")).where("wanted is not null").join(known.select(*keys).distinct(), on)
    own = levels.select(*keys, F.col("n").alias("wanted"), F.struct("n", "first", "final", "many").alias("same"))
    below = levels.select(*keys, F.col("n").alias("under"), F.struct("n", "first", "final", "many").alias("below"))
    above = levels.select(*keys, (-F.col("n")).alias("over"), F.struct("n", "first", "final", "many").alias("above"))
    x = mine.join(own, [*keys, "wanted"], "left")
    x = ranges.asof_join(x, below, "wanted", "under", keys, ["below"], strict=True)
    x = ranges.asof_join(x.withColumn("back", -F.col("wanted")), above, "back", "over", keys, ["above"], strict=True)
    w = F.col("wanted")
    low = F.when(F.col("below.n") > 0, F.log(w / F.col("below.n")))
    high = F.when(F.col("above").isNotNull(), F.log(F.col("above.n") / w))
    level = F.abs(low - high) < 1e-12
    near = F.when(level, F.when(F.col("below.first.place") < F.col("above.first.place"), F.col("below")).otherwise(F.col("above"))).when(high.isNull() | (low < high), F.col("below")).otherwise(F.col("above"))
    none = (w == 0) | (F.col("same").isNull() & F.coalesce(F.col("below.n") == 0, F.lit(True)) & F.col("above").isNull())
    pick = F.coalesce(F.col("same"), F.when(none, F.coalesce("below", "above")).otherwise(near))
    tie = F.col("pick.many") | (F.col("same").isNull() & ~none & F.coalesce(level, F.lit(False)))
    out = [*keys[:-1], "learned", "family"]
    x = x.withColumn("pick", pick)
    best = x.select(*out, F.lit(rule).alias("rule"), F.col("pick.first.setting").alias("setting"), F.col("pick.n").alias("count"), F.when(none, F.lit("zero count")).otherwise(_flag(w, F.col("pick.n"))).alias("flag"), tie.alias("tie"))
    if not bracket:
        return best
    side = lambda name, end: F.struct(F.lit(f"bracket_{name}").alias("rule"), F.col(f"{name}.{end}.setting").alias("setting"), F.col(f"{name}.n").alias("count"), F.lit("bracket").alias("flag"), F.col(f"{name}.many").alias("tie"))
    both = x.where("below is not null and above is not null").select(*out, F.explode(F.array(side("below", "first"), side("above", "final"))).alias("r"))
    return best.unionByName(both.select(*out, "r.*"))
