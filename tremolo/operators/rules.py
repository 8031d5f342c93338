"""Many token-trigger rules in one pass: every key's tokens are read once, in order, and a vector of states, one for each
rule, goes along. What the rules' triggers are worth is then counted against known arrivals for all rules together."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.operators import fold, ranges

NEVER = 1 << 62


class Rule(NamedTuple):
    """``tokens`` None: rising edges only."""

    level: float = 0.5
    release: float = 0.25
    below: float = 2.0
    since: float = 5.0
    tokens: int | None = 2


def rule_grid(level: float, release: float | None, below: Iterable[float], since: Iterable[float], tokens: Iterable[int]) -> list[Rule]:
    """Rising edges only, then every combination; without ``release`` it is half the level."""
    low = level / 2 if release is None else release
    return [Rule(level, low, 0.0, 0.0, None), *(Rule(level, low, *x) for x in itertools.product(below, since, tokens))]


def rule_step(at: str, p: str, dt: str, on: list[str], rules: list[Rule], gate: int, unit: int, reach: float = 10.0, warm: str | None = None):
    """The step of ``token_trigger_step`` for each of ``rules``. A trigger dates its onset ``dt`` (``reach`` at most, in
    ``unit`` of ``at``) before the token, and counts if that is ``gate`` or more after the onset that counted before.
    Where the column ``warm`` is true states go on and nothing fires. Rows without ``p`` or ``dt`` are passed over."""
    level, release, below, since = (np.array([r[k] for r in rules], float) for k in range(4))
    need = np.array([NEVER if r.tokens is None else r.tokens for r in rules], np.int64)
    least, names = release.min(), [*on, at, "onset", "rule", "restart"]

    def step(state, rows):
        armed, top, count, last = state or (np.ones(len(rules), bool), np.zeros(len(rules)), np.zeros(len(rules), np.int64), np.full(len(rules), -NEVER))
        out = []
        quiet = rows[warm].tolist() if warm else [False] * len(rows)
        for key, t, q, d, silent in zip(zip(*[rows[c] for c in on]), rows[at].tolist(), rows[p].tolist(), rows[dt].tolist(), quiet):
            if q is None or d is None or q != q or d != d:
                continue
            if q < least:  # all rules let go
                armed, top, count = np.ones_like(armed), np.zeros_like(top), np.zeros_like(count)
                continue
            high, off = q >= level, q < release
            low = high & ~armed & (top >= since) & (d <= below)
            count = np.where(low, count + 1, 0)
            again = low & (count >= need)
            fires = (high & armed) | again
            top = np.where(off, 0.0, np.where(fires, d, np.maximum(top, d)))
            count, armed = np.where(fires, 0, count), ~high & (armed | off)
            if not silent and fires.any():
                onset = t - int(min(d, reach) * unit)
                good = fires & (onset - last >= gate)
                last = np.where(good, onset, last)
                out += [(*key, t, onset, r, bool(again[r])) for r in np.flatnonzero(good).tolist()]
        return (armed, top, count, last), pd.DataFrame(out, columns=names) if out else None

    return step


def rule_triggers(tokens: DataFrame, on: list[str], at: str, p: str, dt: str, order: list[str], rules: list[Rule], gate: int, unit: int, **more) -> DataFrame:
    """Triggers of every rule: ``on``, ``at``, onset, rule (its place in ``rules``) and restart."""
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), f"`{at}` bigint", "onset bigint", "rule int", "restart boolean"])
    return fold.ordered_fold(tokens, on, [at, *order], rule_step(at, p, dt, on, rules, gate, unit, **more), schema)


def rule_scores(tokens: DataFrame, arrivals: DataFrame, fired: DataFrame, station: str, at: str, p: str, rules: list[Rule], early: int, late: int, long: int) -> DataFrame:
    """One row a rule: tokens, arrivals, detected (a trigger from ``early`` before to ``late`` after), never_reached (no token
    there at the rule's level), not_rearmed (the others), triggers, restarts, and unmatched (triggers with no arrival up
    to ``early`` later or ``long`` before).

    ``arrivals`` has ``station``, arrival (their key) and time. As-of joins look at one neighbour each, so crowded spans make
    no pairs; arrivals are repeated for each rule, whose number is fixed. Rules without triggers and stations without
    arrivals or tokens count too; null times are never met."""
    r = tokens.sparkSession.createDataFrame([(i, float(x.level)) for i, x in enumerate(rules)], "rule int, level double")
    a = arrivals.select(station, "arrival", "time")
    each = a.withColumn("rule", F.explode(F.array(*[F.lit(i) for i in range(len(rules))]))).withColumn("until", F.col("time") + late)
    met = ranges.asof_join(each, fired.select(station, "rule", F.col(at).alias("met")), "until", "met", [station, "rule"], ["met"], tolerance=early + late)
    spans = a.select(station, "arrival", (F.col("time") - early).alias("lo"), (F.col("time") + late).alias("hi"))
    near = ranges.range_join(tokens.select(station, F.col(at).alias("__t"), p), spans, "__t", "lo", "hi", early + late, [station])
    top = near.groupBy("arrival").agg(F.max(p).alias("top"))
    seen = met.join(top, "arrival", "left").join(F.broadcast(r), "rule")
    hit, reached = F.col("met").isNotNull(), F.coalesce(F.col("top") >= F.col("level"), F.lit(False))
    o = seen.groupBy("rule").agg(F.count("*").alias("arrivals"), F.count_if(hit).alias("detected"), F.count_if(~hit & ~reached).alias("never_reached"), F.count_if(~hit & reached).alias("not_rearmed"))
    known = ranges.asof_join(fired.select(station, "rule", "restart", (F.col(at) + early).alias("until")), a.where("time is not null").select(station, "time"), "until", "time", [station], ["time"], tolerance=early + long)
    u = known.groupBy("rule").agg(F.count("*").alias("triggers"), F.count_if("restart").alias("restarts"), F.count_if(F.col("time").isNull()).alias("unmatched"))
    n = tokens.agg(F.count("*").alias("tokens"))
    return r.join(o, "rule", "left").join(u, "rule", "left").fillna(0).crossJoin(F.broadcast(n)).drop("level")
