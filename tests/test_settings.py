"""Choices among settings against plain lists, with ties, zeros, nulls and nothing to choose from."""

import math
import random
from fractions import Fraction

import pytest

from tremolo.operators import settings


def _plain_pick(x, cands):
    """(setting, count, flag, tie) of the rule by ratio; cands are (place, setting, count) in order of place."""
    pos = [c for c in cands if c[2] > 0]
    if x == 0 or not pos:
        d = [abs(x - c[2]) for c in cands]
        c = cands[d.index(min(d))]
        return c[1], c[2], "zero count", d.count(min(d)) > 1
    d = [abs(math.log(x / c[2])) for c in pos]
    near = [c for c, v in zip(pos, d) if v - min(d) < 1e-12]
    r = x / near[0][2]
    return near[0][1], near[0][2], "matched" if 0.8 <= r <= 1.25 else f"not matched (ratio {float(round(Fraction(x, near[0][2]), 2)):.2f})", len(near) > 1


def _plain_bracket(x, cands):
    below, above = [c for c in cands if c[2] < x], [c for c in cands if c[2] > x]
    if not below or not above:
        return []
    b, a = [c for c in below if c[2] == max(c[2] for c in below)], [c for c in above if c[2] == min(c[2] for c in above)]
    return [("bracket_below", b[0][1], b[0][2], "bracket", len(b) > 1), ("bracket_above", a[-1][1], a[-1][2], "bracket", len(a) > 1)]


@pytest.mark.parametrize("seed", range(4))
def test_matched(spark, seed):
    draw = random.Random(seed)
    top = (3, 12, 60, 400)[seed]
    other = {(n, f): [(p, f"{f}{p:02d}", 0 if f == "zero" else draw.choice((draw.randrange(top), 2, 8))) for p in draw.sample(range(40), 15)] for n in "xy" for f in ("a", "b", "zero")}
    rows = [(n, f, p, s, c) for (n, f), cs in other.items() for p, s, c in cs] + [("x", "a", 99, "none", None)]
    mine = [(n, f"l{i}", draw.choice((0, 4, draw.randrange(top * 2)))) for n in "xy" for i in range(12)]
    a = spark.createDataFrame([*mine, ("x", "null", None), ("nowhere", "l", 3)], "net string, learned string, alarms bigint")
    b = spark.createDataFrame(rows, "net string, family string, place int, setting string, alarms bigint")
    got = sorted((r.net, r.learned, r.family, r.rule, r.setting, r["count"], r.flag, r.tie) for r in settings.matched(a, b, ["net"], "alarms", "ratio", bracket=True).collect())
    want = []
    for n, name, x in mine:
        for f in ("a", "b", "zero"):
            cands = sorted(other[n, f])
            want += [(n, name, f, "ratio", *_plain_pick(x, cands)), *((n, name, f, *r) for r in _plain_bracket(x, cands))]
    assert got == sorted(want)
    assert settings.matched(a.limit(0), b, ["net"], "alarms", "ratio").count() == settings.matched(a, b.limit(0), ["net"], "alarms", "ratio", True).count() == 0


def test_choices(spark):
    draw = random.Random(8)
    rows = [(s, f"{s}{i}", draw.randrange(5) / 4, float(draw.randrange(8)), draw.randrange(6), draw.choice((None, 0, 1, 2, 9))) for s in ("a", "b", "c") for i in range(20)]
    rows += [("noisy", "n0", 1.0, 99.0, 50, None)]
    df = spark.createDataFrame(rows, "source string, setting string, level double, corrected double, unmatched bigint, quiet bigint")
    got = {(r.rule, r.source if r.rule == "best_of_source" else None): r.setting for r in settings.choices(df, 3, 5.0, 1).collect()}
    few = [r for r in rows if r[4] <= 3]
    least = lambda some, key: min(some, key=lambda r: (*key(r), r[0], r[1]))[1] if some else None
    want = {("equal_unmatched", None): least(few, lambda r: (-r[3], r[4], -r[2])), ("equal_detections", None): least([r for r in rows if r[3] >= 5], lambda r: (r[4], -r[3]))}
    want["equal_quiet", None] = least([r for r in rows if r[5] is not None and r[5] <= 1], lambda r: (-r[3], r[5], r[4]))
    want |= {("best_of_source", s): least([r for r in few if r[0] == s], lambda r: (-r[3], r[4])) for s in ("a", "b", "c", "noisy")}
    assert got == want and got["best_of_source", "noisy"] is None
    none = settings.choices(df, -1, 1000.0).collect()
    assert len(none) == 2 + 4 and all(r.setting is None for r in none)
    assert [(r.rule, r.setting) for r in settings.choices(df.limit(0), 3, 5.0).orderBy("rule").collect()] == [("equal_detections", None), ("equal_unmatched", None)]
