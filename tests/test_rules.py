"""Rule grids against each rule alone in a plain loop, and their scores against comparing everything with everything."""

import random

import pandas as pd
import pytest

from tremolo.operators import fold, rules

GRID = [*rules.rule_grid(0.5, None, (1, 3), (5, 7), (1, 2, 3)), rules.Rule(0.6, 0.1, 2, 5, 1), rules.Rule(0.3, 0.3, 2, 5, 2)]


def plain(tokens, rule, gate, unit, reach=10.0):
    """(time, onset, restart) of one rule over (time, p, dt, warm)."""
    fired, armed, top, low, last = [], True, 0.0, 0, None
    for t, p, dt, warm in tokens:
        if p is None or dt is None:
            continue
        kind = None
        if p < rule.release:
            armed, top, low = True, 0.0, 0
        elif p < rule.level:
            top, low = max(top, dt), 0
        else:
            if armed:
                kind = "rising"
            elif rule.tokens is not None and top >= rule.since and dt <= rule.below:
                low += 1
                kind = "restart" if low >= rule.tokens else None
            else:
                low = 0
            armed = False
            if kind:
                top, low = dt, 0
                onset = t - int(min(dt, reach) * unit)
                if not warm and (last is None or onset - last >= gate):
                    last = onset
                    fired.append((t, onset, kind == "restart"))
            else:
                top = max(top, dt)
    return fired


def drawn(seed, n=400):
    draw = random.Random(seed)
    return [(100 * i + draw.choice((0, 0, 37)), None if draw.random() < 0.02 else draw.choice((0.0, 0.1, 0.2, 0.25, 0.3, 0.5, 0.55, 0.6, 0.9, 1.0)[draw.choice((0, 4)) :]), None if draw.random() < 0.02 else draw.randrange(0, 12) / draw.choice((1, 2)), i < 20) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_every_rule_alone(seed):
    tokens, gate = drawn(seed), (0, 350, 900)[seed % 3]
    frame = pd.DataFrame([("a", *x) for x in tokens], columns=["station", "at", "p", "dt", "warm"])
    state, out = None, []
    step = rules.rule_step("at", "p", "dt", ["station"], GRID, gate, 30, warm="warm")
    for low in range(0, len(frame), 61):  # a stream's micro-batches
        state, some = step(state, frame.iloc[low : low + 61])
        out.append(some)
    got = pd.concat([x for x in out if x is not None])
    for i, rule in enumerate(GRID):
        mine = got[got["rule"] == i]
        assert list(zip(mine["at"], mine["onset"], mine["restart"])) == plain(tokens, rule, gate, 30), rule
    assert got["restart"].any() and not got["restart"].all()


def test_one_rule_is_the_token_trigger():
    tokens = [(t, p, d, False) for t, p, d, _ in drawn(9) if p is not None and d is not None]
    frame = pd.DataFrame([("a", *x) for x in tokens], columns=["station", "at", "p", "dt", "warm"])
    one = fold.token_trigger_step("at", "p", "dt", ["station"], level=0.5, release=0.3)(None, frame)[1]
    many = rules.rule_step("at", "p", "dt", ["station"], [rules.Rule(0.5, 0.3, 2.0, 5.0, 2)], -rules.NEVER, 1)(None, frame)[1]
    assert list(zip(one["at"], one["restart"])) == list(zip(many["at"], many["restart"]))


def test_scores(spark):
    draw = random.Random(4)
    tokens = [(s, *x[:3]) for s in ("a", "b", "c", None) for x in drawn(ord(s) if s else 1, 150)]
    arrivals = [(s, k, draw.randrange(-3000, 18_000)) for k, s in enumerate(["a"] * 25 + ["b"] * 9 + ["nowhere"] * 2)]
    arrivals += [("a", 90, arrivals[0][2]), ("b", 91, None)]
    t = spark.createDataFrame(tokens, "station string, at bigint, p double, dt double")
    a = spark.createDataFrame(arrivals, "station string, arrival bigint, time bigint")
    t = t.where("station is not null")
    fired = rules.rule_triggers(t, ["station"], "at", "p", "dt", ["p", "dt"], GRID, 300, 30)
    got = {r.rule: r.asDict() for r in rules.rule_scores(t, a, fired, "station", "at", "p", GRID, 300, 2000, 6000).collect()}
    trig = [tuple(r) for r in fired.select("rule", "station", "at", "restart").collect()]
    rows = [x for x in tokens if x[0]]
    for i, rule in enumerate(GRID):
        mine = [x for x in trig if x[0] == i]
        inside = lambda s, x, late, z: z is not None and s[0] == s[1] and z - 300 <= x <= z + late
        hit = [any(inside((s, m[1]), m[2], 2000, z) for m in mine) for s, _, z in arrivals]
        reached = [any(x[2] is not None and x[2] >= rule.level and inside((s, x[0]), x[1], 2000, z) for x in rows) for s, _, z in arrivals]
        want = {
            "rule": i, "tokens": len(rows), "arrivals": len(arrivals), "detected": sum(hit), "never_reached": sum(not h and not r for h, r in zip(hit, reached)), "not_rearmed": sum(not h and r for h, r in zip(hit, reached)),
            "triggers": len(mine), "restarts": sum(m[3] for m in mine), "unmatched": sum(not any(inside((s, m[1]), m[2], 6000, z) for s, _, z in arrivals) for m in mine),
        }
        assert got[i] == want, rule
    none = rules.rule_scores(t.limit(0), a, fired.limit(0), "station", "at", "p", GRID[:2], 300, 2000, 6000).collect()
    assert [(r.tokens, r.arrivals, r.detected, r.never_reached, r.triggers) for r in sorted(none)] == [(0, len(arrivals), 0, len(arrivals), 0)] * 2
    assert all(r.arrivals == 0 and r.unmatched == r.triggers > 0 for r in rules.rule_scores(t, a.limit(0), fired, "station", "at", "p", GRID[:2], 300, 2000, 6000).collect())
