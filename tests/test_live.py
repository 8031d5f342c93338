"""Folds against plain loops, in one piece and cut into batches; the reorder buffer's properties; null keys."""

import numpy as np
import pandas as pd
import pytest

from tremolo.operators import fold, parts
from tremolo.streaming import buffer, folds


@pytest.mark.parametrize("patience, most", [(0, 1000), (30, 1000), (100, 3), (10_000, 1000)])
def test_reorder_tiles_the_axis(patience, most):
    rng = np.random.default_rng(patience + most)
    spans = [(k * 10, k * 10 + int(rng.integers(8, 13)), k) for k in range(200) if rng.random() > 0.1]
    spans.sort(key=lambda s: s[0] + int(rng.integers(0, 60)))
    buffer = fold.Reorder(patience, most)
    out = [x for lo, hi, k in spans for x in buffer.offer(lo, hi, k)] + buffer.flush()
    run = [x for x in out if x[0] != "stale"]
    assert all(a[3] == b[2] for a, b in zip(run, run[1:]))  # data and gaps follow each other without a hole
    assert sorted(x[1] for x in out if x[0] != "gap") == sorted(k for _, _, k in spans)  # nothing is lost
    assert sum(x[0] == "gap" for x in out) == buffer.stats["gaps"] and (most > 3 or buffer.stats["forced"])
    assert buffer.stats["missing"] == sum(x[3] - x[2] for x in out if x[0] == "gap") and buffer.stats["records"] == len(spans)
    if patience == 10_000:
        held = sorted(spans)
        assert not buffer.stats["stale"] or held  # everything waits until it can be put in order
        assert [x[1] for x in run if x[0] == "data"] == [k for _, _, k in held if any(x[1] == k and x[0] == "data" for x in out)]


def test_reorder_batches(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if k % 2 else "b", k, k * 5, k * 5 + 5, k * 5 + int(rng.integers(0, 40))) for k in range(300)]
    df = spark.createDataFrame(rows, "ch string, id long, lo long, hi long, arrival long")
    step, end = fold.reorder_steps("ch", "lo", "hi", "id", 50)
    got = sorted((r.ch, r.released, r.id or -1, r.lo, r.hi) for r in fold.ordered_fold(df, ["ch"], ["arrival", "id"], step, f"ch string, {fold.RELEASED}", end).collect())
    want = []
    for ch in "ab":
        buffer = fold.Reorder(50, 1000)
        for _, k, lo, hi, _ in sorted((r for r in rows if r[0] == ch), key=lambda r: (r[4], r[1])):
            want += [(ch, x[0], x[1] if x[1] is not None else -1, x[2], x[3]) for x in buffer.offer(lo, hi, k)]
        want += [(ch, x[0], x[1] if x[1] is not None else -1, x[2], x[3]) for x in buffer.flush()]
    assert got == sorted((c, r, k or -1, lo, hi) for c, r, k, lo, hi in want)


def test_null_key_is_one_key_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(None, t) for t in range(0, 100, 3)] + [(1, t) for t in range(0, 100, 3)], "k long, t long")
        got = fold.greedy_min_gap(df, "t", 10, ["k"], ["k", "t"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [0, 12, 24, 36, 48, 60, 72, 84, 96]
    assert sorted(got[got.k.isna()].t) == want and sorted(got[got.k == 1].t) == want


def test_dedup_lets_a_restart_in():
    step = fold.live_dedup_step("n", "t", ["n", "t"])
    rows = pd.DataFrame({"n": [5, 6, 6, 5, 8, 1, 2, 2, (1 << 24) - 1], "t": [10, 20, 20, 10, 30, 40, 50, 45, 48]})
    _, kept = step(None, rows)
    assert kept.values.tolist() == [[5, 10], [6, 20], [8, 30], [1, 40], [2, 50]]
    state, a = step(None, rows.iloc[:4])
    _, b = step(state, rows.iloc[4:])
    assert pd.concat([a, b]).values.tolist() == kept.values.tolist()


def test_token_trigger():
    step = fold.token_trigger_step("t", "p", "dt", ["k"])
    p = [0.1, 0.5, 0.6, 0.7, 0.5, 0.5, 0.2, 0.9, 0.9]
    dt = [0, 0, 3, 6, 1, 1, 0, 0, 1]
    _, out = step(None, pd.DataFrame({"k": 1, "t": range(9), "p": p, "dt": dt}))
    assert out[["t", "restart"]].values.tolist() == [[1, False], [5, True], [7, False]]


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    for part in range(6):
        t = np.sort(rng.integers(part * 1000, part * 1000 + 1000, 80))
        spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 3, 80), "t": t})).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    step = lambda: fold.min_gap_step("t", 40, ["k", "t"])
    s = folds.stateful(folds.stream_table(spark, f"{tmp_path}/in/*", 1), ["k"], ["t"], step(), "k bigint, t bigint")
    rows = spark.read.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, fold.ordered_fold(rows, ["k"], ["t"], step(), "k bigint, t bigint").collect()))
    assert sorted(map(tuple, folds.drained(s, spark, "test").collect())) == want


def fronts_by_definition(spans, patience):
    """Front after each span, from all spans so far: the end of what hangs together with the spans that have been waited
    for; and which spans were behind the front when they came."""
    fronts, stale, front = [], [], None
    for i, (_, hi, key) in enumerate(spans):
        if front is not None and hi <= front:
            stale.append(key)
        seen = max(h for _, h, _ in spans[: i + 1])
        for lo, h, _ in sorted(spans[: i + 1]):
            if seen - lo > patience or (front is not None and lo <= front):
                front = h if front is None else max(front, h)
        fronts.append(front)
    return fronts, stale


@pytest.mark.parametrize("patience", [0, 1, 25, 100, 1000])
def test_reorder_waits_from_the_end_of_the_hole(patience):
    rng = np.random.default_rng(patience)
    for _ in range(20):
        spans = [(int(k * 10 + rng.integers(0, 4)), int(k * 10 + rng.integers(5, 25)), k) for k in range(40) if rng.random() > 0.2]
        spans.sort(key=lambda s: s[0] + int(rng.integers(0, 80)))
        buffer, fronts, stale = fold.Reorder(patience), [], []
        for lo, hi, k in spans:
            out = buffer.offer(lo, hi, k)
            stale += [k] if [x[:2] for x in out] == [("stale", k)] and (buffer.front or 0) >= hi else []
            fronts.append(buffer.front)
        want, behind = fronts_by_definition(spans, patience)
        assert fronts == want and set(behind) <= set(stale)


def test_reorder_counterexamples():
    b = fold.Reorder(100)
    assert b.offer(0, 50, 1) == [] and b.offer(200, 250, 2) == [("data", 1, 0, 50, False)]  # the hole's end is 50 behind
    assert b.offer(250, 301, 3) == [("gap", None, 50, 200, False), ("data", 2, 200, 250, False), ("data", 3, 250, 301, False)]
    b = fold.Reorder(100)
    assert b.offer(50, 100, 1) == [] and b.offer(0, 50, 2) == []  # the first to arrive is not the first
    assert b.offer(100, 101, 3) == [("data", 2, 0, 50, False), ("data", 1, 50, 100, False), ("data", 3, 100, 101, False)]
    b = fold.Reorder(1000, most=2)
    out = b.offer(0, 10, 1) + b.offer(20, 30, 2) + b.offer(40, 50, 3) + b.offer(60, 70, 4)
    assert out == [("data", 1, 0, 10, False), ("gap", None, 10, 20, True), ("data", 2, 20, 30, False)] and b.stats["forced"] == 1
    b = fold.Reorder(1000, idle=5)
    assert b.offer(0, 10, 1, 0) == [] and b.offer(None, None, None, 5) == [] and b.offer(None, None, None, 11) == [("data", 1, 0, 10, False)]
    assert b.offer(5, 5, 9, 12) == [] and b.offer(3, 12, 2, 13) == [("data", 2, 10, 12, False)] and b.stats["trimmed"] == 7


def test_parts_of_a_key_fold_like_the_whole(spark):
    rng = np.random.default_rng(5)
    starts = np.cumsum(rng.choice([10, 12, 30, 400], 600, p=[0.5, 0.2, 0.25, 0.05]))
    data = [("a" if k % 3 else None, k, int(t), int(t + rng.integers(5, 20)), int(t + rng.integers(0, 60))) for k, t in enumerate(starts)]
    df = spark.createDataFrame(data, "ch string, id long, lo long, hi long, arrival long")
    steps = fold.reorder_steps("ch", "lo", "hi", "id", 50)
    schema = f"ch string, {fold.RELEASED}"
    whole = sorted(map(str, fold.ordered_fold(df, ["ch"], ["arrival", "id"], steps[0], schema, steps[1]).collect()))
    for width in (7, 100, 100_000):
        cut = parts.time_parts(df, ["ch"], "arrival", "lo", "hi", 50, width)
        assert cut.select("ch", "part").distinct().count() == 2 if width == 100_000 else cut.select("part").distinct().count() > 5
        step, end = fold.reorder_steps("ch", "lo", "hi", "id", 50, front="before")
        assert sorted(map(str, fold.ordered_fold(cut, ["ch", "part"], ["arrival", "id"], step, schema, end).collect())) == whole
    gap = fold.min_gap_step("lo", 50, ["ch", "lo"])
    cut = parts.time_parts(df, ["ch"], "lo", "lo", "lo", 50, 20)
    assert sorted(map(str, fold.ordered_fold(cut, ["ch", "part"], ["lo"], gap, "ch string, lo long").collect())) == sorted(map(str, fold.ordered_fold(df, ["ch"], ["lo"], gap, "ch string, lo long").collect()))
    assert parts.time_parts(df.where("false"), ["ch"], "arrival", "lo", "hi", 50, 7).count() == 0


def test_reorder_on_a_stream_is_that_of_the_batch(spark):
    rng = np.random.default_rng(8)
    data = [(f"c{k % 3}" if k % 3 else None, k, k * 7 + 3, k * 7 + 3 + int(rng.integers(4, 10)), (k * 7 + int(rng.integers(0, 90))) * 1_000_000 + (40_000_000_000 if k > 150 else 0)) for k in range(300)]
    data = [(c, k, lo * 1_000_000, hi * 1_000_000, at) for c, k, lo, hi, at in data]
    df = spark.createDataFrame(data, "ch string, id long, lo long, hi long, arrival long")
    step, end = fold.reorder_steps("ch", "lo", "hi", "id", 60_000_000, at="arrival", idle=3_600_000_000)
    want = sorted(map(str, fold.ordered_fold(df, ["ch"], ["arrival", "id"], step, f"ch string, {fold.RELEASED}", end).collect()))
    close = spark.createDataFrame([(c, None, None, None, 90_000_000_000) for c in (None, "c1", "c2")], df.schema)
    for pieces in (1, 5):
        s = buffer.reorder_stream(folds.replayed(df, "arrival", pieces, "test", close), ["ch"], 60_000_000, 3_600_000_000)
        assert sorted(map(str, folds.drained(s, spark, "test").collect())) == want


def test_token_trigger_between_release_and_level():
    step = fold.token_trigger_step("t", "p", "dt", ["k"], level=0.5, release=0.3)
    for p, dt, want in (
        ([0.6, 0.4, 0.6, 0.6], [0, 6, 1, 1], [[0, False], [3, True]]),  # the peak between them counts
        ([0.6, 0.6, 0.6, 0.4, 0.6, 0.6], [0, 6, 1, 1, 1, 1], [[0, False], [5, True]]),  # and the sequence is broken
        ([0.4, 0.4, 0.2, 0.5], [9, 9, 0, 0], [[3, False]]),
    ):
        _, out = step(None, pd.DataFrame({"k": 1, "t": range(len(p)), "p": p, "dt": dt}))
        assert out[["t", "restart"]].values.tolist() == want


def test_restarts_are_known_by_channel():
    step = fold.live_dedup_step("n", "t", ["n", "t"], channel="c")
    rows = pd.DataFrame({"n": [5, 6, 2, 3, 1, 1], "t": [100, 10, 50, 60, 70, 65], "c": list("ababba")})
    _, kept = step(None, rows)
    assert kept.values.tolist() == [[5, 100], [6, 10], [3, 60], [1, 70]]
