"""Ordered folds per key: what depends on earlier decisions and so is no window function.

A fold keeps a small state per key, sees the key's rows in order and returns rows. Batch and streaming use the same
step function (see :mod:`tremolo.streaming.folds`), so both give the same rows. Rows of a key are sorted by Spark and
fed in Arrow batches; nothing else of a key is held in memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(
    df: DataFrame, on: list[str], order: list[str], step: Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame | None]], schema: str, end: Callable[[tuple, Any], pd.DataFrame | None] | None = None, dealt: bool = False
) -> DataFrame:
    """``step(state, rows)`` for the rows of each key in order, ``state`` None at first; returns state and output.
    ``end(key, state)`` gives what is left when a key has no more rows.

    Keys are clustered by one shuffle and rows sorted inside partitions, so that a key may be longer than memory. With
    ``dealt`` all shuffle partitions stay tasks of their own: for few bytes that are much work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            for k, part in rows.groupby(on, sort=False, dropna=False):
                k = tuple(None if pd.isna(x) else x for x in k)  # a null key is equal to itself
                if k != key:
                    if end is not None and key is not None and (out := end(key, state)) is not None and len(out):
                        yield out
                    key, state = k, None
                state, out = step(state, part)
                if out is not None and len(out):
                    yield out
        if end is not None and key is not None and (out := end(key, state)) is not None and len(out):
            yield out

    tasks = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if dealt else []
    return df.repartition(*tasks, *on).sortWithinPartitions(*on, *order).mapInPandas(run, schema)


def ordered_offers(df: DataFrame, on: str, order: list[str], columns: list[str], fresh: Callable[[], Any], schema: str) -> DataFrame:
    """``ordered_fold`` of short keys: each begins with ``fresh()``, whose ``offer`` takes ``columns`` of a row (None: null or not a
    number) and gives an output row without the key, or None. Lists and output frames are made by the batch, not by the key."""
    names = [on, *[c.split()[0] for c in schema.split(", ")[1:]]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            lists = [[None if x is None or x != x else x for x in rows[c].tolist()] for c in (on, *columns)]
            out = []
            for k, *row in zip(*lists):
                if state is None or k != key:
                    key, state = k, fresh()
                if (said := state.offer(*row)) is not None:
                    out.append((k, *said))
            if out:
                yield pd.DataFrame(out, columns=names)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*dict.fromkeys([on, *order, *columns])).repartition(tasks, on).sortWithinPartitions(on, *order).mapInPandas(run, schema)


def ordered_kept(df: DataFrame, on: list[str], order: list[str], columns: list[str], fresh: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Rows that ``fresh()``, made for each key, says True of when it is given ``columns`` of the key's rows in order (None: null).
    Rows are kept by the Arrow batch, however short keys are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keep = None, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in on))
            kept = []
            for k, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in columns))):
                if keep is None or k != key:
                    key, keep = k, fresh()
                kept.append(keep(*row))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.repartition(*on).sortWithinPartitions(*on, *order).mapInArrow(run, df.schema)


def min_gap_step(at: str, gap: int, columns: list[str]):
    """Keep a row if it is more than ``gap`` after the last *kept* one."""

    def step(last, rows):
        keep = []
        for t in rows[at].tolist():
            ok = last is None or t - last > gap
            keep.append(ok)
            last = t if ok else last
        return last, rows.loc[keep, columns]

    return step


def greedy_min_gap(df: DataFrame, at: str, gap: int, on: list[str], columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """Rows kept greedily with at least ``gap`` between kept ones of a key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ordered_fold(df.select(*dict.fromkeys([*on, at, *columns, *(tie or [])])), on, [at, *(tie or [])], min_gap_step(at, gap, columns), ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def trigger_step(at: str, value: str, on: list[str], level: float, least: int, instant: float, release: float, release_rows: int, gap: int):
    """Persistence trigger: a run of ``least`` rows at ``level``, or one at ``instant``, fires once; the trigger is
    re-armed by ``release_rows`` rows below ``release``, and fires no sooner than ``gap`` after the last run start."""

    def step(state, rows):
        run, start, peak, armed, low, last = state or (0, None, 0.0, True, 0, None)
        out = []
        for key, t, p in zip(zip(*[rows[c] for c in on]), rows[at].tolist(), rows[value].tolist()):
            if p >= level:
                start, run, peak = (t, 1, p) if run == 0 else (start, run + 1, max(peak, p))
            else:
                run, peak = 0, 0.0
            low = low + 1 if p < release else 0
            armed = armed or low >= release_rows
            if armed and run and (run >= least or peak >= instant) and (last is None or start - last > gap):
                out.append((*key, start, t, peak))
                armed, last = False, start
        frame = pd.DataFrame(out, columns=[*on, "start", "declared", "peak"]) if out else None
        return (run, start, peak, armed, low, last), frame

    return step


def token_trigger_step(at: str, p: str, dt: str, on: list[str], level: float = 0.3, release: float = 0.3, below: float = 2.0, since: float = 5.0, tokens: int = 2):
    """Rising edge of ``p`` after release; or a restart when ``dt`` has peaked at ``since`` or more and then stays at
    ``below`` or less for ``tokens`` rows at ``level``, one after another. Rows between release and level count for
    the peak and break the sequence."""

    def step(state, rows):
        armed, top, count = state or (True, 0.0, 0)
        out = []
        for key, t, prob, d in zip(zip(*[rows[c] for c in on]), rows[at].tolist(), rows[p].tolist(), rows[dt].tolist()):
            if prob < release:
                armed, top, count = True, 0.0, 0
                continue
            if prob < level:
                top, count = max(top, d), 0
                continue
            if armed:
                out.append((*key, t, False))
                armed, top, count = False, d, 0
                continue
            count = count + 1 if top >= since and d <= below else 0
            top = max(top, d)
            if count >= tokens:
                out.append((*key, t, True))
                top, count = d, 0
        return (armed, top, count), pd.DataFrame(out, columns=[*on, at, "restart"]) if out else None

    return step


RELEASED = "released string, id bigint, lo bigint, hi bigint, forced boolean"


class Reorder:
    """Spans of one channel put into order.

    What begins at the front, or before it and ends beyond, passes, without what is behind the front. What begins ahead
    is held. A hole is a gap when data reach more than ``patience`` beyond its end (the start of the next held span),
    or when ``most`` spans are held and another has to be. Until the earliest span has been waited for in the same way
    there is no front, so that spans before the first arrival still find their place. Spans behind the front are stale.

    With ``at``, the time of arrival, a channel that is silent for more than ``idle`` gives out what it holds.
    """

    def __init__(self, patience: int, most: int = 1000, idle: int | None = None, front: int | None = None):
        self.patience, self.most, self.idle, self.front = patience, most, idle, front
        self.seen, self.last, self.held = None, None, []
        self.stats = dict.fromkeys(("records", "in_order", "held", "stale", "trimmed", "gaps", "missing", "forced", "lateness"), 0)

    def offer(self, lo: int | None, hi: int | None, key: int | None, at: int | None = None) -> list[tuple]:
        """What comes out when a span comes in; one without ends tells the time only."""
        out: list[tuple] = []
        if at is not None:
            if self.idle is not None and self.last is not None and at - self.last > self.idle:
                out = self.flush()
            self.last = at if self.last is None else max(self.last, at)
        if lo is None or hi is None or hi <= lo:
            return out
        self.stats["records"] += 1
        self.stats["lateness"] = max(self.stats["lateness"], (hi if self.seen is None else self.seen) - hi)
        self.seen = hi if self.seen is None else max(self.seen, hi)
        if (self.front is None or lo > self.front) and len(self.held) >= self.most:
            self._open(out, self.seen - self.held[0][0] <= self.patience)
        if self.front is None or lo > self.front:
            self.stats["held"] += 1
            heapq.heappush(self.held, (lo, hi, key))
        else:
            self.stats["in_order"] += lo == self.front
            self._pass(out, lo, hi, key)
            self._drain(out)
        while self.held and self.seen - self.held[0][0] > self.patience:
            self._open(out, False)
        return out

    def flush(self) -> list[tuple]:
        """All that is held, whatever is missing before it."""
        out: list[tuple] = []
        while self.held:
            self._open(out, False)
        return out

    def _open(self, out: list[tuple], forced: bool) -> None:
        start = self.held[0][0]
        if self.front is not None and start > self.front:
            self.stats["gaps"] += 1
            self.stats["missing"] += start - self.front
            self.stats["forced"] += forced
            out.append(("gap", None, self.front, start, forced))
        self.front = start if self.front is None else max(self.front, start)
        self._drain(out)

    def _drain(self, out: list[tuple]) -> None:
        while self.held and self.held[0][0] <= self.front:
            self._pass(out, *heapq.heappop(self.held))

    def _pass(self, out: list[tuple], lo: int, hi: int, key: int | None) -> None:
        if hi <= self.front:
            self.stats["stale"] += 1
            out.append(("stale", key, lo, hi, False))
            return
        self.stats["trimmed"] += self.front - lo
        out.append(("data", key, self.front, hi, False))
        self.front = hi


def released(keys: list[str], name: tuple, rows: list[tuple]) -> pd.DataFrame | None:
    """Output of a buffer under the names of its key."""
    if not rows:
        return None
    out = pd.DataFrame(rows, columns=["released", "id", "lo", "hi", "forced"])
    out["id"] = out["id"].astype("Int64")
    for i, (k, v) in enumerate(zip(keys, name)):
        out.insert(i, k, v)
    return out


def reorder_steps(channel: str, lo: str, hi: str, key: str, patience: int, most: int = 1000, at: str | None = None, idle: int | None = None, front: str | None = None):
    """Step and end of a reorder buffer; output is ``channel`` and the columns of ``RELEASED``. ``front`` names a column
    with the front that a part of a channel begins with (see :func:`tremolo.operators.parts.time_parts`)."""

    def step(state, rows):
        if state is None:
            begin = rows[front].iloc[0] if front else None
            state = Reorder(patience, most, idle, None if begin is None or pd.isna(begin) else int(begin))
        spans = zip(rows[lo].tolist(), rows[hi].tolist(), rows[key].tolist(), rows[at].tolist() if at else [None] * len(rows))
        return state, released([channel], (rows[channel].iloc[0],), [x for span in spans for x in state.offer(*span)])

    def end(key_, state):
        return released([channel], key_[:1], state.flush())

    return step, end


def live_dedup(bits: int = 24, last: int | None = None, newest: dict | None = None) -> Callable[..., bool]:
    """Whether to keep a row of a wrapping number, a time (None or not a number: none) and a channel: see ``live_dedup_step``."""
    span, half = 1 << bits, 1 << (bits - 1)
    newest = {} if newest is None else newest

    def keep(n, t, c=None) -> bool:
        nonlocal last
        timed = t is not None and t == t
        ok = last is None or 1 <= (n - last) % span < half or (timed and (c not in newest or t > newest[c]))
        if ok:
            last = n
            if timed:
                newest[c] = max(newest.get(c, t), t)
        return ok

    keep.state = lambda: (last, newest)
    return keep


def live_dedup_step(sequence: str, start: str, columns: list[str], bits: int = 24, channel: str | None = None):
    """Keep rows whose wrapping number is after the last kept one; a row that is not is kept, as a restarted numbering,
    if its data are newer than all kept before of its ``channel`` (a key numbers the rows of all its channels). Rows
    without a time are never newer."""

    def step(state, rows):
        keep = live_dedup(bits, *(state or ()))
        channels = rows[channel].tolist() if channel else [None] * len(rows)
        kept = [keep(*row) for row in zip(rows[sequence].tolist(), rows[start].tolist(), channels)]
        return keep.state(), rows.loc[kept, columns]

    return step


def change_step(value: str, count: str, least: float, columns: list[str]):
    """Keep a row whose value is ``least`` or more from that of the last kept one, or whose count differs from it."""

    def step(last, rows):
        keep = []
        for v, n in zip(rows[value].tolist(), rows[count].tolist()):
            ok = last is None or abs(v - last[0]) >= least or n != last[1]
            keep.append(ok)
            last = (v, n) if ok else last
        return last, rows.loc[keep, columns]

    return step
