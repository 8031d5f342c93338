"""The reorder buffer on a stream, with typed state and event-time timers.

State of a channel is its front, the furthest end seen, the time of the last arrival, and a list of the spans held.
Each arrival moves the channel's timer to ``idle`` beyond it: when the watermark passes the timer, what is held goes out.
A row that comes after such a silence has the same effect, so results do not depend on how a stream is cut into
micro-batches, as long as these keep the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tremolo.operators.fold import RELEASED, Reorder, released


class ReorderProcessor(StatefulProcessor):
    def __init__(self, on: list[str], patience: int, most: int, idle: int):
        self.on, self.patience, self.most, self.idle = on, patience, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "front bigint, seen bigint, last bigint")
        self.spans = handle.getListState("spans", "lo bigint, hi bigint, id bigint")

    def _buffer(self) -> Reorder:
        buffer = Reorder(self.patience, self.most, self.idle)
        if self.clock.exists():
            buffer.front, buffer.seen, buffer.last = self.clock.get()
            buffer.held = sorted(tuple(x) for x in self.spans.get())
        return buffer

    def _keep(self, buffer: Reorder) -> None:
        self.clock.update((buffer.front, buffer.seen, buffer.last))
        if buffer.held:
            self.spans.put(buffer.held)
        elif self.spans.exists():
            self.spans.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, out = self._buffer(), []
        told = pd.concat(list(rows)).sort_values(["arrival", "id"], kind="stable", na_position="last")  # of one channel in one micro-batch
        none = lambda c: [None if pd.isna(x) else int(x) for x in told[c]]
        for span in zip(none("lo"), none("hi"), none("id"), none("arrival")):
            out += buffer.offer(*span)
        self._keep(buffer)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((buffer.last + self.idle) // 1000 + 1)
        frame = released(self.on, key, out)
        if frame is not None:
            yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer = self._buffer()
        frame = released(self.on, key, buffer.flush())
        self._keep(buffer)
        if frame is not None:
            yield frame

    def close(self) -> None:
        pass


def reorder_stream(stream: DataFrame, on: list[str], patience: int, idle: int, most: int = 1000) -> DataFrame:
    """Spans (``on``, id, lo, hi, arrival; times in microseconds) of a stream in order: ``on`` and the columns of
    ``RELEASED``. A row without ends tells that its channel had nothing until then."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), RELEASED])
    timed = stream.select(*on, "id", "lo", "hi", "arrival", F.timestamp_micros("arrival").alias("__at")).withWatermark("__at", "1 second")
    return timed.groupBy(*on).transformWithStateInPandas(ReorderProcessor(on, patience, most, idle), schema, "append", "EventTime")
