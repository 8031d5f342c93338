"""Messages of a network's stations in the order of their times, while some stations lag.

A station promises that nothing of it comes before a time. A message is let out when the promises of all running
stations are later than its time, in the order of time, station and number. It waits for ``wait`` at most: stations that
still hold it back by then are lagging and not waited for until their promise is later than all that was let out.
What a lagging station sends for earlier times goes out at once, and is marked.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd

#: what: message, lagging or caught; ``t`` of the last two is the station's promise (null: none yet). ``disordered`` are
#: messages of an earlier place than one let out before.
RELEASED = "what string, id bigint, station bigint, t bigint, released bigint, disordered boolean"


class Release:
    """The state of one network: promises by station, lagging stations, messages held, the last place let out.

    ``order`` holds the other stations by a promise that they gave once; it is brought up to date where it is looked at, so
    that a row costs the logarithm of the stations, not their number."""

    def __init__(self, wait: int | None):
        self.wait, self.now = wait, -math.inf
        self.promised: dict[int, float] = {}
        self.lagging: set[int] = set()
        self.order: list[tuple] = []
        self.held: list[tuple] = []
        self.last: tuple | None = None

    def offer(self, kind: str, station: int, t: int | None, seq: int, key: int | None, at: int) -> list[tuple]:
        """A row that is received at ``at``: ``hello`` and ``bye`` of a station, ``progress`` to a time, or a
        ``message``, which is a promise of its own time too."""
        out = self._pass(at)
        if kind == "bye":
            self.promised.pop(station, None)
            self.lagging.discard(station)
        elif station not in self.promised:
            self.promised[station] = -math.inf
            heapq.heappush(self.order, (-math.inf, station))
        if kind in ("message", "progress") and t is not None:
            self.promised[station] = max(self.promised[station], t)
            if kind == "message":
                heapq.heappush(self.held, (t, station, seq, at, key))
        return out + self._let_out(at) + self._caught(station, at)

    def _pass(self, until: int) -> list[tuple]:
        """The waits that end up to ``until``, one after another."""
        out: list[tuple] = []
        while self.wait is not None and self.held and (ends := self.held[0][3] + self.wait) <= until:
            out += self._let_out(max(self.now, ends))
        return out

    def _let_out(self, now: int) -> list[tuple]:
        self.now, out = now, []
        while self.held:
            t, station, seq, received, key = self.held[0]
            if self._least() <= t:
                if self.wait is None or now - received < self.wait:
                    break
                slow = []
                while self._least() <= t:
                    slow.append(heapq.heappop(self.order)[1])
                    self.lagging.add(slow[-1])
                slow.sort()
                out += [("lagging", None, s, _time(self.promised[s]), now, False) for s in slow]
                continue
            heapq.heappop(self.held)
            early = self.last is not None and (t, station, seq) < self.last
            self.last = self.last if early else (t, station, seq)
            out.append(("message", key, station, t, now, early))
        return out

    def _least(self) -> float:
        """The earliest promise of the running stations that are not lagging."""
        while self.order:
            p, s = self.order[0]
            now = self.promised.get(s)
            if now is None or s in self.lagging:
                heapq.heappop(self.order)
            elif now > p:
                heapq.heapreplace(self.order, (now, s))
            else:
                return p
        return math.inf

    def _caught(self, s: int, now: int) -> list[tuple]:
        """Only the station that has just spoken can have caught up, as the last place never goes back."""
        if s not in self.lagging or self.last is None or self.promised[s] <= self.last[0]:
            return []
        self.lagging.discard(s)
        heapq.heappush(self.order, (self.promised[s], s))
        return [("caught", None, s, _time(self.promised[s]), now, False)]


def _time(promise: float) -> int | None:
    return None if promise == -math.inf else int(promise)


def release_step(on: str, wait: int | None):
    """Step of a fold over rows in the order received: ``on``, kind, station, t, seq, id, at. Rows of null kind, station or
    ``at`` say nothing; a message without a time is none. ``wait`` None: for ever, as in a replay."""

    def step(state, rows):
        state, out = state or Release(wait), []
        key = rows[on].iloc[0]
        none = lambda c: [None if n else x for x, n in zip(rows[c].fillna(0).astype("int64").tolist(), rows[c].isna().tolist())]
        for kind, station, t, seq, row, at in zip(rows["kind"], *(none(c) for c in ("station", "t", "seq", "id", "at"))):
            if not pd.isna(kind) and station is not None and at is not None:
                out += state.offer(kind, station, t, seq or 0, row, at)
        frame = pd.DataFrame(out, columns=["what", "id", "station", "t", "released", "disordered"]).astype({c: "Int64" for c in ("id", "station", "t", "released")})
        frame.insert(0, on, key)
        return state, frame

    return step
