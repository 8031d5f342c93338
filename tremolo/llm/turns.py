"""Repair of conversation structure: A* over the edit lattice of each stretch of turns, stretches joined by their states.

A legal conversation is empty, or an optional system turn followed by pairs of user and assistant turns: an automaton of
four states (start, after system, after user, after assistant), told by the first letters of the roles. Every turn is
kept, given the role that comes next, or deleted, and empty turns can be inserted anywhere; blank and repeated turns
have to go, truncated ones cost a charge if they stay. The lattice has a node for each turn and state. A* goes through it
in the order of (cost so far plus least cost of the rest, audit), the audit being the edits' initials: the least cost of
the rest is the suffix sum of deletions that are required and of charges for truncation, which no edits avoid for less.
An audit fixes the state that it leads to, and no audit with the cost of another begins with it, so the first arrival at
a node has the least audit of the cheapest ones, and so has the first arrival at the end.

Spark sorts the turns by conversation and turn into ranges, so that a conversation of any length is dealt to many tasks.
A task cuts its turns into stretches of ``rows`` at most; a stretch that may not be a whole conversation is searched from
each state that it can begin in to each that it can end in, and these small tables are joined in order afterwards. The
join and the texts of the repaired turns meet in one sorted stream for each conversation, which holds its audit and one
batch of rows: the digest of a whole conversation needs its turns one after another.

Defined results: null roles and texts are one space, and so is a null id or turn in the key of :func:`damage`; turns
sort nulls first, equal turns by role and digest of the text; equal rows are repeats of the first of them; a null
``conv_id`` is a conversation of its own; a conversation without rows has zeros, an empty audit and the empty digest;
an empty table gives an empty result. Texts are compared by SHA-256. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import own, stage

#: The state after a turn of a role initial; the role that comes next in each state, and the state after it.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
COMES, AFTER, LEGAL_END = ("user", "user", "assistant", "user"), (2, 2, 3, 2), (0, 3)
KEEP, REROLE, DELETE, INSERT, CHARGE = 0, 2, 3, 2, 1
#: Most turns of a stretch.
ROWS = 512
_SPACE = " \t\n\x0b\f\r"


def repair(initials: list[str], must_go: list[bool], truncated: list[bool], entry: int = 0, ends: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits by the state that they end in: of the best of ``ends`` alone, or of every
    state that can be reached."""
    n = len(initials)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if must_go[i] else CHARGE if truncated[i] else 0)
    heap, done, found = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if ends is None:
                found[state] = (bound, audit)
            elif state in ends:
                return {state: (bound, audit)}
        cost = bound - rest[i]
        edits = [(INSERT, "I", i, AFTER[state])]
        if i < n:
            edits.append((DELETE, "D", i + 1, state))
            if not must_go[i]:
                charge = CHARGE * truncated[i]
                edits.append((REROLE + charge, "R", i + 1, AFTER[state]))
                if (state, initials[i]) in STEP:
                    edits.append((KEEP + charge, "K", i + 1, STEP[state, initials[i]]))
        for price, edit, to, after in edits:
            if (to, after) not in done:
                heapq.heappush(heap, (cost + price + rest[to], audit + edit, to, after))
    return found


def joined(tables: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """Cheapest cost and least audit of stretches one after another; each has results by first and last state."""
    front = {0: (0, "")}
    for table in tables:
        after: dict[int, tuple[int, str]] = {}
        for entry, (cost, audit) in front.items():
            for end, (more, edits) in table.get(entry, {}).items():
                way = (cost + more, audit + edits)
                if end not in after or way < after[end]:
                    after[end] = way
        front = after
    return min(front[s] for s in LEGAL_END if s in front)


class Repaired:
    """Digest of a repaired conversation: the audit's edits applied to its turns as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.empty, self.digest = audit, 0, 0, True, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(COMES[self.state], "")
            self.state, self.at = AFTER[self.state], self.at + 1

    def turn(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._write(role, text)
            self.state = STEP[self.state, role[:1]]
        elif edit == "R":
            self._write(COMES[self.state], text)
            self.state = AFTER[self.state]

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


class Stretch:
    """Turns of one conversation that follow each other in one task, and what is counted of them."""

    def __init__(self, conv: object, opens: bool, before: tuple | None = None):
        self.conv, self.opens, self.before, self.first, self.last = conv, opens, before, None, None
        self.initials, self.must_go, self.truncated = [], [], []
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.low = self.high = None

    def add(self, turn: object, role: str, digest: bytes, blank: bool, truncated: bool, again: bool) -> None:
        key = (turn, role, digest)
        fault = "blank" if blank else "duplicate" if again or key == (self.last or self.before) else "truncated" if truncated else None
        if fault:
            self.n[fault] += 1
        self.must_go.append(fault in ("blank", "duplicate"))
        self.truncated.append(fault == "truncated")
        self.initials.append(role[:1])
        self.n["illegal"] += len(self.initials) > 1 and legal(*self.initials[-2:]) is False
        if turn is not None:
            self.n["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = self.first or key, key

    def summary(self, closes: bool) -> str:
        whole = self.opens and closes
        table = {e: repair(self.initials, self.must_go, self.truncated, e, LEGAL_END if whole else None) for e in ((0,) if self.opens else range(4))}
        return json.dumps({**self.n, "low": self.low, "high": self.high, "head": self.initials[0], "tail": self.initials[-1], "table": table})


def legal(before: str, initial: str) -> bool:
    """Whether a turn of a role initial may follow another."""
    return before + initial in ("su", "ua", "au")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with every twentieth turn, by the checksum of ``conv_id:turn``, dropped, and as many
    emptied, stripped of full stops, repeated, and given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    d = own(turns, "conv_id", "turn", "role", "text").withColumn("kind", kind).where("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(filled("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def faults(turns: DataFrame) -> DataFrame:
    """Turns with the digest of the text, and whether they are blank, end without a full stop, or say again what the
    role said at an earlier turn (repeats at the same turn are neighbours and found there)."""
    told = F.expr("trim(TRAILING chars FROM text)")
    d = turns.withColumn("chars", F.lit(_SPACE)).withColumn("told", told).select(
        "conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), (F.col("told") == "").alias("blank"),
        (~F.substring("told", -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    # only what is said at more than one turn is joined; a turn of null is before all others
    said = d.groupBy("conv_id", "role", "digest").agg(F.bool_or(F.col("turn").isNull()).alias("unset"), F.min("turn").alias("first"), F.max("turn").alias("latest"))
    said = said.where("unset or first < latest").alias("s")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("conv_id", "role", "digest")]
    again = F.coalesce(F.col("s.unset") & F.col("d.turn").isNotNull() | (F.col("d.turn") > F.col("s.first")), F.lit(False))
    return d.alias("d").join(said, same[0] & same[1] & same[2], "left").select("d.*", again.alias("again"))


def _order(*after: str) -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), *map(F.col, after)]


def stretches(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """One row per stretch: conv_id, the first turn's order (turn, role, digest, piece) and a summary as JSON."""

    def run(batches):
        now, piece, out = None, 0, []

        def closed(stretch, closes):
            return (stretch.conv, *stretch.first, piece, stretch.summary(closes))

        for batch in batches:
            for conv, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None:
                    # what comes before a task's first conversation is not known here
                    now = Stretch(conv, False)
                elif conv != now.conv or len(now.initials) == most:
                    other = conv != now.conv
                    out.append(closed(now, other))
                    now, piece = Stretch(conv, other, None if other else now.last), piece + 1
                now.add(*turn)
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([closed(now, False)])

    fields = [rows.schema["conv_id"], rows.schema["turn"], T.StructField("role", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("piece", T.LongType()), T.StructField("summary", T.StringType())]
    arrow = rows.select("conv_id", "turn").limit(0).toArrow().schema
    types = [arrow.field("conv_id").type, arrow.field("turn").type, pa.string(), pa.binary(), pa.int64(), pa.string()]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.name for f in fields])

    slim = rows.select("conv_id", "turn", "role", "digest", "blank", "truncated", "again")
    order = [F.col("conv_id").asc_nulls_first(), *_order()]
    return slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, T.StructType(fields))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _counted(parts: list[dict]) -> dict:
    """Counts of a conversation from its stretches in order, cost and audit."""
    out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(parts, parts[1:]):
        out["illegal"] += not legal(a["tail"], b["head"])
    low = high = None
    for p in parts:
        if p["low"] is not None:
            out["turns"] -= p["low"] == high
            low, high = p["low"] if low is None else low, p["high"]
    out["gaps"] = 0 if low is None else high - low + 1 - out["turns"]
    out["cost"], out["audit"] = joined([{int(e): {int(s): tuple(w) for s, w in ways.items()} for e, ways in p["table"].items()} for p in parts])
    return out


def repair_conversations(turns: DataFrame, of: DataFrame, most: int = ROWS) -> DataFrame:
    """Per ``conv_id`` of ``of``: gaps, blank, duplicate, truncated, illegal, cost, audit and digest of the repaired
    conversation, for ``turns`` (conv_id, turn, role, text)."""
    rows = stage(faults(turns), "turns-rows")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    turn = rows.schema["turn"].dataType
    marks = own(of, "conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), none("turn", turn), none("role", "string"), none("digest", "binary"), none("piece", "long"), none("text", "string"))
    found = stretches(rows, most).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "piece", F.col("summary").alias("text"))
    texts = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "digest", F.lit(0).cast("long").alias("piece"), "text")

    def run(batches):
        begun, conv, parts, digest, counts, out = False, None, [], None, None, []

        def settle():
            return _counted(parts) if parts else dict.fromkeys(_COUNTS, 0) | {"audit": ""}

        def finished():
            done = counts or settle()
            return (conv, *[done[c] for c in _COUNTS], done["audit"], (digest or Repaired(done["audit"])).end())

        for batch in batches:
            kinds = zip(*[batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")])
            for c, kind, role, text in kinds:
                if not begun or c != conv:
                    if begun:
                        out.append(finished())
                    begun, conv, parts, digest, counts = True, c, [], None, None
                if kind == 1:
                    parts.append(json.loads(text))
                elif kind == 2:
                    if digest is None:
                        counts = settle()
                        digest, parts = Repaired(counts["audit"]), []
                    digest.turn(role, text)
            if out:
                yield batch_of(out)
                out = []
        if begun:
            yield batch_of([finished()])

    conv_type = of.schema["conv_id"]
    fields = [conv_type, *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    types = [own(of, "conv_id").limit(0).toArrow().schema.field("conv_id").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.name for f in fields])

    every = marks.unionByName(found).unionByName(texts)
    return every.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *_order("piece")).mapInArrow(run, T.StructType(fields))


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damage(turns), turns)
