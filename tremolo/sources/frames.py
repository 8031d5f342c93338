"""Connections of a live packet protocol: their bytes as a stream, frames put together from pieces cut anywhere, records
delivered once, and the commands with which each station goes on.

What a connection has sent lies in a folder ``<path>/<server>/<connection>`` of segments, each named by the position of
its first byte (twenty digits). Segments never change; new ones may come at any time, so writing one again does no harm.
The source's offset is the next byte of every connection. It gives out small pieces in any order; the stateful operator
keyed by connection holds pieces that are ahead in Spark's state store, so that a task's memory does not grow with a
micro-batch, and keeps less than a frame between batches.

Frames: eight bytes ``SL`` and six hexadecimal digits, then a record of 512 bytes; ``SLINFO`` with a blank and ``*`` (more
follows) or a blank, then 512 bytes; ``ERROR`` up to the line's end within 256 bytes; ``END``. After ``END``, or bytes
that begin no frame (kind ``broken``), the rest of that connection is passed over.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tremolo.functions.clock import sequence_next
from tremolo.operators import fold
from tremolo.sources import records

PIECE = 4096
#: Pieces that a reading task gives out together.
PIECES_AT_ONCE = 256
PIECES = "server string, connection bigint, position bigint, bytes binary"
FRAMES = "server string, connection bigint, offset bigint, kind string, sequence int, more boolean, record binary"
_FRAME = regex.compile(rb"SL(?P<data>[0-9A-Fa-f]{6})(?P<record>.{512})|SLINFO (?P<info>[* ])(?P<told>.{512})|(?P<error>ERROR[^\n]{0,250}\n)|(?P<end>END)", regex.DOTALL)


def split(data: bytes, start: int = 0) -> tuple[list[tuple], int, bool]:
    """Whole frames at the head of ``data``, whose first byte has position ``start``: rows of offset, kind, sequence, more
    and record; the bytes they take; and whether nothing more can follow."""
    found, at = [], 0
    while at < len(data):
        m = _FRAME.match(data, at, partial=True)
        if m is None:
            return [*found, (start + at, "broken", None, None, None)], at, True
        if m.partial:
            break
        kind = next(k for k in ("data", "info", "error", "end") if m[k] is not None)
        found.append((start + at, kind, int(m["data"], 16) if kind == "data" else None, m["info"] == b"*" if kind == "info" else None, m["record"]))
        at = m.end()
        if kind == "end":
            return found, at, True
    return found, at, False


# ---- the bytes --------------------------------------------------------------------------------------------------------


class _Ranges(InputPartition):
    """Bytes of some connections: (server, connection, first, end)."""

    def __init__(self, spans: list[tuple[str, str, int, int]]):
        self.spans = spans


class _LogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.system, self.root = fs.FileSystem.from_uri(options["path"])
        self.until = int(options.get("until", 1 << 62))
        self.each = int(options.get("rangeBytes", 1 << 24))
        self.piece = int(options.get("pieceBytes", PIECE))

    def _segments(self, below: str) -> list[tuple[str, int, int]]:
        """Connection, first position and length of every segment below a folder."""
        files = [x for x in self.system.get_file_info(fs.FileSelector(below, allow_not_found=True, recursive=True)) if x.type == fs.FileType.File and x.base_name.isdigit()]
        return sorted((posixpath.relpath(posixpath.dirname(x.path), self.root), int(x.base_name), x.size) for x in files)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of what lies there without a hole, ``until`` at most."""
        ends: dict[str, int] = {}
        for name, first, size in self._segments(self.root):
            if first <= ends.get(name, 0):
                ends[name] = max(ends.get(name, 0), first + size)
        return {name: min(end, self.until) for name, end in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Tasks of ``rangeBytes``: as many as the bytes need, however many connections there are."""
        parts, room = [], 0
        for name, high in sorted(end.items()):
            low = start.get(name, 0)
            while low < high:
                if not room:
                    parts.append([])
                    room = self.each
                n = min(room, high - low)
                parts[-1].append((*name.split("/"), low, low + n))
                low, room = low + n, room - n
        return [_Ranges(p) for p in parts] or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        rows = []
        for p in partition.spans:
            for row in self._pieces(*p):
                rows.append(row)
                if len(rows) == PIECES_AT_ONCE:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        server, connection, position, data = zip(*rows)
        return pa.RecordBatch.from_pydict({"server": server, "connection": pa.array(connection, pa.int64()), "position": pa.array(position, pa.int64()), "bytes": pa.array(data, pa.binary())})

    def _pieces(self, server: str, connection: str, reached: int, end: int) -> Iterator[tuple]:
        folder = posixpath.join(self.root, server, connection)
        for _, first, size in self._segments(folder):
            low, high = max(reached, first), min(end, first + size)
            if low >= high:
                continue
            with self.system.open_input_file(posixpath.join(folder, f"{first:020d}")) as f:
                f.seek(low - first)
                for at in range(low, high, self.piece):
                    yield server, int(connection), at, f.read(min(self.piece, high - at))
            reached = high


class ByteLog(DataSource):
    """Options: ``path``; ``until``, the byte of each connection at which to stop for now; ``rangeBytes`` of a task and
    ``pieceBytes`` of a row."""

    @classmethod
    def name(cls) -> str:
        return "byte_log"

    def schema(self) -> str:
        return PIECES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogReader(self.options)


def byte_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pieces of all connections below ``path`` as a stream."""
    spark.dataSource.register(ByteLog)
    return spark.readStream.format("byte_log").options(path=path, **options).load()


def write_log(df: DataFrame, order: list[str], path: str, segment: int = 1 << 23) -> DataFrame:
    """Bytes of rows (server, connection, bytes) written in ``order`` as segments of about ``segment`` bytes; one row for
    each. A task writes whole connections one after another and holds one segment; a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        at, held, now, made = 0, [], None, []

        def put():
            nonlocal at, held
            data = b"".join(held)
            if data:
                folder = posixpath.join(root, *now)
                system.create_dir(folder, recursive=True)
                name = f"{folder}/{at:020d}"
                with system.open_output_stream(f"{name}.part") as f:
                    f.write(data)
                system.move(f"{name}.part", name)
                made.append((*now, at, len(data)))
            at, held = at + len(data), []

        size = 0
        for batch in batches:
            for server, connection, data in zip(*(batch.column(c).to_pylist() for c in ("server", "connection", "bytes"))):
                if (server, str(connection)) != now:
                    put()
                    now, at, size = (server, str(connection)), 0, 0
                held.append(data)
                size += len(data)
                if size >= segment:
                    put()
                    size = 0
        put()
        cols = list(zip(*made)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array([int(x) for x in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["server", "connection", "position", "length"])

    keyed = df.repartition("server", "connection").sortWithinPartitions("server", "connection", *order)
    return keyed.select("server", "connection", "bytes").mapInArrow(run, "server string, connection bigint, position bigint, length bigint")


# ---- frames and what they deliver -------------------------------------------------------------------------------------


class FrameProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "at bigint, rest binary, closed boolean")
        self.ahead = handle.getMapState("ahead", "position bigint", "bytes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, rest, closed = self.place.get() if self.place.exists() else (0, b"", False)
        waiting = {k[0] for k in self.ahead.keys()} if self.ahead.exists() else set()
        rest = bytes(rest)
        for batch in rows:
            found = []
            for position, data in sorted(zip(batch["position"].tolist(), batch["bytes"].tolist())):
                if closed or position + len(data) <= at + len(rest):
                    continue
                if position > at + len(rest):
                    self.ahead.updateValue((position,), (data,))
                    waiting.add(position)
                    continue
                rest += bytes(data)[at + len(rest) - position :]
                while True:
                    more, used, closed = split(rest, at)
                    found += more
                    at, rest = at + used, rest[used:]
                    after = at + len(rest)
                    if closed or after not in waiting:
                        break
                    rest += bytes(self.ahead.getValue((after,))[0])
                    self.ahead.removeKey((after,))
                    waiting.remove(after)
            if found:
                yield self._rows(key, found)
        if closed:
            rest = b""
            if waiting:
                self.ahead.clear()
        self.place.update((at, rest, closed))

    def _rows(self, key, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["offset", "kind", "sequence", "more", "record"])
        out["sequence"], out["more"] = out["sequence"].astype("Int32"), out["more"].astype("boolean")
        out.insert(0, "connection", key[1])
        out.insert(0, "server", key[0])
        return out

    def close(self) -> None:
        pass


def frames(pieces: DataFrame) -> DataFrame:
    """Frames of a stream of pieces, with the columns of ``FRAMES``. Pieces may be of any length, come in any order and
    come again."""
    return pieces.groupBy("server", "connection").transformWithStateInPandas(FrameProcessor(), FRAMES, "append", "None")


def delivered(found: DataFrame, stations: DataFrame | None = None, values: tuple[str, ...] = ("start_us", "samples", "reason")) -> DataFrame:
    """Records of data frames, each once: server, network, station, sequence, connection, offset and ``values`` of the record.

    A station numbers its own frames, whatever the connection. A number not after the last is a repeat unless its data
    are newer than all of their channel. ``stations`` (network, station; distinct) leaves out those not asked for. Records
    that cannot be read have no time: they never begin a numbering again."""
    keep = ("server", "connection", "offset", "sequence")
    r = records.decode_records(found.where("kind = 'data'").select(*keep, "record"), keep)
    if stations is not None:
        r = r.join(stations.select("network", "station"), ["network", "station"], "left_semi")
    out = ["server", "network", "station", "sequence", "connection", "offset", *values]
    r = r.withColumn("__at", F.when(F.col("reason") == "", F.col("start_us"))).select(*out, "channel", "__at")
    return fold.ordered_kept(r, ["network", "station"], ["connection", "offset"], ["sequence", "__at", "channel"], fold.live_dedup).select(*out)


def resume_commands(received: DataFrame) -> DataFrame:
    """What a client says for each station to go on after its last record: network, station and three lines. The last
    record is the one that came last, not the one with the greatest number, which wraps."""
    last = received.groupBy("network", "station").agg(F.max_by("sequence", F.struct("connection", "offset")).alias("last"))
    go = F.format_string("DATA %06X", sequence_next(F.col("last")).cast("int"))
    return last.select("network", "station", F.concat(F.lit("STATION "), "station", F.lit(" "), "network").alias("station_line"), F.lit("SELECT HH?.D").alias("select_line"), go.alias("data_line"))
