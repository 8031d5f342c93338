"""Shared helpers of the training-data operators: staging in the shared folder, Arrow text buffers, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are worked on in slices of about this many UTF-8 bytes, so that numpy temporaries stay small.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a new temporary one (local mode only)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tremolo-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What the open :func:`staging` blocks have staged.
_OPEN: list[list[DataFrame]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    for made in _OPEN:
        made.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later job reads, because what was made of them is written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging() -> Iterator[list[DataFrame]]:
    """Tables staged inside are removed at the end, but for those that the block takes out of the list."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        discard(*made)


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (case as given), so that extra columns of any name cannot clash."""
    return df.select(*[df[f"`{n}`"].alias(n) for n in names])


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with about ``limit`` bytes of ``column`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, column: str = "text") -> DataFrame:
    """``mapInArrow`` over small runs of rows."""

    def run(batches):
        for part in slices(batches, column):
            out = f(part)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def rows_in(df: DataFrame, keys: DataFrame, key: str, bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """``df`` split by a bitmap of ``keys``: rows that may have one of the keys, and rows that have none for sure.

    A join of wide rows with few keys then shuffles the first part alone; the bitmap's size is fixed.
    """
    hashed = F.xxhash64(key)
    bitmap = df.sparkSession.sparkContext.broadcast(Bitmap.of(keys.select(hashed.alias("h")), "h", bits))
    wide = df.withColumn("__h", hashed)

    def part(inside: bool):
        def run(batches):
            for batch in batches:
                on = bitmap.value.test(batch.column("__h").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(on == inside)).drop_columns(["__h"])

        return wide.mapInArrow(run, df.schema)

    return part(True), part(False)


def dealt_blocks(members: DataFrame, by: str, block: int) -> DataFrame:
    """Members of keys, with the number ``n`` of their key's members, dealt to pairs of blocks (``own``, ``lo``, ``hi``)
    so that any two of a key meet in one pair of blocks.

    A block has ``block`` members or, for large keys, four times the square root of their number: a key's rows then
    grow as its number of members to the power of 1.5, and a task's as its square root.
    """
    blocks = F.ceil(F.col("n") / F.greatest(F.lit(float(block)), 4 * F.sqrt("n"))).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64(by), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def list_array(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
SEED2 = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        with np.errstate(over="ignore"):
            out[filled : filled + take] = out[:take] * (out[filled - 1] * base)
        filled += take
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Spans:
    """Hashes of any spans of a byte or integer array: polynomial prefix sums modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE):
        n = len(data)
        self.inverse = powers(n + 1, np.uint64(pow(int(base), -1, 1 << 64)))
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n, base), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ASCII-lower-cased bytes, and start, end and row of each run of digits, letters and non-ASCII bytes."""
    lower = _LOWER[data]
    inside = _WORD[lower]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return lower, starts, ends, rows


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def crc32_of(column: Column) -> Column:
    """crc32 of a value's text."""
    return F.crc32(column.cast("string").cast("binary"))


def shingle_hashes(word_hash: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word index of every run of ``k`` words inside a row."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * BASE + word_hash[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(h[at]), at


class Bitmap:
    """A filter of fixed size (``1 << bits`` bits) for 64-bit hashes, false positives only. With ``probes`` 2 each
    hash sets and needs two bits, from its lower and upper half."""

    def __init__(self, bits: int, probes: int, data: np.ndarray):
        self.bits, self.probes, self.data = bits, probes, data

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int = 23, probes: int = 1) -> Bitmap:
        """Gathered from a long column: at most ``1 << (bits - 6)`` rows reach the driver, whatever the input's size."""
        h = F.col(column)
        if probes == 2:
            h = F.explode(F.array(h, F.shiftrightunsigned(h, 32)))
        at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
        rows = df.select(h.alias("h")).select(F.shiftright(at, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("one"))
        table = rows.groupBy("at").agg(F.expr("bit_or(one)").alias("word")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[table["at"].to_numpy()] = table["word"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(bits, probes, words.view(np.uint8))

    def test(self, h: np.ndarray) -> np.ndarray:
        on = self._bits(h)
        return on & self._bits(h >> np.uint64(32)) if self.probes == 2 else on

    def _bits(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64((1 << self.bits) - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
