"""Importance resampling towards a target corpus: array-scored weights, sorted runs, tournament merges.

Features of a text are its runs of one to three words, hashed into a fixed number of buckets. Counts of the buckets in
the corpus and in the target give one array of gains, and a text's weight is the sum of its features' gains. With
Gumbel noise from the id's digest on top, the highest scores are a weighted draw without replacement.

The draw itself is an external merge: each partition sorts its eligible rows into runs, cut into short blocks at the
borders of score ranges; the blocks are a written table. Exact counts per range give each range the rank of its first
row, so that ranges are merged in parallel: Spark delivers a range's blocks in the order of their heads, and a
tournament tree over the runs takes the next row, opening a block only when its head may win. A task holds one or two
blocks of each run. The range in which the draw ends stops at the exact count; ranges below it are never merged.

Defined results: a null or empty text has no features and weight 0; a null id hashes like the text ``null`` and comes
last among ties; rows of equal score and id are ordered by their number of features, and rows equal in that too are
alike in every column, so either may be drawn; an empty table, or a draw of less than one row, ranks nothing; an empty
target has counts of 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import _WORD, list_array, own, slices, stage, utf8, words

#: Buckets of features, most words of a feature, rows of a run and of a block of it, rows of a range, most ranges.
BUCKETS, NGRAM, RUN_ROWS, BLOCK_ROWS, RANGE_ROWS, RANGES = 10_000, 3, 1 << 20, 512, 2048, 256


def _zero_tables() -> np.ndarray:
    """For k < 32, the linear map of a CRC-32 over 2 ** k zero bytes, as four tables of 256 (one for each byte)."""
    byte = np.arange(256, dtype=np.uint32)
    table = byte.copy()
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    at = np.stack([byte << np.uint32(8 * b) for b in range(4)])
    maps = [(at >> np.uint32(8)) ^ table[at & 255]]
    while len(maps) < 32:
        maps.append(_mapped(maps[-1], maps[-1]))
    return np.stack(maps)


def _mapped(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for b in range(1, 4):
        out = out ^ tables[b][(crc >> np.uint32(8 * b)) & 255]
    return out


_ZEROS = _zero_tables()


def followed(crc: np.ndarray, length: np.ndarray, next_crc: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with ``crc``, each followed by a string of ``length`` bytes with ``next_crc``."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = _mapped(_ZEROS[k], out[at])
    return out ^ next_crc


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature, and the number of words of every row."""
    lower, starts, ends, rows = words(data, offsets)
    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(lower[_WORD[lower]]))]).dictionary_encode()
    known = np.array([zlib.crc32(w) for w in each.dictionary.to_pylist()], np.uint32)
    crc = known[each.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint32)
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = followed(space, lengths, crc)
    run, found, at = crc, [crc], [rows]
    for n in range(1, ngram):
        run = followed(run[:-1], lengths[n:] + 1, spaced[n:])
        inside = rows[: len(run)] == rows[n:]
        found.append(run[inside])
        at.append(rows[n:][inside])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(at), np.bincount(rows, minlength=len(offsets) - 1)


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """Features of all texts by bucket: one row per partition and bucket is shuffled, one per bucket reaches the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            total += np.bincount(feature_buckets(*utf8(part.column("text")), buckets, ngram)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    table = own(texts, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over corpus frequency by bucket, one added to each count, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(key: Column, seed: int = 42) -> Column:
    """Thousandths of a Gumbel variate from the digest of ``seed:key``, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", seed: int = 42, buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """Per document: key, n_words, n_features, weight and score."""
    array = gains(feature_counts(docs, buckets, ngram), feature_counts(target, buckets, ngram))
    shared = docs.sparkSession.sparkContext.broadcast(array)

    def run(batches):
        for part in slices(batches):
            bucket, row, n_words = feature_buckets(*utf8(part.column("text")), buckets, ngram)
            n = np.bincount(row, minlength=part.num_rows)
            weight = np.bincount(row, shared.value[bucket], part.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n_words), pa.array(n), pa.array(weight)], [key, "n_words", "n_features", "weight"])

    d = own(docs, key, "text")
    schema = T.StructType([d.schema[key], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    return d.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col(key), seed))


class Tournament:
    """A winner tree over players, each with a current key or none; the least key is at the root."""

    def __init__(self):
        self.size, self.tree = 1, [None, None]

    def put(self, player: int, key: tuple | None) -> None:
        """A player's new key, replayed against the others up to the root."""
        while player >= self.size:
            self.size *= 2
            leaves = self.tree[self.size // 2 :] + [None] * (self.size // 2)
            self.tree = [None] * self.size + leaves
            for i in range(self.size - 1, 0, -1):
                self.tree[i] = self._winner(i)
        at = self.size + player
        self.tree[at] = None if key is None else (key, player)
        while at > 1:
            at //= 2
            self.tree[at] = self._winner(at)

    def _winner(self, i: int) -> tuple | None:
        a, b = self.tree[2 * i], self.tree[2 * i + 1]
        return b if a is None else a if b is None or a <= b else b

    def top(self) -> tuple | None:
        return self.tree[1]


def merge_blocks(blocks: Iterator[tuple[int, list]], most: int) -> Iterator[tuple[object, bool]]:
    """Rows of sorted blocks (run, rows as ``(key, value)``) that come in order of their first keys: the first ``most``
    in order, marked true, and the others in any order, marked false."""
    tree, queues, player = Tournament(), [], {}
    coming = next(blocks, None)
    while most > 0:
        while coming is not None and (tree.top() is None or coming[1][0][0] <= tree.top()[0]):
            at = player.setdefault(coming[0], len(player))
            if at == len(queues):
                queues.append(deque())
            queues[at].append(deque(coming[1]))
            if len(queues[at]) == 1:
                tree.put(at, queues[at][0][0][0])
            coming = next(blocks, None)
        if tree.top() is None:
            return
        at = tree.top()[1]
        yield queues[at][0].popleft()[1], True
        most -= 1
        if not queues[at][0]:
            queues[at].popleft()
        tree.put(at, queues[at][0][0][0] if queues[at] else None)
    for queue in queues:
        for block in queue:
            yield from ((value, False) for _, value in block)
    while coming is not None:
        yield from ((value, False) for _, value in coming[1])
        coming = next(blocks, None)


_ORDER = [("range", "ascending"), ("score", "descending"), ("key", "ascending"), ("n_features", "ascending")]
_VALUES = ("key", "n_features", "weight", "score")


def sorted_runs(rows: DataFrame, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (range, key, n_features, weight, score) as blocks of sorted runs of each partition: range, run, the first
    row's score, key and features, and lists of the values."""

    def run(batches):
        held, n, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def blocks():
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pc.sort_indices(table, sort_keys=_ORDER, null_placement="at_end"))
            of = table["range"].to_numpy()
            borders = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
            starts = np.concatenate([np.arange(a, b, block_rows) for a, b in zip(borders[:-1], borders[1:])])
            counts = np.diff(np.concatenate([starts, [len(of)]]))
            heads = table.take(pa.array(starts))
            lists = [list_array(table[c].combine_chunks(), counts) for c in _VALUES]
            run_id = pa.array(np.full(len(starts), (part << 20) + number, np.int64))
            columns = [heads["range"], run_id, *[heads[c] for c in ("score", "key", "n_features")], *lists]
            yield from pa.table(columns, ["range", "run", "score", "key", "n_features", *[f"{c}_list" for c in _VALUES]]).combine_chunks().to_batches(4096)

        for batch in batches:
            for at in range(0, batch.num_rows, run_rows):
                held.append(batch.slice(at, run_rows))
                n += held[-1].num_rows
                if n >= run_rows:
                    yield from blocks()
                    held, n, number = [], 0, number + 1
        if n:
            yield from blocks()

    of = rows.schema
    fields = [T.StructField("range", T.IntegerType()), T.StructField("run", T.LongType()), of["score"], of["key"], of["n_features"]]
    return rows.select("range", *_VALUES).mapInArrow(run, T.StructType([*fields, *[T.StructField(f"{c}_list", T.ArrayType(of[c].dataType)) for c in _VALUES]]))


def merged_runs(runs: DataFrame, first: dict[int, int], draw: int) -> DataFrame:
    """Rows of the runs with their rank: ``first`` has the number of rows before each range; ranks end at ``draw``."""

    def run(batches):
        def blocks():
            for batch in batches:
                for r in batch.to_pylist():
                    values = list(zip(*[r[f"{c}_list"] for c in _VALUES]))
                    yield r["range"], r["run"], [((-v[3], v[0] is None, v[0] if v[0] is not None else 0, v[1]), v) for v in values]

        def of_range(number, head, rest, over):
            yield head[1:]
            for block in rest:
                if block[0] != number:
                    over.append(block)
                    return
                yield block[1:]

        every = blocks()
        head = next(every, None)
        while head is not None:
            number, over, out, rank = head[0], [], [], first[head[0]]
            for value, drawn in merge_blocks(of_range(number, head, every, over), draw - rank):
                rank += drawn
                out.append((*value, rank if drawn else None))
                if len(out) == 8192:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
            head = over[0] if over else None

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*_VALUES, "rank"])

    fields = [T.StructField("key", runs.schema["key"].dataType), *[T.StructField(c, T.LongType()) for c in (*_VALUES[1:], "rank")]]
    types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in fields]
    # blocks of one range go to one task, in the order of their first rows
    dealt = runs.repartition(len(first), "range").sortWithinPartitions("range", F.col("score").desc(), F.col("key").asc_nulls_last(), "n_features")
    return dealt.mapInArrow(run, T.StructType(fields))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = 5, least_words: int = 20, seed: int = 42, **sizes) -> DataFrame:
    """Every document's key, n_features, weight, score and rank: of those with ``least_words``, ``percent`` of a hundred
    are drawn, the highest scores, and numbered from 1; the others have no rank."""
    scored = stage(weigh(docs, target, key, seed).withColumnRenamed(key, "key"), "resample-scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    draw = percent * eligible.count() // 100
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if draw == 0:
        return scored.select(*columns, unranked)
    ranges = max(1, min(RANGES, math.ceil(draw / sizes.get("range_rows", RANGE_ROWS))))
    # borders between ranges may be approximate, as the rows of each range are counted exactly
    share = [max(0.0, 1 - percent / 100 * i / ranges) for i in range(1, ranges + 1 + ranges // 4)]
    borders = sorted(set(eligible.agg(F.percentile_approx("score", share, 20_000)).first()[0]), reverse=True)
    number = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: F.col("score") < b))
    counts = dict(eligible.groupBy(number.alias("range")).count().collect())
    first, before = {}, 0
    for r in sorted(counts):
        if before >= draw:
            break
        first[r], before = before, before + counts[r]
    last = max(first)
    within = F.lit(True) if last == len(borders) else F.col("score") >= borders[last]
    runs = stage(sorted_runs(eligible.where(within).withColumn("range", number), sizes.get("run_rows", RUN_ROWS), sizes.get("block_rows", BLOCK_ROWS)), "resample-runs")
    rest = scored.where((F.col("n_words") < least_words) | ~within)
    return merged_runs(runs, first, draw).select(*columns, "rank").unionAll(rest.select(*columns, unranked))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)
