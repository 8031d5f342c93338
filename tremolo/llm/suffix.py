"""Exact substring dedup by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: a byte position belongs to the phrase of the least 16-byte hash
that starts in the next 100 bytes (leftmost on ties). A trigger depends on nothing but those bytes, so equal strings
of ``length`` bytes have the same trigger at the same distance, and the first 101 bytes from the trigger on (the
*core*) in common. A phrase occurrence with all bytes that its strings cover is a *block*: the phrase up to the
trigger, then the parse that follows it to depth ``length``.

1. Cores that occur once (told by a bitmap of fixed size, false positives only cost work) end there.
2. The dictionary holds each distinct block once, known by a cryptographic digest. A block that occurs twice makes
   all its strings repeated. Only cores with several blocks need the order, and each block once, however often it
   occurs.
3. Blocks of a core are put in corpus order by their bytes. The suffix array of the parse ranks what follows the
   triggers and gives the common prefix of neighbours; the suffix array of the dictionary is made from the trigger
   leftwards, one byte of the phrases at a time, and stays sorted by (phrase suffix, rank of the parse), which is
   the order of the corpus' suffixes. A string is repeated if and only if a neighbour in that order has the same
   phrase suffix and a common prefix of ``length`` bytes in all.

A task orders whole cores, of at most ``limit`` blocks. Cores with more are dealt anew by the bytes that all strings
of a run of 25 distances to the trigger have in common, and what is still larger by single strings, which are counted
by their digests with partial sums: no group of unbounded size comes to one task, and nothing is left out.

Defined results: a null or empty text has no bytes and nothing removed; strings never cross texts; rows with equal
ids are separate texts; a repeated row is removed whole in every place if it has ``length`` bytes; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import BASE, Bitmap, Spans, discard, list_array, map_texts, mix, own, stage, utf8

LENGTH, GRAM, WINDOW, RUN, LIMIT = 200, 16, 100, 25, 512


def packed(df: DataFrame) -> DataFrame:
    """``df`` with each text in ``raw`` compressed by itself: what is shuffled next is smaller."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            raw = [codec.compress(x.as_buffer()).to_pybytes() if x.is_valid else None for x in batch.column("raw")]
            yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(raw, pa.binary()))

    return df.mapInArrow(pack, df.schema)


def unpacked(batch: pa.RecordBatch, row: int) -> bytes:
    """The bytes of a row's text."""
    return pa.Codec("zstd").decompress(batch.column("raw")[row].as_buffer(), batch.column("n_bytes")[row].as_py(), asbytes=True)


def digests(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each part, as two longs."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def triggers(data: np.ndarray) -> np.ndarray:
    """For each position, the place of the least hash of ``GRAM`` bytes that starts in the next ``WINDOW`` bytes."""
    h, width, power = _BYTES[data], 1, int(BASE)
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * np.uint64(power) + h[width:]
            width, power = 2 * width, power * power % (1 << 64)
    m = (mix(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (WINDOW - width)], m[WINDOW - width :])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Phrase occurrences of strings that fit into their text: text, first position in it, positions, distance of the
    trigger from the first, hash of the core."""
    size = np.diff(offsets)
    if len(data) < length or not (size >= length).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    fits = np.zeros(len(data) + 1, np.int32)
    ok = size >= length
    np.add.at(fits, offsets[:-1][ok], 1)
    np.add.at(fits, offsets[1:][ok] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    m = triggers(data)[at]
    row = np.repeat(np.arange(len(size)), np.where(ok, size - length + 1, 0))
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, trigger, row = at[first], m[first], row[first]
    return row, start - offsets[row], count, trigger - start, Spans(data)(trigger, trigger + length - WINDOW + 1)


def repeated_cores(docs: DataFrame, length: int = LENGTH) -> Bitmap:
    def run(part):
        u, n = np.unique(phrases(*utf8(part.column("text")), length)[4], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["core", "n"])

    counts = map_texts(own(docs, "text"), run, "core bigint, n tinyint").groupBy("core").agg(F.sum("n").alias("n"))
    return Bitmap.of(counts.where("n > 1"), "core", 27)


def ordered(group: np.ndarray, blocks: list[bytes], lead: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """(blocks, distances) whether the string at that distance before the trigger is also in another block of the group.

    ``lead`` and ``count`` say which distances a block has (lead - count + 1 .. lead), ``low`` and ``high`` which ones
    are asked.
    """
    n = len(blocks)
    out = np.zeros((n, WINDOW), bool)
    if n < 2:
        return out
    # Suffix array of the parse: what follows the triggers, to depth ``length``, in byte order within the groups.
    follow = [g.to_bytes(8, "big") + b[t:] for g, b, t in zip(group.tolist(), blocks, lead.tolist())]
    order = np.array(sorted(range(n), key=follow.__getitem__))
    table = np.frombuffer(b"".join([follow[k].ljust(8 + length, b"\0") for k in order]), np.uint8).reshape(n, 8 + length)
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(1), differ.argmax(1), 8 + length) - 8  # prefixes of neighbours; negative between groups
    phrase = np.frombuffer(b"".join([b[:t].rjust(WINDOW, b"\0") for b, t in ((blocks[k], int(lead[k])) for k in order)]), np.uint8).reshape(n, WINDOW)
    lead, near, low, high = lead[order], (lead - count + 1)[order], low[order], high[order]
    # Suffix array of the dictionary, longer by one byte of the phrases each step; ``at`` is the combined order.
    at, suffix = np.arange(n), group[order]
    for distance in range(min(WINDOW, int(lead.max()) + 1)):
        if distance:
            on = lead[at] >= distance
            at, suffix = at[on], suffix[on]
            if not len(at):
                break
            refined = suffix * 256 + phrase[at, WINDOW - distance]
            turn = np.argsort(refined, kind="stable")
            at, refined = at[turn], refined[turn]
            suffix = np.zeros(len(at), np.int64)
            np.cumsum(refined[1:] != refined[:-1], out=suffix[1:])
            pair = suffix[1:] == suffix[:-1]  # a phrase suffix that only one block has needs no longer ones
            on = np.concatenate([pair, [False]]) | np.concatenate([[False], pair])
            at, suffix = at[on], suffix[on]
        depth = np.zeros(n, np.int64)
        np.cumsum(common < length - distance, out=depth[1:])  # equal: common prefix of length - distance bytes
        on = (near[at] <= distance) & (low[at] <= distance) & (distance <= high[at])
        k, s = at[on], suffix[on]
        same = (s[1:] == s[:-1]) & (depth[k[1:]] == depth[k[:-1]])
        out[order[k[1:][same]], distance] = out[order[k[:-1][same]], distance] = True
    return out


_ITEM = "d1 bigint, d2 bigint, repeated boolean, lead int, count int, low int, high int, bytes binary"


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "count", "low", "high"))


def order_tasks(items: DataFrame, length: int) -> DataFrame:
    """(d1, d2, first, count): runs of repeated strings of the blocks, from whole groups (task, low) in corpus order."""
    schema = "d1 bigint, d2 bigint, first int, count int"

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        task, (lead, count, low, high) = batch.column("task").to_numpy(), _columns(batch)
        group = np.zeros(batch.num_rows, np.int64)
        np.cumsum((task[1:] != task[:-1]) | (low[1:] != low[:-1]), out=group[1:])
        found = ordered(group, batch.column("bytes").to_pylist(), lead, count, low, high, length)
        found &= ~batch.column("repeated").to_numpy(zero_copy_only=False)[:, None]
        # Distances fall where positions rise: a run of distances a .. b is one of positions lead - b .. lead - a.
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1]
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("d1", "d2")] + [pa.array((lead[row] - b + 1).astype(np.int32)), pa.array((b - a).astype(np.int32))], ["d1", "d2", "first", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            task, low = held.column("task").to_numpy(), held.column("low").to_numpy()
            turn = np.flatnonzero((task[1:] != task[:-1]) | (low[1:] != low[:-1]))
            if len(turn):  # the last group may go on in the next batch
                yield settle(held.slice(0, int(turn[-1]) + 1))
                held = held.slice(int(turn[-1]) + 1)
        if held is not None:
            yield settle(held)

    return items.repartition("task").sortWithinPartitions("task", "low").mapInArrow(run, schema)


def _by_runs(length: int):
    """Blocks of large cores, once for each run of distances that they have, under what all strings of the run cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, task, (lead, count, _, _) = batch.column("bytes").to_pylist(), batch.column("task").to_numpy(), _columns(batch)
            bottom, top = (lead - count + 1) // RUN, lead // RUN
            n = top - bottom + 1
            k = np.repeat(np.arange(len(n)), n)
            q = bottom[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            begin, end = lead[k] - q * RUN, lead[k] + length - (q * RUN + RUN - 1)
            inner = digests(int(task[j]).to_bytes(8, "big", signed=True) + bytes([r]) + blocks[j][a:b] for j, r, a, b in zip(k.tolist(), q.tolist(), begin.tolist(), end.tolist()))[0]
            out = batch.take(pa.array(k))
            for name, value in (("task", inner), ("low", (q * RUN).astype(np.int32)), ("high", (q * RUN + RUN - 1).astype(np.int32))):
                out = out.set_column(out.schema.get_field_index(name), name, pa.array(value))
            yield out

    return run


def _by_strings(length: int):
    """Every string asked of a block, by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, (lead, count, low, high) = batch.column("bytes").to_pylist(), _columns(batch)
            a, b = np.maximum(lead - count + 1, low), np.minimum(lead, high)
            n = b - a + 1
            k = np.repeat(np.arange(len(n)), n)
            first = (lead - b)[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            s1, s2 = digests(blocks[j][x : x + length] for j, x in zip(k.tolist(), first.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(k)) for c in ("d1", "d2", "repeated")] + [pa.array(first.astype(np.int32)), pa.array(s1), pa.array(s2)], ["d1", "d2", "repeated", "first", "s1", "s2"])

    return run


def repeated_strings(blocks: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """(d1, d2, first, count) of blocks (core, of_core, d1, d2, repeated, lead, count, bytes); ``of_core`` is the number
    of distinct blocks that the core has."""
    items = blocks.select(F.col("core").alias("task"), "of_core", "d1", "d2", "repeated", "lead", "count", F.lit(0).alias("low"), F.lit(WINDOW - 1).alias("high"), "bytes")
    small = items.where(F.col("of_core") <= limit).drop("of_core")
    runs = stage(items.where(F.col("of_core") > limit).drop("of_core").mapInArrow(_by_runs(length), small.schema), "suffix-runs")
    sizes = stage(runs.groupBy("task", "low").agg(F.count("*").alias("of_task")).where("of_task > 1"), "suffix-run-sizes")
    sized = runs.join(sizes, ["task", "low"])
    singles = sized.where(F.col("of_task") > limit).select(*small.columns).mapInArrow(_by_strings(length), "d1 bigint, d2 bigint, repeated boolean, first int, s1 bigint, s2 bigint")
    singles = stage(singles, "suffix-strings")
    equal = stage(singles.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2"), "suffix-equal")
    by_string = singles.where("not repeated").join(equal, ["s1", "s2"]).select("d1", "d2", "first", F.lit(1).alias("count"))
    by_order = order_tasks(small.unionByName(sized.where(F.col("of_task") <= limit).select(*small.columns)), length)
    return by_order.unionByName(by_string)


def removed_spans(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """Per document: key, n_bytes, n_removed, spans (array of start and end of maximal removed runs), kept_sha256."""
    if length < WINDOW + GRAM:
        raise ValueError(f"length must be at least {WINDOW + GRAM}")
    repeated = docs.sparkSession.sparkContext.broadcast(repeated_cores(docs, length))
    d = own(docs, key, "text").withColumnRenamed(key, "id").withColumn("uid", F.monotonically_increasing_id())
    kind = d.schema["id"].dataType.simpleString()

    def parse(part):
        data, offsets = utf8(part.column("text"))
        row, start, count, lead, core = phrases(data, offsets, length)
        on = repeated.value.test(core)
        row, start, count, lead, core = (x[on] for x in (row, start, count, lead, core))
        n = np.bincount(row, minlength=part.num_rows)
        raw = data.tobytes()
        whole = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        begin = offsets[row] + start
        d1, d2 = digests(raw[a:b] for a, b in zip(begin.tolist(), (begin + count - 1 + length).tolist()))
        items = pa.StructArray.from_arrays(
            [pa.array(x) for x in (core.view(np.int64), d1, d2, start.astype(np.int32), count.astype(np.int32), lead.astype(np.int32))], ["core", "d1", "d2", "start", "count", "lead"]
        )
        return pa.RecordBatch.from_arrays(
            [part.column("uid"), part.column("id"), pa.array(np.diff(offsets)), pa.array([hashlib.sha256(x).hexdigest() for x in whole])]
            + [pa.array([x if k else None for x, k in zip(whole, n)], pa.binary()), list_array(items, n)],
            ["uid", "id", "n_bytes", "sha256", "raw", "phrases"],
        )

    parsed = map_texts(
        d, parse, f"uid bigint, id {kind}, n_bytes bigint, sha256 string, raw binary, phrases array<struct<core:bigint,d1:bigint,d2:bigint,start:int,count:int,lead:int>>"
    )
    parsed = stage(parsed, "suffix-parse")
    occurrences = parsed.select("uid", F.explode("phrases").alias("p")).select("uid", "p.*")
    one = [F.first(c).alias(c) for c in ("core", "uid", "start", "count", "lead")]  # of one occurrence, whichever comes first
    dictionary = stage(occurrences.groupBy("d1", "d2").agg(F.count("*").alias("n"), *one), "suffix-dictionary")
    mixed = stage(dictionary.groupBy("core").agg(F.count("*").alias("of_core")).where("of_core > 1"), "suffix-cores")
    asked = dictionary.join(mixed, "core").withColumn("repeated", F.col("n") > 1)
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("core", "of_core", "d1", "d2", "repeated", "start", "count", "lead")).alias("asked"))
    asked = asked.join(packed(parsed.select("uid", "n_bytes", "raw")), "uid").select("n_bytes", "raw", "asked")
    schema = "core bigint, of_core bigint, d1 bigint, d2 bigint, repeated boolean, lead int, count int, bytes binary"

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text, items = unpacked(batch, r), batch.column("asked")[r].values
                field = dict(zip((f.name for f in items.type), items.flatten()))
                start, end = (x.tolist() for x in (field["start"].to_numpy(), field["start"].to_numpy() + field["count"].to_numpy() - 1 + length))
                block = pa.array([text[a:b] for a, b in zip(start, end)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(field[c] for c in ("core", "of_core", "d1", "d2", "repeated", "lead", "count")), block], schema_names)

    schema_names = [x.split()[0] for x in schema.split(", ")]
    blocks = stage(asked.mapInArrow(contents, schema), "suffix-blocks")
    partly = repeated_strings(blocks, length, limit).groupBy("d1", "d2").agg(F.collect_list(F.struct("first", "count")).alias("parts"))
    verdict = dictionary.select("d1", "d2", (F.col("n") > 1).alias("all")).join(partly, ["d1", "d2"], "left").where("all or parts is not null")
    verdict = stage(verdict, "suffix-verdict")
    discard(dictionary, mixed, blocks)
    marks = occurrences.join(verdict, ["d1", "d2"]).groupBy("uid").agg(F.collect_list(F.struct("start", "count", "all", "parts")).alias("marks"))
    both = packed(parsed.drop("phrases")).join(marks, "uid", "left").select("id", "n_bytes", "sha256", F.when(F.col("marks").isNotNull(), F.col("raw")).alias("raw"), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, whole = batch.column("n_bytes").to_pylist(), batch.column("sha256").to_pylist()
            removed, spans = [0] * len(sizes), [[] for _ in sizes]
            for r in range(batch.num_rows):
                marks = batch.column("marks")[r].as_py()
                if not marks:
                    continue
                edge = np.zeros(sizes[r] + 1, np.int32)
                for m in marks:
                    for x in [{"first": 0, "count": m["count"]}] if m["all"] else m["parts"]:
                        edge[m["start"] + x["first"]] += 1
                        edge[m["start"] + x["first"] + x["count"] - 1 + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                data = np.frombuffer(unpacked(batch, r), np.uint8)
                whole[r] = hashlib.sha256(data[~gone].tobytes()).hexdigest()
                removed[r] = int(gone.sum())
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans[r] = [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(whole)], ["id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    found = both.mapInArrow(cut, f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    return found.withColumnRenamed("id", key)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
