"""Media columns: content-defined payload chunking with a deduplicated chunk store.

A payload (8-bit samples) is cut where a rolling gear hash meets a mask, between a least and a most chunk length.
A chunk is named by its sha256. Digests are counted by Spark; chunks that may occur more than once go to a chunk
table that holds each digest once, all others stay inside their document's row. The ordered chunk list of a row
names every chunk, so a payload is rebuilt from its own row and, for shared chunks, by a Spark join with the chunk
table on the digest; each chunk is verified against its digest, and the whole against the payload's.

Which chunks may be shared is told by a bitmap of fixed size (8 MB) over digests that occur twice: a false positive
only moves a chunk that occurs once to the chunk table, where it is still stored once. Payload bytes are never
shuffled on writing, other than the shared chunks.

Stored form of one medium (what media_bytes and media_sha256 describe): ``MDC1``, payload length (8 bytes), chunk
count (4 bytes), then per chunk its length (4 bytes), digest (32 bytes) and samples; integers little-endian.

Defined results: a null or empty text is the payload of 192 padding bytes; equal texts give equal values in every
row; rows with equal ids are stored each; an empty table gives empty stores; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import Bitmap, list_array, map_texts, mix, own, stage, utf8

FRAME, PAD = 192, 32
LEAST, MOST, MASK_BITS, GEAR_WINDOW = 256, 8192, 10, 32
MAGIC = b"MDC1"
#: The gear table: one 32-bit number for each byte value, from the finaliser in ``common``.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' bytes padded to positive multiples of ``FRAME``: samples, offsets, unpadded lengths."""
    n = np.diff(offsets)
    full = np.maximum(1, -(-n // FRAME)) * FRAME
    to = np.concatenate([[0], np.cumsum(full)])
    out = np.full(to[-1], PAD, np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(data)) + (to[:-1] - offsets[:-1])[row]] = data
    return out, to, n


def gear_hash(samples: np.ndarray) -> np.ndarray:
    """At every place, sum of gear[sample[i - k]] << k over the last ``GEAR_WINDOW`` samples, in log2 many passes."""
    h = GEAR[samples]
    width = 1
    while width < GEAR_WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(samples: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk bounds inside each payload: ends, and chunks per payload. A cut depends on its payload alone."""
    ends: list[int] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    mask = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))
    marks = np.flatnonzero(gear_hash(samples) & mask == 0) + 1
    bounds = np.searchsorted(marks, offsets)
    for r in range(len(counts)):
        at, end = int(offsets[r]), int(offsets[r + 1])
        first = len(ends)
        i, last = bounds[r], bounds[r + 1]
        while end - at > LEAST:
            # The first GEAR_WINDOW samples of a chunk may see those before the payload: LEAST keeps them out.
            i += np.searchsorted(marks[i:last], at + LEAST)
            cut = min(int(marks[i]) if i < last else end, at + MOST, end)
            if cut >= end:
                break
            ends.append(cut)
            at = cut
        ends.append(end)
        counts[r] = len(ends) - first
    return np.array(ends, np.int64), counts


def _chunked(part: pa.RecordBatch):
    samples, to, n = payloads(*utf8(part.column("text")))
    ends, counts = cuts(samples, to)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    raw = memoryview(samples.tobytes())
    digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist())]
    return raw, to, n, starts, ends, counts, digests


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, 0] if digests else np.zeros(0, np.uint64)


def repeated_digests(docs: DataFrame) -> Bitmap:
    """Digests (by their first 64 bits) that occur more than once in the table."""

    def run(part):
        u, n = np.unique(_keys(_chunked(part)[6]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["digest", "n"])

    counts = map_texts(own(docs, "text"), run, "digest bigint, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    return Bitmap.of(counts.where("n > 1"), "digest", 26)


def store(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Write the media rows and the chunk table to the shared folder; returns both as read back.

    Media rows: uid, key, n_bytes, payload_bytes, payload_sha256, lens, digests, inline (samples of the chunks that
    are in no other row, joined in order) and shared (per chunk: whether the chunk table has it). Chunk table:
    digest, samples.
    """
    d = own(docs, key, "text").withColumn("uid", F.monotonically_increasing_id())
    repeated = docs.sparkSession.sparkContext.broadcast(repeated_digests(docs))
    kind = d.schema[key].dataType.simpleString()

    def rows(part):
        raw, to, n, starts, ends, counts, digests = _chunked(part)
        shared = repeated.value.test(_keys(digests))
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        inline = [b"".join(raw[starts[c] : ends[c]] for c in range(a, b) if not shared[c]) for a, b in zip(bounds, bounds[1:])]
        whole = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(to.tolist(), to[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [part.column("uid"), part.column(key), pa.array(n), pa.array(np.diff(to)), pa.array(whole, pa.binary())]
            + [list_array((ends - starts).astype(np.int32), counts), list_array(pa.array(digests, pa.binary()), counts), pa.array(inline, pa.binary()), list_array(pa.array(shared), counts)],
            ["uid", key, "n_bytes", "payload_bytes", "payload_sha256", "lens", "digests", "inline", "shared"],
        )

    def chunks(part):
        raw, _, _, starts, ends, _, digests = _chunked(part)
        once = {}
        for c in np.flatnonzero(repeated.value.test(_keys(digests))).tolist():
            once.setdefault(digests[c], bytes(raw[starts[c] : ends[c]]))
        return pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array(list(once.values()), pa.binary())], ["digest", "samples"])

    media = map_texts(
        d, rows, f"uid bigint, `{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 binary, lens array<int>, digests array<binary>, inline binary, shared array<boolean>"
    )
    table = map_texts(d.select("text"), chunks, "digest binary, samples binary").groupBy("digest").agg(F.first("samples").alias("samples"))
    return stage(media, "media-rows"), stage(table, "media-chunks")


def _features(samples: np.ndarray) -> str:
    """Simple facts of the samples: mean, standard deviation, entropy of values in bits, mean absolute step."""
    n = np.bincount(samples, minlength=256)
    p = n[n > 0] / len(samples)
    x = np.arange(256)
    mean = float((n * x).sum()) / len(samples)
    sd = max(0.0, float((n * x * x).sum()) / len(samples) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(samples.astype(np.int16))).sum()) / max(1, len(samples) - 1)
    return f"mean={mean:.4f};sd={sd:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def _rebuilt(lens: list[int], digests: list[bytes], inline: bytes, shared: list[bool], found: dict[int, bytes]) -> tuple[bytes, bytes]:
    """Payload and stored form of one medium, every chunk verified. ``found``: samples of shared chunks by place."""
    chunks, at = [], 0
    for i, (size, here) in enumerate(zip(lens, shared)):
        if here:
            chunks.append(found[i])
        else:
            chunks.append(inline[at : at + size])
            at += size
    for size, digest, chunk in zip(lens, digests, chunks):
        if len(chunk) != size or hashlib.sha256(chunk).digest() != digest:
            raise ValueError("a chunk does not match its digest")
    payload = b"".join(chunks)
    form = [MAGIC, struct.pack("<QI", len(payload), len(lens))]
    for size, digest, chunk in zip(lens, digests, chunks):
        form += [struct.pack("<I", size), digest, chunk]
    return payload, b"".join(form)


def read_media(media: DataFrame, table: DataFrame, key: str = "doc_id", with_payload: bool = False) -> DataFrame:
    """Rebuild and verify every payload; one row per media row with digests and features, and the payload if asked."""
    refs = (
        media.where(F.exists("shared", lambda x: x))
        .select("uid", F.posexplode(F.arrays_zip("digests", "shared")).alias("place", "c"))
        .where("c.shared")
        .select("uid", "place", F.col("c.digests").alias("digest"))
    )
    fetched = refs.join(table, "digest").groupBy("uid").agg(F.collect_list(F.struct("place", "samples")).alias("fetched"))
    alone = media.where(~F.exists("shared", lambda x: x)).withColumn("fetched", F.lit(None).cast(fetched.schema["fetched"].dataType))
    both = alone.unionByName(media.where(F.exists("shared", lambda x: x)).join(fetched, "uid"))
    kind = media.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks int" + ", payload binary" * with_payload
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("n_bytes", "payload_bytes", "payload_sha256", "lens", "digests", "inline", "shared", "fetched")}
                found = {x["place"]: x["samples"] for x in row["fetched"] or ()}
                payload, form = _rebuilt(row["lens"], row["digests"], row["inline"], row["shared"], found)
                if hashlib.sha256(payload).digest() != row["payload_sha256"]:
                    raise ValueError("a payload does not match its digest")
                samples = np.frombuffer(payload, np.uint8)
                out.append(
                    (row["n_bytes"], len(payload), row["payload_sha256"].hex(), zlib.crc32(payload[-16:]), len(form), hashlib.sha256(form).hexdigest(), _features(samples), len(row["lens"]))
                    + (payload,) * with_payload
                )
            columns = list(zip(*out)) if out else [()] * (len(schema.names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema.names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "lens", "digests", "inline", "shared", "fetched"]
    return both.select(*names).mapInArrow(run, schema)


def op1_media_chunks(spark, sf_dir: str) -> DataFrame:
    return read_media(*store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
