"""Token ids as directly addressable codes (DAC).

Documents are put in ascending id order by range partitions, tokenized, ended with an end id and packed into blocks
of whole documents. A block splits each id into chunks of eight bits, least significant first. Level 0 holds the
first chunk of every id; a bitmap tells which ids continue on the next level, and a rank directory holds the number
of set bits before every 512th position. The place of an id on the next level is the rank of its place on this one,
so :func:`access` reads any id of a block by one chunk, one bit and one rank per level, without decoding the rest.

File format: Parquet rows ``(part, block, n_tokens, ids, lens, levels, bitmaps, ranks)``, one row per block, in
(part, block) order; ``ids`` and ``lens`` are the documents' ids and token counts; ``levels``, ``bitmaps`` (little
bit order) and ``ranks`` (little-endian unsigned 32 bits) have one binary per level. Spark's writers commit whole
tasks, so a lost executor's blocks are written again.

Defined results: a null or empty text is the end id alone; null ids come first; rows with equal ids follow each
other in text order; an empty table makes no blocks; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import list_array, own, slices, stage, utf8

CHUNK_BITS, RANK_STEP = 8, 512
BLOCK_TOKENS, CACHE_PIECES = 1 << 18, 300_000
#: Texts of these characters only are cut into the tokenizer's pieces here and each piece is encoded once per worker;
#: all other texts go to the tokenizer whole. The pattern is the byte-level pre-tokenizer's published one (fixed
#: value), with letters and numbers spelled out for this range and its first two groups of branches exchanged, which
#: start with different characters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PIECES = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")


def dac_encode(values: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of unsigned integers."""
    levels, bitmaps, ranks = [], [], []
    rest = values.astype(np.uint64)
    while True:
        more = rest >> np.uint64(CHUNK_BITS)
        on = more > 0
        levels.append((rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(on, bitorder="little").tobytes())
        run = np.zeros(len(rest) + 1, np.uint32)
        np.cumsum(on, out=run[1:])
        ranks.append(run[:-1:RANK_STEP].astype("<u4").tobytes())
        if not on.any():
            return levels, bitmaps, ranks
        rest = more[on]


def dac_decode(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All values of a block."""
    out = np.frombuffer(levels[0], np.uint8).astype(np.uint64)
    at = np.arange(len(out))
    for j in range(1, len(levels)):
        on = np.unpackbits(np.frombuffer(bitmaps[j - 1], np.uint8), count=len(at), bitorder="little").astype(bool)
        at = at[on]
        out[at] |= np.frombuffer(levels[j], np.uint8).astype(np.uint64) << np.uint64(CHUNK_BITS * j)
    return out


def access(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The value at place ``i``, without decoding others."""
    value = 0
    for j in range(len(levels)):
        value |= levels[j][i] << (CHUNK_BITS * j)
        if not bitmaps[j][i >> 3] >> (i & 7) & 1:
            break
        base = i // RANK_STEP
        rank = int.from_bytes(ranks[j][4 * base : 4 * base + 4], "little")
        first, last = base * RANK_STEP >> 3, i >> 3
        rank += int.from_bytes(bitmaps[j][first:last], "little").bit_count() + (bitmaps[j][last] & ((1 << (i & 7)) - 1)).bit_count()
        i = rank
    return value


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Ids of pieces, as bytes; a piece that is not known yet goes to the model."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Little-endian 32-bit ids of texts, by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known = _Known(self.model.model)
        # Only a plain byte-level tokenizer cuts texts into PIECES; texts with one of its added tokens go to it whole.
        cuts = self.model.pre_tokenizer
        made = json.loads(cuts.__getstate__()) if cuts is not None else {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_piece = self.model.normalizer is None and plain.items() <= made.items() and not self.model.model.dropout and self.model.truncation is None
        self.added = [x.content for x in self.model.get_added_tokens_decoder().values()]

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_piece and bool(PLAIN.fullmatch(t)) and not any(a in t for a in self.added) for t in texts]
        whole = iter(self.raw([t for t, p in zip(texts, plain) if not p]))
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        get = self.known.__getitem__
        return [b"".join(map(get, PIECES.findall(t))) if p else next(whole) for t, p in zip(texts, plain)]


#: One encoder a worker process and path: its pieces serve all tasks of the worker.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def encode(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The blocks of all documents, one row each. ``tokenizer`` is a path that every executor has."""
    path = tokenizer or default_tokenizer()
    d = own(docs, key, "text").withColumnRenamed(key, "doc_id")
    ids = d.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = _schema(f"part int, block int, n_tokens bigint, ids array<{ids}>, lens array<bigint>, levels array<binary>, bitmaps array<binary>, ranks array<binary>")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block = encoder_of(path), TaskContext.get().partitionId(), 0
        held, lens, size = [], [], 0
        names: list[pa.Array] = []

        def pack():
            levels, bitmaps, ranks = dac_encode(np.frombuffer(b"".join(held), "<u4"))
            ids = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size]), list_array(ids, np.array([len(ids)])), pa.array([lens], pa.list_(pa.int64()))]
                + [pa.array([x], pa.list_(pa.binary())) for x in (levels, bitmaps, ranks)],
                schema.names,
            )

        for rows in slices(batches):
            coded = encoder([t or "" for t in rows.column("text").to_pylist()])
            held += [x + end for x in coded]
            lens += [len(x) // 4 + 1 for x in coded]
            size += sum(lens[-len(coded) :])
            names.append(rows.column("doc_id"))
            if size >= block_tokens:
                yield pack()
                block += 1
                held, lens, size, names = [], [], 0, []
        if held:
            yield pack()

    return d.mapInArrow(run, schema)


def decode_documents(blocks: DataFrame) -> DataFrame:
    """Per document, read from the blocks: doc_id, start, n_tokens, ids_crc32, first_id and last_id.

    The last two are read by :func:`access` alone, through bitmaps and rank directories."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = _schema(f"part int, block int, doc_id {kind}, within bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint, last_id bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                lens = row.column("lens").flatten().to_numpy()
                levels, bitmaps, ranks = ([x.as_py() for x in row.column(c).flatten()] for c in ("levels", "bitmaps", "ranks"))
                values = dac_decode(levels, bitmaps)
                raw = memoryview(values.astype("<u4").tobytes())
                starts = np.cumsum(lens) - lens
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lens.tolist())]
                ends = [pa.array([access(levels, bitmaps, ranks, i) for i in at.tolist()], pa.int64()) for at in (starts, starts + lens - 1)]
                same = lambda c: pa.array(np.full(len(lens), row.column(c)[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([same("part"), same("block"), row.column("ids").flatten(), pa.array(starts), pa.array(lens), pa.array(crc, pa.int64()), *ends], schema.names)

    # Offsets of blocks: of the parts (one row per task of the writer) and within each part.
    sizes = blocks.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(W.orderBy("part")).alias("base"))
    sizes = sizes.select("part", "block", before(W.partitionBy("part").orderBy("block")).alias("inner")).join(parts, "part")
    docs = blocks.select("part", "block", "ids", "lens", "levels", "bitmaps", "ranks").mapInArrow(run, schema)
    return docs.join(sizes, ["part", "block"]).select("doc_id", (F.col("base") + F.col("inner") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "first_id", "last_id")


def token_table(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Write the blocks to the shared folder and read every document back from them."""
    return decode_documents(stage(encode(docs, key, **options), "dac-blocks")).withColumnRenamed("doc_id", key)


def op8_token_ids(spark, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
