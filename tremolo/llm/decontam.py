"""Benchmark decontamination: a prefix-filtered containment join over item-sized windows.

Every window of ten item words is a set of shingles (five words, or the whole window where it is shorter). A
document that contains the window contains all its shingles, so one shingle is a sufficient prefix: the rarest in
the corpus. Corpus frequencies are counted for the items' shingles, each window keeps its rarest one, documents
emit only the places of such shingles with the words around them, and a Spark join on the shingle proposes
(document, window) pairs. A pair survives the length and positional bounds (the window must fit into the words
around the place) and is verified word by word.

What is broadcast is one bitmap of fixed size (1 MB) that tells shingles which no item has.

Defined results: null or empty texts have no words, no hits and no items; items without words match nothing; an
empty items table leaves all documents clean; rows with equal ids are judged each by its own text; other columns
of either table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.llm.common import Bitmap, Spans, list_array, map_texts, own, shingle_hashes, stage, utf8, words

WINDOW, SHINGLE = 10, 5


def _windows(part: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct windows of each item, with their shingles."""
    item, text, length, shingle, offset = [], [], [], [], []
    data, offsets = utf8(part.column("text"))
    lower, starts, ends, rows = words(data, offsets)
    h = Spans(lower)(starts, ends)
    raw = lower.tobytes()
    ids = part.column("item_id")
    for r in range(part.num_rows):
        a, b = np.searchsorted(rows, [r, r + 1])
        seen = set()
        for i in range(a, b - min(WINDOW, b - a) + 1) if b > a else ():
            size = min(WINDOW, b - a)
            t = b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + size)).decode("utf-8", "replace")
            if t in seen:
                continue
            seen.add(t)
            hs, at = shingle_hashes(h[i : i + size], np.zeros(size, int), min(SHINGLE, size))
            item.append(ids[r].as_py())
            text.append(t)
            length.append(size)
            shingle.append(hs.view(np.int64).tolist())
            offset.append(at.tolist())
    return pa.RecordBatch.from_arrays(
        [pa.array(item, ids.type), pa.array(text, pa.string()), pa.array(length, pa.int32()), pa.array(shingle, pa.list_(pa.int64())), pa.array(offset, pa.list_(pa.int32()))],
        ["item_id", "window", "len", "shingle", "offset"],
    )


def _hashed(part: pa.RecordBatch, sizes: list[int], bitmap: Bitmap):
    data, offsets = utf8(part.column("text"))
    lower, starts, ends, rows = words(data, offsets)
    h = Spans(lower)(starts, ends)
    found = []
    for k in sizes:
        hs, at = shingle_hashes(h, rows, k)
        keep = bitmap.test(hs)
        found.append((hs[keep], at[keep]))
    hs, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return lower, starts, ends, rows, hs, at


def item_windows(items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """item_id, window (its words joined by spaces), len, shingle and offset arrays."""
    d = own(items, item_key, "text").withColumnRenamed(item_key, "item_id")
    kind = d.schema["item_id"].dataType.simpleString()
    return stage(map_texts(d, _windows, f"item_id {kind}, window string, len int, shingle array<bigint>, offset array<int>"), "decontam-windows")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items (array of ids as text, sorted), contaminated."""
    spark = docs.sparkSession
    windows = item_windows(items, item_key)
    sizes = sorted(r[0] for r in windows.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE values
    every = windows.select("window", "len", F.explode(F.arrays_zip("shingle", "offset")).alias("s")).select("window", "len", "s.shingle", "s.offset").distinct()
    bitmap = spark.sparkContext.broadcast(Bitmap.of(every, "shingle"))
    d = own(docs, key, "text").withColumnRenamed(key, "doc_id")
    kind = d.schema["doc_id"].dataType.simpleString()

    def count(part):
        hs = _hashed(part, sizes, bitmap.value)[4]
        u, n = np.unique(hs, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counts = map_texts(d.select("text"), count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarity = every.select("shingle").distinct().join(counts, "shingle", "left").select("shingle", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = (
        every.join(rarity, "shingle")
        .groupBy("window", "len")
        .agg(F.min(F.struct("n", "offset", "shingle")).alias("p"))
        .where(F.col("p.n") > 0)
        .select("window", "len", "p.offset", "p.shingle")
    )
    prefix = stage(prefix, "decontam-prefix")
    rare = spark.sparkContext.broadcast(Bitmap.of(prefix, "shingle"))

    def places(part):
        lower, starts, ends, rows, hs, at = _hashed(part, sizes, rare.value)
        order = np.argsort(at, kind="stable")
        hs, at = hs[order], at[order]
        raw, n = lower.tobytes(), part.num_rows
        first = np.searchsorted(rows, np.arange(n + 1))
        row = rows[at]
        lo, hi = np.maximum(first[row], at - WINDOW), np.minimum(first[row + 1], at + WINDOW)
        text = [b" ".join(raw[starts[j] : ends[j]] for j in range(a, b)) for a, b in zip(lo.tolist(), hi.tolist())]
        place = pa.StructArray.from_arrays(
            [pa.array((at - first[row]).astype(np.int32)), pa.array((at - lo).astype(np.int32)), pa.array(hs.view(np.int64)), pa.array(text, pa.binary()).cast(pa.string())],
            ["pos", "before", "shingle", "around"],
        )
        return pa.RecordBatch.from_arrays(
            [part.column("uid"), part.column("doc_id"), pa.array(np.diff(first)), list_array(place, np.bincount(row, minlength=n))], ["uid", "doc_id", "n_words", "places"]
        )

    marked = map_texts(
        d.withColumn("uid", F.monotonically_increasing_id()),
        places,
        f"uid bigint, doc_id {kind}, n_words bigint, places array<struct<pos:int,before:int,shingle:bigint,around:string>>",
    )
    marked = stage(marked, "decontam-places")
    at = marked.select("uid", F.explode("places").alias("p")).select("uid", "p.*")
    fits = (F.col("offset") <= F.col("before")) & (F.slice("near", F.col("before") - F.col("offset") + 1, F.col("len")) == F.split("window", " "))
    hits = (
        at.join(prefix, "shingle")
        .withColumn("near", F.split("around", " "))
        .where(fits)
        .select("uid", (F.col("pos") - F.col("offset")).alias("start"), (F.col("pos") - F.col("offset") + F.col("len")).alias("end"), "window")
    )
    hits = stage(hits.distinct(), "decontam-hits")
    before = F.max("end").over(W.partitionBy("uid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = hits.groupBy("uid", "start").agg(F.max("end").alias("end")).withColumn("new", new).groupBy("uid").agg(F.sum("new").cast("long").alias("n_hit"))
    named = (
        hits.select("uid", "window")
        .distinct()
        .join(windows.select("window", F.col("item_id").cast("string").alias("item")), "window")
        .select("uid", "item")
        .distinct()
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    zero = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = marked.drop("places").join(covered, "uid", "left").join(named, "uid", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("doc_id").alias(key), "n_words", zero.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"), (zero > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs``, columns of any name unchanged, without a window of any item."""
    whole = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    rows = stage(docs.select(F.monotonically_increasing_id().alias("number"), docs["text"].alias("text"), whole.alias("row")), "decontam-rows")
    hit = contamination(rows, items, "number", item_key).where("contaminated").select("number")
    clean = rows.join(hit, "number", "left_anti")
    return clean.select(*[F.col("text") if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Documents' windows of every item length, hashed by value and joined with the items' windows.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
i AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM i),
d AS (
  SELECT doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n.n, unnest(range(1, len(ws) - n.n + 2)) AS s FROM w, n)),
h AS (SELECT DISTINCT d.doc_id, d.s, d.n, i.item_id FROM d JOIN i ON d.n = i.n AND d.win = i.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON w.doc_id IS NOT DISTINCT FROM c.doc_id LEFT JOIN t ON w.doc_id IS NOT DISTINCT FROM t.doc_id
"""
