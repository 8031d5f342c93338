"""N-gram Jaccard join of documents with Bayesian candidate pruning.

A document is the set of its five-word shingles (fewer words: one shingle of all). Documents of equal sets form a
class, and one representative of each is joined with the others:

1. MinHash values of every document; bands of them propose candidates (24 bands of 3: a pair of similarity 0.8 shares
   none with probability 3e-8). Band keys are counted first, and only keys that two representatives have go on.
2. The members of a key are dealt to blocks by their hash, and every pair of blocks is a task of bounded size, so a
   key that thousands share is worked on by many tasks and no pair is written as a row. A pair belongs to the first
   band that it shares.
3. In a task, MinHash values are compared a few at a time. After each step, pairs whose posterior probability of
   similarity >= threshold (uniform prior) is under ``tolerance`` are dropped.
4. What is left is verified by exact Jaccard similarity of the shingle sets, compared word by word (equal sets of step
   0 are known by 128 bits made from 64-bit hashes of their shingles). A task returns each member's number of
   links and its component in the task; Spark sums the former and joins the latter into classes by alternating
   star steps.

Defined results: documents without words (null, empty or without letters and digits) are similar to nothing and are
a class of their own each; rows with equal ids are separate documents; ``n_copies`` counts the documents of a set,
``n_links`` the other different texts, of the same set too, that a text is similar to; ties of the smallest id go to the first row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import _WORD, dealt_blocks, discard, list_array, map_texts, mix, rows_in, shingle_hashes, stage, utf8, words

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, BAND_ROWS, STEP, BLOCK = 24, 3, 12, 256
HASHES = BANDS * BAND_ROWS
#: Pairs of a task that are compared together.
PAIRS = 1 << 14
_SEEDS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number of each word, the different words, and the row of each word."""
    lower, starts, ends, rows = words(data, offsets)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(lower[_WORD[lower]]))]).dictionary_encode()
    return each.indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64), each.dictionary.to_pylist(), rows


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and their text, in text order: from 64-bit hashes of whole words, which no choice of
    letters makes equal on purpose, as it does for polynomials."""
    code, known, rows = word_codes(data, offsets)
    wh = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)[code] if len(code) else np.zeros(0, np.uint64)
    h, at = shingle_hashes(wh, rows, k)
    row = rows[at]
    n = np.bincount(rows, minlength=len(offsets) - 1)
    for size in range(1, k):  # texts of fewer words
        few = n[rows] == size
        if few.any():
            more, where = shingle_hashes(wh[few], rows[few], size)
            h, row = np.concatenate([h, more]), np.concatenate([row, rows[few][where]])
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, as numbers that only equal shingles of these texts share: runs of words
    are numbered by comparing the words themselves, one word longer at a time."""
    code, known, rows = word_codes(*utf8(pa.array(texts, pa.large_string())))
    n = np.bincount(rows, minlength=len(texts))
    runs, ids, at = code, [], []
    for size in range(1, k + 1):
        here = rows[: max(0, len(code) - size + 1)]
        inside = here == rows[size - 1 :]
        if size > 1:
            runs = np.unique(np.where(inside, runs[: len(here)] * len(known) + code[size - 1 :], -1), return_inverse=True)[1]
        whole = inside & (n[here] == size if size < k else n[here] >= k)
        ids.append(runs[whole] * k + size - 1)
        at.append(here[whole])
    number, row = np.concatenate(ids), np.concatenate(at)
    order = np.argsort(row, kind="stable")
    return [np.unique(x) for x in np.split(number[order], np.searchsorted(row[order], np.arange(1, len(texts))))]


def minhashes(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """``HASHES`` minimum values of each row that has shingles, in row order."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
    out = np.zeros((len(first), HASHES), np.uint32)
    if len(first):
        for k in range(HASHES):
            y = (x ^ _SEEDS[k]) * np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0xC2B2AE35)
            y ^= y >> np.uint32(16)
            out[:, k] = np.minimum.reduceat(y, first)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After m comparisons, the fewest matches with posterior P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(n + 1, m - n + 1), whose upper tail at the threshold is the binomial
    distribution function of n for m + 1 trials.
    """
    out = {}
    for m in range(STEP, HASHES + 1, STEP):
        tail, n = 0.0, -1
        while tail < tolerance:
            n += 1
            tail += comb(m + 1, n) * threshold**n * (1 - threshold) ** (m + 1 - n)
        out[m] = n
    return out


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left, right) those that no step drops and whose first shared band is ``band``."""
    match = np.zeros(len(left), np.int32)
    for m, n in least.items():
        match += (sig[left, m - STEP : m] == sig[right, m - STEP : m]).sum(1, dtype=np.int32)
        keep = match >= n
        left, right, match = left[keep], right[keep], match[keep]
    shared = (sig[left] == sig[right]).reshape(-1, BANDS, BAND_ROWS).all(2)
    first = shared[np.arange(len(left)), band] & ~shared[:, :band].any(1)
    return left[first], right[first]


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's exact Jaccard similarity reaches the threshold."""
    limit = Fraction(str(threshold))
    size = np.array([len(s) for s in sets], np.int64)
    if len(left) > 4 * len(sets) and len(sets) > 8:
        both = np.zeros(len(left), np.int64)
        vocabulary, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.repeat(np.arange(len(sets)), size)
        for a in range(0, len(vocabulary), 1 << 14):  # columns in blocks, so that the matrix stays small
            here = (inverse >= a) & (inverse < a + (1 << 14))
            grid = np.zeros((len(sets), min(1 << 14, len(vocabulary) - a)), np.float32)
            grid[rows[here], inverse[here] - a] = 1
            both += (grid @ grid.T)[left, right].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    union = size[left] + size[right] - both
    return both * limit.denominator >= union * limit.numerator


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def signatures(docs: DataFrame, key: str = "doc_id", carry: bool = False) -> DataFrame:
    """Staged: uid, key, text, n (shingles of the set), h1 and h2 (hashes of the set), sig. Texts without words: n = 0.

    With ``carry`` a struct ``row`` holds all columns but the text, by number.
    """
    other = [F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]).alias("row")] if carry else []
    d = docs.select(docs[f"`{key}`"].alias(key), docs["text"].alias("text"), *other).withColumn("uid", F.monotonically_increasing_id())

    def run(part):
        h, row = shingles(*utf8(part.column("text")))
        rows = part.num_rows
        order = np.lexsort((h, row))
        sets, at = h[order], row[order]
        first = np.concatenate([[True], (sets[1:] != sets[:-1]) | (at[1:] != at[:-1])])[: len(at)]
        sets, at = sets[first], at[first]
        n = np.bincount(at, minlength=rows)
        bounds = np.concatenate([[0], np.cumsum(n)])
        ids = []
        with np.errstate(over="ignore"):
            for seed in (1, 2):
                run = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(mix(sets * np.uint64(2 * seed + 1) + np.uint64(seed)), out=run[1:])
                ids.append((run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
        sig = np.zeros((rows, HASHES), "<u4")
        sig[n > 0] = minhashes(h, row)
        raw = sig.tobytes()
        return pa.RecordBatch.from_arrays(
            [part.column("uid"), part.column(key), part.column("text"), pa.array(n), pa.array(ids[0]), pa.array(ids[1]), pa.array([raw[i : i + 4 * HASHES] for i in range(0, len(raw), 4 * HASHES)], pa.binary())],
            ["uid", key, "text", "n", "h1", "h2", "sig"],
        )

    kind = d.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(f"uid bigint, `{key}` {kind}, text string, n bigint, h1 bigint, h2 bigint, sig binary")
    if carry:
        schema = schema.add(d.schema["row"])
    with_row = lambda part: pa.RecordBatch.from_arrays([*run(part).columns, part.column("row")], schema.names) if carry else run(part)
    return stage(map_texts(d, with_row, schema), "near-signatures")


def _band_keys(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = mix(sig[:, :, 0] << np.uint64(32) | sig[:, :, 1])
                h = mix(h ^ mix(sig[:, :, 2] + np.arange(1, BANDS + 1, dtype=np.uint64)[None] * np.uint64(1 << 33)))
            uid = np.repeat(batch.column("uid").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(band), pa.array(h.ravel().view(np.int64))], ["uid", "band", "key"])

    return reps.select("uid", "sig").mapInArrow(run, "uid bigint, band int, key bigint")


def candidate_tasks(reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Staged tasks with pairs that pruning keeps: task, members (uids), left and right (places in members)."""
    keys = stage(_band_keys(reps), "near-bands")
    counts = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-counts")
    dealt = (
        dealt_blocks(keys.join(counts, "key"), "uid", block)
        .join(reps.select("uid", "sig"), "uid")
        .groupBy("key", "band", "lo", "hi")
        .agg(F.collect_list(F.struct("uid", "own", "sig")).alias("m"))
        .where(F.size("m") > 1)
        .select("band", "lo", "hi", F.transform("m", lambda x: x["uid"]).alias("uid"), F.transform("m", lambda x: x["own"]).alias("own"), F.transform("m", lambda x: x["sig"]).alias("sig"))
    )
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, lefts, rights = [], [], []
            for r in range(batch.num_rows):
                band, lo, hi = (batch.column(c)[r].as_py() for c in ("band", "lo", "hi"))
                uid, own_block = (batch.column(c)[r].values.to_numpy() for c in ("uid", "own"))
                sig = np.frombuffer(b"".join(batch.column("sig")[r].as_py()), "<u4").reshape(-1, HASHES)
                a, b = (np.arange(len(uid)),) * 2 if lo == hi else (np.flatnonzero(own_block == lo), np.flatnonzero(own_block == hi))
                step = max(1, PAIRS // max(1, len(b)))
                found = [(np.zeros(0, np.int64),) * 2]
                for k in range(0, len(a), step):
                    left, right = np.repeat(a[k : k + step], len(b)), np.tile(b, len(a[k : k + step]))
                    if lo == hi:
                        left, right = left[left < right], right[left < right]
                    found.append(surviving_pairs(sig, left, right, band, least))
                left, right = (np.concatenate(x) for x in zip(*found))
                if len(left):
                    used, places = np.unique(np.concatenate([left, right]), return_inverse=True)
                    members.append(uid[used])
                    lefts.append(places[: len(left)].astype(np.int32))
                    rights.append(places[len(left) :].astype(np.int32))
            if members:
                yield pa.RecordBatch.from_arrays([list_array(np.concatenate(x), np.array([len(y) for y in x])) for x in (members, lefts, rights)], ["members", "left", "right"])

    tasks = dealt.mapInArrow(run, "members array<bigint>, left array<int>, right array<int>")
    tasks = stage(tasks.withColumn("task", F.monotonically_increasing_id()), "near-tasks")
    discard(keys, counts)
    return tasks


def verified_links(tasks: DataFrame, texts: DataFrame, copies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Staged: uid, links (different texts of the sets linked in a task), root (a uid of its component there)."""
    members = tasks.select("task", F.explode("members").alias("uid"))
    fetched = (
        members.join(copies.select(F.col("rep").alias("uid"), "n_texts"), "uid")
        .join(rows_in(texts.select("uid", "text"), members, "uid")[0], "uid")
        .groupBy("task")
        .agg(F.collect_list(F.struct("uid", "text", "n_texts")).alias("m"))
        .join(tasks, "task")
        .select(F.transform("m", lambda x: x["uid"]).alias("uid"), F.transform("m", lambda x: x["text"]).alias("text"), F.transform("m", lambda x: x["n_texts"]).alias("n_texts"), "members", "left", "right")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                uid, n_texts, members, left, right = (batch.column(c)[r].values.to_numpy() for c in ("uid", "n_texts", "members", "left", "right"))
                texts = dict(zip(uid.tolist(), batch.column("text")[r].as_py()))
                sets = shingle_sets([texts[u] for u in members.tolist()])
                ok = linked_pairs(sets, left, right, threshold)
                left, right = left[ok], right[ok]
                if len(left):
                    order = np.argsort(uid)
                    weight = n_texts[order][np.searchsorted(uid[order], members)]
                    links = np.zeros(len(members), np.int64)
                    np.add.at(links, np.concatenate([left, right]), weight[np.concatenate([right, left])])
                    root = members[_roots(len(members), left, right)]
                    on = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (members, links, root)], ["uid", "links", "root"])

    return stage(fetched.mapInArrow(run, "uid bigint, links bigint, root bigint"), "near-links")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps: node, root (the component's least node).

    Nodes without edges are not listed. Every step is a map-side combined minimum and a join; what reaches the
    driver is a checksum.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    last, before = None, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that both sides of a join are plain shuffles and one node's many edges can be split.
        large = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "near-least")
        e = stage(both.join(large, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "near-large")
        small = stage(e.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        each = e.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        now_e = stage(each.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near-stars")
        discard(large, small, e, *([before] if before is not None else []))
        e = before = now_e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now


def near_classes(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Per document: key, class_id (least key of its class), n_links (other texts), n_copies (documents of its set), class_size,
    and is_first: whether the document is the one of its class with the least key."""
    return _classes(signatures(docs, key), key, threshold, tolerance, block).drop("uid")


def keep_first(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that have the least key of their class of near duplicates."""
    signed = signatures(docs, key, carry=True)
    rest = stage(_classes(signed, key, threshold, tolerance).where("not is_first").select("uid"), "near-rest")
    perhaps, sure = rows_in(signed.select("uid", "text", "row"), rest, "uid")
    kept = sure.unionByName(perhaps.join(rest, "uid", "left_anti"))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _classes(signed: DataFrame, key: str, threshold: float, tolerance: float, block: int = BLOCK) -> DataFrame:
    different = signed.where("n > 0").groupBy("h1", "h2", "n", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2")).agg(F.min("uid").alias("uid"), F.count("*").alias("k"))
    copies = stage(different.groupBy("h1", "h2", "n").agg(F.min("uid").alias("rep"), F.sum("k").alias("n_copies"), F.count("*").alias("n_texts")), "near-copies")
    reps = signed.select("uid", "sig").join(copies.select(F.col("rep").alias("uid")), "uid")
    tasks = candidate_tasks(reps, threshold, tolerance, block)
    links = verified_links(tasks, signed, copies, threshold)
    discard(tasks)
    degree = links.groupBy(F.col("uid").alias("rep")).agg(F.sum("links").alias("n_links"))
    classes = components(links, "uid", "root").select(F.col("node").alias("rep"), "root")
    of = copies.join(degree, "rep", "left").join(classes, "rep", "left").withColumn("class", F.coalesce("root", "rep"))
    # The first document of each set, then of each class of sets: a class's documents are not gathered.
    least = F.min(F.struct(F.col(key).isNull(), key, "uid")).alias("first")
    of = stage(of.join(signed.where("n > 0").groupBy("h1", "h2", "n").agg(least), ["h1", "h2", "n"]), "near-sets")
    of_class = stage(of.groupBy("class").agg(F.min("first").alias("kept"), F.sum("n_copies").alias("class_size")), "near-firsts")
    said = stage(of.join(of_class, "class").select("h1", "h2", "n", "n_links", "n_texts", "n_copies", "kept", "class_size"), "near-verdict")
    discard(links, of, of_class, copies)
    alone = F.col("kept").isNull()
    return (
        signed.select("uid", key, "n", "h1", "h2")
        .join(said, ["h1", "h2", "n"], "left")
        .select(
            key,
            F.when(alone, F.col(key)).otherwise(F.col(f"kept.`{key}`")).alias("class_id"),
            (F.coalesce("n_links", F.lit(0)) + F.coalesce("n_texts", F.lit(1)) - 1).cast("long").alias("n_links"),
            F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
            (alone | (F.col("uid") == F.col("kept.uid"))).alias("is_first"),
            "uid",
        )
    )


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("is_first")
