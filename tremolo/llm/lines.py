"""Line dedup: a segment-partition edit-distance join of lines.

Two lines are linked when their edit distance is at most one edit for each ``per_edit`` characters of the shorter one
(five: a similarity of 0.8), and at most ``edits``; under ``per_edit`` characters that is equality. Cut the shorter
line into one segment more than it may have edits: then one segment stands unchanged in the longer one, at a place
that the length difference and the segment's number bound (multi-match-aware ranges). So lines index their segments
under (length, segment number, content) and probe the indexes of lengths up to ``edits`` less than theirs with the
substrings of those ranges.

Exact copies of a line are one line first, known by a cryptographic digest. Bitmaps of fixed size (16 MB) then tell
index keys that nobody else has and probes that meet no index; they only ever let too much pass. What passes is
grouped by key, dealt to blocks and verified in tasks of bounded size by a bit-parallel edit distance whose words are
the band around the diagonal, over many pairs at once. A pair belongs to the first segment that finds it. Tasks
return links and components, never pairs, and components are joined by star steps.

Lines are parts between newlines, compared as code points; empty lines are never removed. Of each class the
occurrence with the least (id, row, line) stays.

Defined results: a null or empty text is one empty line; rows with equal ids are separate documents; ties between
equal ids go to the first row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import Bitmap, Spans, dealt_blocks, discard, list_array, map_texts, mix, own, stage
from tremolo.llm.near import _roots, components

EDITS, PER_EDIT, BLOCK, BITS = 2, 5, 256, 27
#: Pairs of a task that are looked at together.
PAIRS = 1 << 16


def allowed(size, edits: int = EDITS, per_edit: int = PER_EDIT):
    """Edits that a line of ``size`` characters may be away from one that is no shorter."""
    return np.minimum(size // per_edit, edits)


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All code points; start, length and text of every line."""
    joined = "\n".join(t or "" for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = np.flatnonzero(code == 10)
    starts, ends = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(code)]])
    first = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    return code, starts, ends - starts, np.searchsorted(first, starts, "right") - 1


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` (from 0) of lines of a length: even parts, the longer ones last."""
    short, longer = length // (edits + 1), length % (edits + 1)
    extra = np.maximum(0, i - (edits + 1 - longer))
    return i * short + extra, short + (i >= edits + 1 - longer)


def probe_range(size, length, i: int, edits: int):
    """First and last start (from 0) in a line of ``size`` of segment ``i`` of a line of ``length``."""
    p, n = segment(length, i, edits)
    d = size - length
    low = np.maximum(np.maximum(p - i, p + d - (edits - i)), 0)
    high = np.minimum(np.minimum(p + i, p + d + (edits - i)), size - n)
    return low, high, n


def _key(content: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(content ^ mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(i + 1)))


def index_keys(span: Spans, start: np.ndarray, size: np.ndarray, edits: int, per_edit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Segment number, the lines that have it, and their keys."""
    limit = allowed(size, edits, per_edit)
    for e in range(1, edits + 1):
        at = np.flatnonzero(limit == e)
        for i in range(e + 1 if len(at) else 0):
            p, n = segment(size[at], i, e)
            yield i, at, _key(span(start[at] + p, start[at] + p + n), size[at], i)


def probe_keys(span: Spans, start: np.ndarray, size: np.ndarray, edits: int, per_edit: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Segment number, whether it is the line's own index place, the probing lines and their keys."""
    for less in range(edits + 1):
        limit = allowed(size - less, edits, per_edit)
        for e in range(max(less, 1), edits + 1):
            those = np.flatnonzero(limit == e)
            for i in range(e + 1 if len(those) else 0):
                low, high, n = probe_range(size[those], size[those] - less, i, e)
                p, _ = segment(size[those] - less, i, e)
                for step in range(-e, 2 * e + 1):
                    on = np.flatnonzero((p + step >= low) & (p + step <= high))
                    if len(on):
                        at = those[on]
                        a = start[at] + p[on] + step
                        yield i, less == 0 and step == 0, at, _key(span(a, a + n[on]), size[at] - less, i)


def _distinct(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct lines of the texts, and the number of each line's in text order."""
    text = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = pc.split_pattern(text.cast(pa.large_string()).fill_null(""), "\n").flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _names(distinct: pa.Array) -> list[str]:
    return [hashlib.blake2b(x, digest_size=16).hexdigest() for x in distinct.cast(pa.large_binary()).to_pylist()]


def _short_names(distinct: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in distinct.cast(pa.large_binary()).to_pylist()]), np.int64)


def _parsed(column: pa.Array, per_edit: int):
    """Code points, their hashes, and start, size and name of each distinct line that may have edits."""
    code, start, size, _ = lines_of(column.to_pylist())
    distinct, number = _distinct(column)
    _, once = np.unique(number, return_index=True)
    on = size[once] >= per_edit
    return code, Spans(code), start[once[on]], size[once[on]], distinct.filter(pa.array(on))


class Band:
    """Bit-parallel edit distance inside the band of diagonals -edits..edits, for many pairs at once.

    Bit k of a word is the cell ``k - edits`` rows off the diagonal; the vertical differences of a column are kept as
    words of +1 and -1 and the distance is followed along the band's lower edge, then along the last row.
    """

    def __init__(self, edits: int = EDITS):
        self.edits = edits

    def within(self, a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair (a no longer than b, by at most ``edits``) is within ``edits`` edits, or its own limit."""
        limit = np.full(len(a), self.edits) if limit is None else limit
        out = np.zeros(len(a), bool)
        order = np.argsort([len(x) for x in b], kind="stable")
        at = 0
        while at < len(order):  # runs of pairs of about equal length, so that padding stays small
            to = at + 1
            while to < len(order) and (to - at + 1) * len(b[order[to]]) <= 1 << 20:
                to += 1
            pick = order[at:to]
            out[pick] = self._distance([a[k] for k in pick], [b[k] for k in pick]) <= limit[pick]
            at = to
        return out

    def _distance(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        e = self.edits
        width = 2 * e + 1
        m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        top = int(n.max()) if len(n) else 0
        # Rows of the pattern a are padded by e on both sides with values that equal nothing.
        pat = np.full((len(a), top + 2 * e + 1), 0xFFFFFFFF, np.uint32)
        txt = np.full((len(b), top), 0xFFFFFFFE, np.uint32)
        for k, (x, y) in enumerate(zip(a, b)):
            pat[k, e : e + len(x)] = x
            txt[k, : len(y)] = y
        # Column 0 of the band: rows 0..e are 0..e; above row 0 there is nothing, kept as -1 steps that end in 0.
        full = np.int64((1 << width) - 1)
        vp = np.full(len(a), (full >> np.int64(e + 1)) << np.int64(e + 1), np.int64)
        vn = np.full(len(a), 0, np.int64)
        low = np.full(len(a), e, np.int64)  # distance at the band's lower edge, row j + e
        alive = np.arange(len(a))
        dist = np.full(len(a), e + 1, np.int64)
        bits = np.int64(1) << np.arange(width, dtype=np.int64)
        for j in range(1, top + 1):
            # Bit k: rows i = j - e + k of the pattern; the character is i - 1 = j - 1 - e + k, padded j - 1 + k.
            eq = ((pat[alive, j - 1 : j - 1 + width] == txt[alive, j - 1][:, None]) * bits).sum(1)
            # The step moves the band down by one row: old bit k + 1 is new bit k.
            p, q = vp[alive] >> 1, vn[alive] >> 1
            d0 = (((eq & p) + p) ^ p) | eq | q
            hp = q | (full & ~(d0 | p))
            hn = d0 & p
            edge = np.int64(1) << np.int64(width - 1)
            low[alive] += np.where(d0 & edge, 0, 1)
            x = (hp << 1) & full
            y = (hn << 1) & full
            vp[alive] = y | (full & ~(d0 | x))
            vn[alive] = d0 & x
            done = n[alive] == j
            if done.any():
                k = alive[done]
                # Climb from the lower edge, row j + e, to row m: take back the vertical steps between.
                climb = e - (m[k] - n[k])
                d = low[k].copy()
                for s in range(width - 1):
                    on = s < climb
                    bit = np.int64(width - 1 - s)
                    d -= np.where(on, (vp[k] >> bit) & 1, 0)
                    d += np.where(on, (vn[k] >> bit) & 1, 0)
                dist[k] = d
                alive = alive[~done]
            if j % 16 == 0 and len(alive):  # the lower edge exceeds any cell of the band by at most 2 * edits
                alive = alive[low[alive] <= 3 * e]
            if not len(alive):
                break
        return dist  # beyond ``edits``: some number greater than it


def _first_finder(a: np.ndarray, b: np.ndarray, i: int, edits: int) -> bool:
    """Whether segment ``i`` of ``a`` is found in ``b`` and none before it."""
    for k in range(i + 1):
        low, high, n = (int(x) for x in probe_range(np.int64(len(b)), np.int64(len(a)), k, edits))
        p = int(segment(np.int64(len(a)), k, edits)[0])
        part = a[p : p + n].tobytes()
        if any(b[s : s + n].tobytes() == part for s in range(low, high + 1)):
            return k == i
    return False


def _linked(x: int, y: int, i: int, own_block, role, size, rank, line: pa.Array, edits: int, per_edit: int) -> tuple[np.ndarray, ...]:
    """Of the members ``x`` .. ``y`` of a task for segment ``i``: those with links, their number, and a member of the
    component. With ``own_block`` only pairs of different blocks are looked at."""
    band, a, b = Band(edits), x + np.flatnonzero(role[x:y] & 1), x + np.flatnonzero(role[x:y] & 2)
    limit = dict(zip(a.tolist(), allowed(size[a], edits, per_edit).tolist()))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    code: dict[int, np.ndarray] = {}
    step = max(1, PAIRS // max(1, len(b)))
    for k in range(0, len(a), step):
        left, right = np.repeat(a[k : k + step], len(b)), np.tile(b, len(a[k : k + step]))
        more = size[right] - size[left]
        ok = (left != right) & (more >= 0) & (more <= allowed(size[left], edits, per_edit)) & ((more > 0) | (rank[left] < rank[right]))
        if own_block is not None:
            ok &= own_block[left] != own_block[right]
        left, right = left[ok], right[ok]
        if not len(left):
            continue
        used = np.unique(np.concatenate([left, right]))
        for j in used.tolist():
            if j not in code:
                code[j] = np.frombuffer(line[j].as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
        # An edit changes the counts of at most two characters by one: most pairs end here.
        counts = np.stack([np.bincount(code[j] & 63, minlength=64) for j in used.tolist()]).astype(np.int32)
        l, r = np.searchsorted(used, left), np.searchsorted(used, right)
        ok = [np.abs(counts[l[j : j + 20_000]] - counts[r[j : j + 20_000]]).sum(1) <= 2 * edits for j in range(0, len(l), 20_000)]
        ok = np.concatenate(ok)
        left, right = left[ok], right[ok]
        ok = band.within([code[j] for j in left.tolist()], [code[j] for j in right.tolist()], np.array([limit[j] for j in left.tolist()], np.int64))
        left, right = left[ok], right[ok]
        ok = np.array([_first_finder(code[j], code[m], i, limit[j]) for j, m in zip(left.tolist(), right.tolist())], bool)
        lefts.append(left[ok])
        rights.append(right[ok])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    if not len(left):
        return left, left, left
    links = np.bincount(np.concatenate([left, right]) - x, minlength=y - x)
    on = np.flatnonzero(links)
    return x + on, links[on], x + np.array(_roots(y - x, left - x, right - x), np.int64)[on]


def line_links(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, block: int = BLOCK) -> DataFrame:
    """Staged: node (a distinct line), links (number of other distinct lines near it), root (in a task)."""
    if per_edit < 2:
        raise ValueError("per_edit must be at least 2: every segment needs a character")
    spark = docs.sparkSession
    d = own(docs, "text")

    def indexes(part):
        _, span, start, size, distinct = _parsed(part.column("text"), per_edit)
        name = _short_names(distinct)
        found = list(index_keys(span, start, size, edits, per_edit))
        keys = np.concatenate([*(k for _, _, k in found), np.zeros(0, np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.concatenate([*(name[at] for _, at, _ in found), np.zeros(0, np.int64)]))], ["seg", "line"])

    seen = map_texts(d, indexes, "seg bigint, line bigint").groupBy("seg").agg((F.min("line") != F.max("line")).alias("shared"))
    seen = stage(seen, "lines-index")
    everyone, shared = spark.sparkContext.broadcast(Bitmap.of(seen, "seg", BITS, 2)), spark.sparkContext.broadcast(Bitmap.of(seen.where("shared"), "seg", BITS, 2))

    def probes(part):
        _, span, start, size, _ = _parsed(part.column("text"), per_edit)
        found = [k[everyone.value.test(k)] for _, mine, _, k in probe_keys(span, start, size, edits, per_edit) if not mine]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64))], ["seg"])

    probed = spark.sparkContext.broadcast(Bitmap.of(map_texts(d, probes, "seg bigint"), "seg", BITS, 2))
    discard(seen)

    def members(part):
        _, span, start, size, distinct = _parsed(part.column("text"), per_edit)
        none = np.zeros(0, np.int64)
        line, key, number, role = [none], [none.view(np.uint64)], [none], [none]

        def add(at, k, i, what):
            line.append(at)
            key.append(k)
            number.append(np.full(len(at), i))
            role.append(np.full(len(at), what))

        for i, at, k in index_keys(span, start, size, edits, per_edit):
            on = shared.value.test(k) | probed.value.test(k)
            add(at[on], k[on], i, 1)
        for i, mine, at, k in probe_keys(span, start, size, edits, per_edit):
            on = (shared if mine else everyone).value.test(k)
            add(at[on], k[on], i, 2)
        line, key, number, role = (np.concatenate(x) for x in (line, key, number, role))
        order = np.argsort(line, kind="stable")
        line, key, number, role = (x[order] for x in (line, key, number, role))
        used, n = np.unique(line, return_counts=True)
        text = distinct.take(pa.array(used)).cast(pa.string())
        segs = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(number.astype(np.int32)), pa.array(role.astype(np.int32))], ["seg", "number", "role"])
        return pa.RecordBatch.from_arrays([pa.array(_names(text), pa.string()), text, list_array(segs, n)], ["node", "line", "segs"])

    lines = map_texts(d, members, "node string, line string, segs array<struct<seg:bigint,number:int,role:int>>").groupBy("node").agg(F.first("line").alias("line"), F.first("segs").alias("segs"))
    lines = stage(lines, "lines-members")
    roles = lines.select("node", F.explode("segs").alias("s")).select("node", "s.*").groupBy("seg", "number", "node").agg(F.expr("bit_or(role)").alias("role"))
    roles = stage(roles, "lines-roles")
    counts = stage(roles.groupBy("seg", "number").agg(F.count("*").alias("n"), F.expr("bit_or(role)").alias("any")).where("n > 1 and any = 3").drop("any"), "lines-counts")
    dealt = (
        dealt_blocks(roles.join(counts, ["seg", "number"]), "node", block)
        .select("seg", "number", "node", "role", "own", "lo", "hi")
        .join(lines.select("node", "line"), "node")
        .groupBy("seg", "number", "lo", "hi")
        .agg(F.collect_list(F.struct("node", "role", "own", "line")).alias("m"))
        .where(F.size("m") > 1)
        .select("number", "lo", "hi", "m")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("m")
            node, line, role, own_block = (pc.struct_field(lists.flatten(), c) for c in ("node", "line", "role", "own"))
            rank = np.empty(len(node), np.int64)
            rank[pc.sort_indices(node).to_numpy()] = np.arange(len(node))
            size, role, own_block = pc.utf8_length(line).to_numpy().astype(np.int64), role.to_numpy(), own_block.to_numpy()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
            tasks = zip([0, *ends], ends, *(batch.column(c).to_pylist() for c in ("number", "lo", "hi")))
            found = [_linked(x, y, i, None if lo == hi else own_block, role, size, rank, line, edits, per_edit) for x, y, i, lo, hi in tasks]
            member, links, root = (np.concatenate(x) for x in zip(*found))
            if len(member):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(member)), pa.array(links), node.take(pa.array(root))], ["node", "links", "root"])

    links = stage(dealt.mapInArrow(verify, "node string, links bigint, root string"), "lines-links")
    discard(lines, roles, counts)
    return links


def duplicate_lines(docs: DataFrame, key: str = "doc_id", edits: int = EDITS, per_edit: int = PER_EDIT, block: int = BLOCK) -> DataFrame:
    """Per document: key, n_lines, removed (numbers of its lines, from 0, that repeat an earlier one), n_links."""
    links = line_links(docs, edits, per_edit, block)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = stage(components(links, "node", "root").join(degree, "node").select("node", F.col("root").alias("class"), "links"), "lines-classes")
    discard(links)
    d = own(docs, key, "text").withColumnRenamed(key, "id").withColumn("uid", F.monotonically_increasing_id())
    kind = d.schema["id"].dataType.simpleString()

    def nodes(part):
        distinct, number = _distinct(part.column("text"))
        name = pa.array([x if n else None for x, n in zip(_names(distinct), pc.binary_length(distinct).to_pylist())], pa.string())
        size = [(t or "").count("\n") + 1 for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), list_array(name.take(pa.array(number)), np.array(size))], ["uid", "id", "nodes"])

    parsed = stage(map_texts(d, nodes, f"uid bigint, id {kind}, nodes array<string>"), "lines-documents")
    places = parsed.select("uid", "id", F.posexplode("nodes").alias("at", "node")).where("node is not null")
    # The first place of each line, then of each class of linked lines: what lines share is settled among the lines.
    least = F.min(F.struct(F.col("id").isNull(), "id", "uid", "at")).alias("first")
    own_first = stage(places.groupBy("node").agg(least, F.count("*").alias("n")).join(classes, "node", "left").where("n > 1 or class is not null"), "lines-nodes")
    linked = own_first.where("class is not null")
    of_class = stage(linked.groupBy("class").agg(F.min("first").alias("kept")), "lines-firsts")
    said = linked.join(of_class, "class").select("node", "links", "kept").unionByName(own_first.where("class is null").select("node", F.lit(None).cast("long").alias("links"), F.col("first").alias("kept")))
    said = stage(said, "lines-verdict")
    discard(own_first, of_class, classes)
    of_document = (
        places.join(said, "node")
        .groupBy("uid")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("uid") != F.col("kept.uid")) | (F.col("at") != F.col("kept.at")), F.col("at")))).alias("removed"),
            F.sum("links").alias("n_links"),
        )
    )
    return (
        parsed.select("uid", "id", F.size("nodes").cast("long").alias("n_lines"))
        .join(of_document, "uid", "left")
        .select(F.col("id").alias(key), "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_links", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
