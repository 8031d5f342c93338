"""Nearest neighbours by inner product: collision-counting hashing with query-centred windows.

Vectors are dealt to blocks by a hash of their id. A block keeps one sorted array for each of ``projections`` random
directions. A query's window in each array is centred at its own projection and has a width in proportion to a radius,
which grows step by step (virtual rehashing: the arrays stay as they are, the windows take in what lies beside them).
A vector that lies in at least ``threshold`` of the windows is verified: its inner product is computed, in
the end from the original components in double precision. A query is done in a block when as many verified vectors as
asked for lie within the radius, or when its windows hold the whole block. There is no limit on candidates.

Largest inner products become least distances by one more component: with ``m`` the block's longest vector,
``x -> (x, sqrt(m^2 - |x|^2))`` and ``q -> (m q / |q|, 0)`` have the distance ``sqrt(2 m^2 - 2 m q.x / |q|)``.

Queries are dealt in groups; a group meets every block once (a stated query set against all rows, in blocks): vectors
of the block come first, then the queries in batches, so a task holds one block and one batch. Each block answers with
its nearest of each query, of which the best are kept map-side before they are shuffled.

The chance that a vector at the final radius lies in fewer windows than the threshold is that of a binomial variate:
with 32 windows of width 2.4 radii (0.77 each) and a threshold of 20, 2%; it falls with the distance. Where near and far
vectors differ little in distance, as random ones of many components do, most of a block passes the threshold: such
candidates are verified by one matrix product.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do
rows without id; rows with a query's id are its own and no candidates of it; rows of one id count once, with the least
vector in component order; ties go to the smaller id; queries meet vectors of their own length only; a query without
candidates has no rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import own, stage

#: Random directions, least number of windows, window width and growth in radii, first radius in radii told by the sample.
PROJECTIONS, THRESHOLD, WIDTH, GROWTH, BEGIN = 32, 20, 2.4, 1.1, 0.95
#: Vectors of a block and queries of a group (both about), vectors of a block's sample, queries searched at a time.
BLOCK, GROUP, SAMPLE, BATCH = 8192, 65_536, 256, 64


def usable(vector: Column) -> Column:
    """True for vectors of finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of a block's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 11):
        """``ids`` in ascending order, each once."""
        self.ids, self.vectors, self.rows = ids, vectors, len(ids)
        self.scaled = vectors / np.abs(vectors).max()
        squares = np.einsum("ij,ij->i", self.scaled, self.scaled)
        self.longest = math.sqrt(squares.max())
        longer = np.concatenate([self.scaled, np.sqrt(np.maximum(self.longest**2 - squares, 0))[:, None]], 1)
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((vectors.shape[1] + 1, projections))
        self.sample = rng.permutation(self.rows)[:SAMPLE]
        placed = (longer @ self.directions).T
        self.order = np.argsort(placed, 1, kind="stable")
        self.sorted = np.take_along_axis(placed, self.order, 1)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: int = THRESHOLD, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, vector row and score of each query's ``k`` nearest found, in no order."""
        out = []
        for at in range(0, len(queries), batch):
            q, v, s = self._windows(query_ids[at : at + batch], queries[at : at + batch], k, threshold)
            out.append((q + at, v, s))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _own(self, query_ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, query_ids), self.rows - 1)
        return np.where(self.ids[at] == query_ids, at, -1)

    def _windows(self, query_ids, queries, k, threshold):
        n, b, m = self.rows, len(queries), len(self.sorted)
        unit = queries / np.abs(queries).max(1, keepdims=True)
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        centre = self.longest * (unit @ self.directions[:-1])
        distance = lambda nearness: np.sqrt(np.maximum(2 * self.longest * (self.longest - nearness), 0))
        own_row = self._own(query_ids)
        wanted = np.minimum(k, n - (own_row >= 0))
        # a sample of the block tells about where to begin; when to end is told by the vectors found
        sample = np.sort(distance(unit @ self.scaled[self.sample].T), 1)
        radius = BEGIN * np.maximum(sample[:, min(k * len(self.sample) // n, len(self.sample) - 1)], 1e-6 * self.longest)
        counts, seen = np.zeros((b, n), np.uint8), np.zeros((b, n), bool)
        at = np.flatnonzero(own_row >= 0)
        seen[at, own_row[at]] = True
        near, every = np.full((b, n), -np.inf), None
        low = np.stack([np.searchsorted(self.sorted[j], centre[:, j]) for j in range(m)], 1)
        high, live = low.copy(), np.flatnonzero(wanted > 0)
        while len(live):
            half = radius[live] * WIDTH / 2
            for j in range(m):
                lower, upper = np.searchsorted(self.sorted[j], centre[live, j] - half), np.searchsorted(self.sorted[j], centre[live, j] + half, "right")
                order = self.order[j]
                for i, *cuts in zip(live.tolist(), lower.tolist(), low[live, j].tolist(), high[live, j].tolist(), upper.tolist()):
                    # what the window takes in on both sides
                    for start, end in (cuts[:2], cuts[2:]):
                        if start < end:
                            counts[i][order[start:end]] += 1
                low[live, j], high[live, j] = lower, upper
            new = (counts[live] >= threshold) & ~seen[live]
            seen[live] |= new
            if every is None and np.count_nonzero(new) * 16 > new.size:
                every = unit @ self.scaled.T
            if every is not None:
                near[live] = np.where(new, every[live], near[live])
            else:
                v = np.flatnonzero(new)
                for part in range(0, len(v), 1 << 16):
                    q, at = live[v[part : part + (1 << 16)] // n], v[part : part + (1 << 16)] % n
                    near[q, at] = np.einsum("ij,ij->i", self.scaled[at], unit[q])
            found = (near[live] >= (self.longest - radius[live] ** 2 / (2 * self.longest))[:, None]).sum(1)
            whole = ((low[live] == 0) & (high[live] == n)).all(1)
            live = live[(found < wanted[live]) & ~whole]
            radius *= GROWTH
        kept = min(k, n)
        # with all that may tie with the last one, so that original vectors and the smaller id decide in the end
        worst = -np.partition(-near, kept - 1, 1)[:, kept - 1]
        q, v = np.nonzero((near >= worst[:, None] - 1e-9 * self.longest) & (near > -np.inf))
        return q, v, np.einsum("ij,ij->i", self.vectors[v], queries[q])


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", block: int = BLOCK, group: int = GROUP, **index) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries`` (columns ``key`` and ``column``): query_id,
    rank, vec_id, score."""

    def part(df):
        d = own(df, key, column).where(F.col(key).isNotNull() & usable(F.col(column)))
        return d.select(F.col(key).alias("id"), F.col(column).alias("vector"), F.size(column).alias("length"))

    stored, asked = stage(part(vectors), "ann-vectors"), stage(part(queries), "ann-queries")
    blocks, groups = max(1, math.ceil(stored.count() / block)), max(1, math.ceil(asked.count() / group))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = stored.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), every(groups).alias("group"), F.lit(0).alias("asks"))
    sent = asked.select("*", every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"), F.lit(1).alias("asks"))
    pair = ["length", "block", "group"]
    dealt = placed.unionByName(sent.withColumn("group", F.col("group").cast("int")).select(*placed.columns)).repartition(2 * blocks * groups, *pair).sortWithinPartitions(*pair, "asks", "id", "vector")
    n_dirs, threshold = index.get("projections", PROJECTIONS), index.get("threshold", THRESHOLD)

    def answers(built, batch, length):
        ids, first = np.unique(batch.column("id").to_numpy(zero_copy_only=False), return_index=True)
        q, v, s = built.nearest(ids, _matrix(batch.column("vector"), length)[first], k, threshold)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(built.ids[v]), pa.array(s)], ["query_id", "vec_id", "score"])

    def run(batches):
        now, held, built, last = None, [], None, None
        for batch in batches:
            code = np.stack([batch.column(c).to_numpy() for c in (*pair, "asks")], 1)
            edges = np.concatenate([[0], np.flatnonzero((np.diff(code, axis=0) != 0).any(1)) + 1, [len(code)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                of, some = tuple(code[a, :3].tolist()), batch.slice(a, b - a)
                if of != now:
                    now, held, built, last = of, [], None, None
                if code[a, 3] == 0:
                    held.append(some)
                    continue
                if built is None and held:
                    ids = np.concatenate([h.column("id").to_numpy(zero_copy_only=False) for h in held])
                    rows = np.concatenate([_matrix(h.column("vector"), of[0]) for h in held])
                    ids, first = np.unique(ids, return_index=True)
                    built, held = Index(ids, rows[first], n_dirs), []
                if built is None:
                    continue
                # rows of one id follow each other: only the first asks
                ids = some.column("id").to_numpy(zero_copy_only=False)
                some, last = some.slice(int(np.searchsorted(ids, last, "right"))) if last is not None else some, ids[-1]
                for at in range(0, some.num_rows, 512):
                    yield answers(built, some.slice(at, 512), of[0])

    id_type = stored.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return dealt.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))
