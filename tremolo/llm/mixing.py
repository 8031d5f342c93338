"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed by source and hash bucket. Walking the buckets of a source in order, the cumulative sum finds
the bucket in which its budget ends; only that boundary bucket is split again by the next bits of the hash, until
all bits are used. The hash below which rows fit the budget is the source's threshold, and rows are kept or
repeated by comparing their hash with it. No rows are sorted, and what is gathered is one row per source and bucket.

Defined results: a null or empty text has size 0; a null source is one source, the last in order; a null id hashes
like the text ``null``; rows with the same id have the same hash and are taken together; an empty table gives an
empty result. Other columns are ignored by :func:`mix_counts` and kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.llm.common import own, stage

#: Bits of the hash, and bits by which each level splits a bucket.
HASH_BITS, LEVEL_BITS = 60, 12


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits of the md5 of a key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size and its target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes. No target
    exceeds ``most`` times the source's size; the excess is shared again by weight, which ends with targets
    ``min(most * size, level * weight)``. Sources in order of ``most * size / weight`` meet their cap first, so the
    level follows from running sums over the source table (one row per source).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("weight")
    capped = W.orderBy(ratio, F.col("source").asc_nulls_last())
    done, every = capped.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(done), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(done), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("free"), F.struct(ratio, "level"))).over(every)["level"]
    target = F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source, the hash below which the rows' sizes add up to what is nearest to ``budget``: rows are taken whole.

    ``sizes`` has source, size, hash; ``budgets`` has source, budget. Each level sums sizes by bucket inside the
    boundary bucket that the level before it found.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        hist = (
            sizes.alias("d")
            .join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .where(F.shiftright("d.hash", shift + LEVEL_BITS) == F.shiftright("s.low", shift + LEVEL_BITS))
            .groupBy(F.col("d.source").alias("source"), F.shiftright("d.hash", shift).alias("bucket"))
            .agg(F.sum("d.size").alias("size"))
        )
        run = F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        edge = (
            hist.withColumn("run", run)
            .alias("h")
            .join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .where(F.col("h.run") > F.col("s.budget"))
            .groupBy(F.col("h.source").alias("source"))
            .agg(F.min(F.struct("h.bucket", (F.col("s.budget") - F.col("h.run") + F.col("h.size")).alias("left"), "h.size")).alias("edge"))
        )
        # Without a boundary bucket all rows fit: the threshold is then beyond every hash.
        # At the last level the boundary is the rows of one hash: they are below the threshold if that is nearer.
        nearer = (F.col("e.edge.size") < 2 * F.col("e.edge.left")).cast("long") if shift == 0 else F.lit(0)
        state = (
            state.alias("s")
            .join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
            .select(
                "s.source",
                F.coalesce("e.edge.left", "s.budget").alias("budget"),
                F.when(F.col("e.edge").isNotNull(), F.shiftleft("e.edge.bucket", shift) + nearer).otherwise(F.lit(1 << HASH_BITS)).alias("low"),
            )
        )
        state = stage(state, "mix-level")
    return state.select("source", F.col("low").alias("threshold"))


def mix_rule(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies of every row) and threshold (rows whose hash is
    below it get one more). ``sizes`` has source, size, hash."""
    targets = stage(source_targets(sizes, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = thresholds(sizes, plan.select("source", "budget"))
    below = F.when(F.col("p.whole") < F.lit(int(most)), F.col("c.threshold")).otherwise(F.lit(0))
    return plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))).select("p.source", "p.source_size", "p.target", "p.whole", below.alias("threshold"))


def _sizes(docs: DataFrame, key: str) -> DataFrame:
    d = own(docs, key, "text", "source")
    return stage(d.select(key, "source", size_of(F.col("text")).alias("size"), hash_of(F.col(key)).alias("hash")), "mix-sizes")


def mix_counts(docs: DataFrame, key: str = "doc_id", **rules) -> DataFrame:
    """Per document: key, source, size, source_size, target of its source, and copies (how often the mix takes it)."""
    sizes = _sizes(docs, key)
    copies = F.col("r.whole") + (F.col("d.hash") < F.col("r.threshold")).cast("long")
    return (
        sizes.alias("d")
        .join(mix_rule(sizes, **rules).alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
        .select(f"d.{key}", "d.source", "d.size", "r.source_size", "r.target", copies.alias("copies"))
    )


def mix(docs: DataFrame, key: str = "doc_id", **rules) -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mix takes it. The texts are not shuffled: a
    row's copies follow from its hash and its source's rule."""
    rule = mix_rule(_sizes(docs, key), **rules)
    whole = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(whole.alias("row"), docs["source"].alias("source"), hash_of(docs[f"`{key}`"]).alias("hash")).alias("d")
    copies = (F.col("r.whole") + (F.col("d.hash") < F.col("r.threshold")).cast("long")).cast("int")
    each = rows.join(rule.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))).select("d.row", F.explode(F.array_repeat(F.lit(0), copies)))
    return each.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same mix by a running sum over all documents of a source in hash order.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM w),
l AS (SELECT *, (total - before) / open AS level FROM o),
t AS (
  SELECT source, source_size,
         coalesce(least(cap, (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN whole < 2 AND (run <= target - whole * source_size OR 2 * run - same < 2 * (target - whole * source_size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
