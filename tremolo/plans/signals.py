"""Queries of array and signal operators: the vectors of a table as short windows of samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.functions import arrays
from tremolo.plans.registry import query, r6, table

X = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _x(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _long(df, name="y", value="v"):
    return df.select("vec_id", F.posexplode(name).alias("i", "v")).select("vec_id", "i", (r6(F.col("v")) + F.lit(0.0)).alias(value))  # no -0.0


def _sql(expr: str, more: str = "") -> str:
    return f"WITH {X}{more}, y AS (SELECT vec_id, {expr} AS y FROM x) SELECT vec_id, (i - 1)::INT AS i, round(y[i], 6) + 0.0::DOUBLE AS v FROM y, (SELECT unnest(range(1, 65)) AS i)"


@query("demean", _sql("list_transform(x, lambda v: v - list_sum(x) / 64)"))
def demean(spark, sf_dir):
    """Samples less their mean."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.demean(F.col("x"))))


@query(
    "detrend",
    f"""WITH {X}, l AS (SELECT vec_id, i, x[i] AS v, i / 64.0::DOUBLE AS t FROM x, (SELECT unnest(range(1, 65)) AS i)),
f AS (SELECT vec_id, regr_slope(v, t) AS s, regr_intercept(v, t) AS c FROM l GROUP BY vec_id)
SELECT vec_id, (i - 1)::INT AS i, round(v - (s * t + c), 6) + 0.0::DOUBLE AS v FROM l JOIN f USING (vec_id)""",
)
def detrend(spark, sf_dir):
    """Samples less their least-squares line."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.detrend(F.col("x"))))


@query("taper", _sql("list_transform(x, lambda v, i: v * CASE WHEN i <= 3 THEN 0.5 - 0.5 * cos(2 * pi() * (i - 1) / 5) WHEN i > 61 THEN 0.5 - 0.5 * cos(2 * pi() * (64 - i) / 5) ELSE 1 END)"))
def taper(spark, sf_dir):
    """Hann halves at both ends."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.taper(F.col("x"))))


@query("standardize", _sql("list_transform(x, lambda v: (v - list_sum(x) / 64) / greatest(sqrt(greatest(list_sum(list_transform(x, lambda u: u * u)) / 64 - pow(list_sum(x) / 64, 2), 0)), 1e-12))"))
def standardize(spark, sf_dir):
    """Zero mean, unit deviation."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.standardize(F.col("x"))))


@query("asinh_scale", _sql("list_transform(x, lambda v: asinh(v / sqrt(list_sum(list_transform(x, lambda u: u * u)) / 64)))"))
def asinh_scale(spark, sf_dir):
    """Inverse hyperbolic sine of samples over their root mean square."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.asinh_scale(F.col("x"), arrays.rms(F.col("x")))))


@query("prefix_sum", _sql("list_transform(x, lambda v, i: list_sum(x[1:i]))"))
def prefix_sum(spark, sf_dir):
    """Running sums of samples."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.prefix_sum(F.col("x"))))


@query(
    "integrate_differences",
    f"""WITH {X}, n AS (SELECT vec_id, list_transform(x, lambda v: floor(v * 1000)::BIGINT) AS d FROM x)
SELECT vec_id, (i - 1)::INT AS i, list_sum(d[1:i])::BIGINT AS sample FROM n, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 5 > 0""",
)
def integrate_differences(spark, sf_dir):
    """Samples from first differences; those of records whose stored last sample disagrees are refused."""
    d = _x(spark, sf_dir).select("vec_id", F.transform("x", lambda v: F.floor(v * 1000).cast("long")).alias("d"))
    last = F.aggregate("d", F.lit(0).cast("long"), lambda a, v: a + v) + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)
    out = d.withColumn("y", arrays.integrate(F.col("d"), F.element_at("d", 1), last))
    return out.select("vec_id", F.posexplode("y").alias("i", "sample"))


LOW, BAND = arrays.butterworth("low", 10.0, 100.0), [*arrays.butterworth("high", 2.0, 100.0), *arrays.butterworth("low", 30.0, 100.0)]


def _iir_sql(x: str, section, first: str = "0.0::DOUBLE") -> str:
    """One section of a recursive filter over a list; its state starts as if ``first`` had always been there."""
    (b0, b1, b2), (a1, a2) = section
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    y = f"(e.v * {b0!r}::DOUBLE + s.p)"
    start = f"{{'p': {first} * {gain - b0!r}::DOUBLE, 'q': {first} * {b2 - a2 * gain!r}::DOUBLE, 'v': 0.0::DOUBLE, 'out': []::DOUBLE[]}}"
    each = f"list_transform({x}, lambda v: {{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'v': v, 'out': []::DOUBLE[]}})"
    return f"list_reduce(list_prepend({start}, {each}), lambda s, e: {{'p': e.v * {b1!r}::DOUBLE - {y} * {a1!r}::DOUBLE + s.q, 'q': e.v * {b2!r}::DOUBLE - {y} * {a2!r}::DOUBLE, 'v': 0.0::DOUBLE, 'out': list_append(s.out, {y})}}).out"


def _filtfilt_sql(source: str, sections, pad: int) -> str:
    """CTEs that end in ``ff`` (vec_id, x): the rows of ``source`` forward and backward over odd extensions."""
    ctes = [f"g0 AS (SELECT vec_id, list_concat(list_transform(list_reverse(x[2:{pad + 1}]), lambda v: 2 * x[1] - v), x, list_transform(list_reverse(x[{64 - pad}:63]), lambda v: 2 * x[64] - v)) AS x FROM {source})"]
    for way in range(2):
        level = 1.0
        for k, section in enumerate(sections):
            at = f"g{len(ctes) - 1}"
            head = "x[1]" if k == 0 else "head"
            keep = "x[1] AS head" if k == 0 else "head"
            ctes.append(f"g{len(ctes)} AS (SELECT vec_id, {keep}, {_iir_sql('x', section, f'({head} * {level!r}::DOUBLE)')} AS x FROM {at})")
            level *= sum(section[0]) / (1 + sum(section[1]))
        ctes.append(f"g{len(ctes)} AS (SELECT vec_id, list_reverse(x) AS x FROM g{len(ctes) - 1})")
    return ", ".join(ctes) + f", ff AS (SELECT vec_id, x[{pad + 1}:{pad + 64}] AS x FROM g{len(ctes) - 1})"


def _list_sql(ctes: str, expr: str) -> str:
    """Every entry of a list of 64 made from ``ff``."""
    return f"WITH {X}, {ctes}, y AS (SELECT vec_id, {expr} AS y FROM ff) SELECT vec_id, (i - 1)::INT AS i, round(y[i], 6) + 0.0::DOUBLE AS v FROM y, (SELECT unnest(range(1, 65)) AS i)"


@query("iir_fold", _sql(_iir_sql("x", LOW[0])))
def iir_fold(spark, sf_dir):
    """A recursive second-order section from rest."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.biquads(F.col("x"), LOW[:1])))


@query("fourth_order_filters", _list_sql(f"l1 AS (SELECT vec_id, {_iir_sql('x', BAND[0])} AS x FROM x), l2 AS (SELECT vec_id, {_iir_sql('x', BAND[1])} AS x FROM l1), l3 AS (SELECT vec_id, {_iir_sql('x', BAND[2])} AS x FROM l2), ff AS (SELECT vec_id, {_iir_sql('x', BAND[3])} AS x FROM l3)", "x"))
def fourth_order_filters(spark, sf_dir):
    """A high pass and a low pass of fourth order, two sections each."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.biquads(F.col("x"), BAND)))


STALTA = "list_reduce(list_prepend({'s': 0.0::DOUBLE, 'l': 2.2250738585072014e-308::DOUBLE, 'i': 0, 'v': 0.0::DOUBLE, 'out': []::DOUBLE[]}, list_transform(x, lambda v: {'s': 0.0::DOUBLE, 'l': 0.0::DOUBLE, 'i': 0, 'v': v * v, 'out': []::DOUBLE[]})), lambda a, e: {'s': CASE WHEN a.i = 0 THEN a.s ELSE e.v * 0.25::DOUBLE + a.s * 0.75::DOUBLE END, 'l': CASE WHEN a.i = 0 THEN a.l ELSE e.v * 0.0625::DOUBLE + a.l * 0.9375::DOUBLE END, 'i': a.i + 1, 'v': 0.0::DOUBLE, 'out': list_append(a.out, CASE WHEN a.i < 16 THEN 0.0::DOUBLE ELSE (e.v * 0.25::DOUBLE + a.s * 0.75::DOUBLE) / (e.v * 0.0625::DOUBLE + a.l * 0.9375::DOUBLE) END)}).out"


@query("stalta_fold", _sql(STALTA))
def stalta_fold(spark, sf_dir):
    """Recursive short over long average of the samples' energy."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.sta_lta(F.transform("x", lambda v: v * v), 4, 16)))


@query("filtfilt_zero_phase", _list_sql(_filtfilt_sql("x", LOW, 15), "x"))
def filtfilt_zero_phase(spark, sf_dir):
    """A fourth-order low pass without a shift, over odd extensions of three times its coefficients."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.filtfilt(F.col("x"), LOW, 15)))


CONDITIONED = f"""l AS (SELECT vec_id, i, x[i] AS v, i / 64.0::DOUBLE AS t FROM x, (SELECT unnest(range(1, 65)) AS i)),
f AS (SELECT vec_id, regr_slope(v, t) AS s, regr_intercept(v, t) AS c FROM l GROUP BY vec_id),
c1 AS (SELECT vec_id, list(v - (s * t + c) ORDER BY i) AS x FROM l JOIN f USING (vec_id) GROUP BY vec_id),
c2 AS (SELECT vec_id, list_transform(x, lambda v: v - list_sum(x) / 64) AS x FROM c1),
c3 AS (SELECT vec_id, list_transform(x, lambda v, i: v * CASE WHEN i <= 3 THEN 0.5 - 0.5 * cos(2 * pi() * (i - 1) / 5) WHEN i > 61 THEN 0.5 - 0.5 * cos(2 * pi() * (64 - i) / 5) ELSE 1 END) AS x FROM c2),
{_filtfilt_sql('c3', BAND, 27)}"""


@query("condition_window", _list_sql(CONDITIONED, "list_transform(x, lambda v: (v - list_sum(x) / 64) / greatest(sqrt(list_sum(list_transform(x, lambda u: u * u)) / 64 - pow(list_sum(x) / 64, 2)), 1e-12))"))
def condition_window(spark, sf_dir):
    """The conditioning chain: line, mean, taper, band pass without a shift, unit deviation."""
    return _long(_x(spark, sf_dir).withColumn("y", arrays.condition(F.col("x"), BAND, 27)))


@query(
    "chunk_argmax_pick",
    f"""WITH {X}, l AS (SELECT vec_id, i, x[i] AS v FROM x, (SELECT unnest(range(1, 65)) AS i)),
p AS (SELECT vec_id, arg_max(i, (v, -i)) AS p_at, max(v) AS p FROM l WHERE i BETWEEN 5 AND 40 GROUP BY vec_id),
s AS (SELECT l.vec_id, arg_min(l.i, (l.v, l.i)) AS s_at, min(l.v) AS s FROM l JOIN p ON l.vec_id = p.vec_id WHERE l.i BETWEEN p.p_at + 3 AND 60 GROUP BY l.vec_id)
SELECT p.vec_id, p_at::INT AS p_at, round(p, 6) AS p, s_at::INT AS s_at, round(coalesce(s, 0), 6) AS s FROM p LEFT JOIN s ON p.vec_id = s.vec_id""",
)
def chunk_argmax_pick(spark, sf_dir):
    """The best first phase in a range, then the best second phase after it."""
    l = _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i") + 1)  # noqa: E741
    p = l.where("i between 5 and 40").groupBy("vec_id").agg(F.max_by("i", F.struct(F.col("v"), -F.col("i"))).alias("p_at"), F.max("v").alias("p"))
    s = l.join(p, "vec_id").where("i between p_at + 3 and 60").groupBy("vec_id").agg(F.min_by("i", F.struct("v", "i")).alias("s_at"), F.min("v").alias("s"))
    return p.join(s, "vec_id", "left").select("vec_id", "p_at", r6(F.col("p")).alias("p"), "s_at", r6(F.coalesce("s", F.lit(0.0))).alias("s"))


@query(
    "aic_pick",
    f"""WITH {X}, l AS (SELECT vec_id, i, x[i] AS v FROM x, (SELECT unnest(range(1, 65)) AS i)),
w AS (SELECT *, sum(v) OVER a AS s, sum(v * v) OVER a AS q, sum(v) OVER (PARTITION BY vec_id) AS st, sum(v * v) OVER (PARTITION BY vec_id) AS qt FROM l WINDOW a AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT vec_id, i, i * ln(greatest(q / i - pow(s / i, 2), 1e-12)) + (64 - i - 1) * ln(greatest((qt - q) / (64 - i) - pow((st - s) / (64 - i), 2), 1e-12)) AS aic FROM w WHERE i BETWEEN 3 AND 61)
SELECT vec_id, arg_min(i, (round(aic, 6), i))::INT AS onset, round(min(aic), 4) AS aic FROM c GROUP BY vec_id""",
)
def aic_pick(spark, sf_dir):
    """Onset by the Akaike criterion from running sums."""
    l = _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i") + 1)  # noqa: E741
    a, t = W.partitionBy("vec_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("vec_id")
    sq = F.col("v") * F.col("v")
    w = l.select("vec_id", "i", F.sum("v").over(a).alias("s"), F.sum(sq).over(a).alias("q"), F.sum("v").over(t).alias("st"), F.sum(sq).over(t).alias("qt")).where("i between 3 and 61")
    n, m = F.col("i"), F.lit(64) - F.col("i")
    var = lambda q, s, k: F.greatest(q / k - F.pow(s / k, F.lit(2.0)), F.lit(1e-12))
    aic = n * F.log(var(F.col("q"), F.col("s"), n)) + (m - 1) * F.log(var(F.col("qt") - F.col("q"), F.col("st") - F.col("s"), m))
    c = w.withColumn("aic", aic)
    return c.groupBy("vec_id").agg(F.min_by("i", F.struct(r6(F.col("aic")), "i")).alias("onset"), F.round(F.min("aic"), 4).alias("aic"))


@query(
    "peak_displacement",
    f"""WITH {X}, l AS (SELECT vec_id, i, list_sum(x[1:i]) AS d FROM x, (SELECT unnest(range(1, 65)) AS i)), t AS (SELECT unnest([4, 8, 16, 32]) AS tau)
SELECT vec_id, tau, round(max(abs(d)), 6) AS pd FROM l, t WHERE i BETWEEN 17 AND 16 + tau GROUP BY vec_id, tau HAVING count(*) = tau""",
)
def peak_displacement(spark, sf_dir):
    """Peak of the integrated samples in growing windows after an onset."""
    l = _x(spark, sf_dir).select("vec_id", F.posexplode(arrays.prefix_sum(F.col("x"))).alias("i", "d"))  # noqa: E741
    t = l.withColumn("tau", F.explode(F.array(*[F.lit(k) for k in (4, 8, 16, 32)]))).where("i between 16 and 15 + tau")
    return t.groupBy("vec_id", "tau").agg(r6(F.max(F.abs("d"))).alias("pd"), F.count("*").alias("n")).where("n = tau").drop("n")


@query(
    "external_score_max",
    f"""WITH {X}, l AS (SELECT vec_id, label, (i - 1) // 8 AS win, x[i] AS v FROM x, (SELECT unnest(range(1, 65)) AS i)) SELECT vec_id, win::INT AS win, round(max(v), 6) AS score FROM l GROUP BY vec_id, win""",
)
def external_score_max(spark, sf_dir):
    """An external model's scores reduced to the maximum of every window of the grid."""
    l = _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v"))  # noqa: E741
    return l.groupBy("vec_id", F.floor(F.col("i") / 8).cast("int").alias("win")).agg(r6(F.max("v")).alias("score"))


@query(
    "envelope_class",
    f"""WITH {X}, s AS (SELECT vec_id, sqrt(list_sum(list_transform(x[1:16], lambda v: v * v)) / 16) AS noise, x FROM x), k AS (SELECT vec_id, len(list_filter(x, lambda v: abs(v) > 1.5 * noise)) AS above FROM s)
SELECT vec_id, above::INT AS above, CASE WHEN above < 8 THEN 'spike' WHEN above < 16 THEN 'transient' ELSE 'extended' END AS kind FROM k""",
)
def envelope_class(spark, sf_dir):
    """How long samples stay above a multiple of the lead's noise, as a class."""
    x = _x(spark, sf_dir).withColumn("noise", arrays.rms(F.slice("x", 1, 16)))
    k = x.select("vec_id", F.size(F.filter("x", lambda v: F.abs(v) > F.col("noise") * 1.5)).alias("above"))
    return k.withColumn("kind", F.when(F.col("above") < 8, "spike").when(F.col("above") < 16, "transient").otherwise("extended"))
