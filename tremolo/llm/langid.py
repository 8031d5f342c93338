"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order four over lower-cased letters, every run of other characters being one
boundary mark. N-gram counts are gathered by Spark from a bounded sample of labelled rows (``rows_per_lang`` of each
language); absolute discounting with continuation counts turns them into probabilities. The models of all languages
share sorted arrays of n-gram hashes, one per order, with a column of log probabilities per language, so scoring a
text is a few binary searches per character. The language with the lowest length-normalised cross-entropy wins.
A logistic curve over the margin to the second best, and a bound on the best cross-entropy, are calibrated on sample
rows that the counts do not use; texts beyond the bound, or of too low a score, are not accepted.

Defined results: ``und`` with score 0 for a null text or one without a letter; without labelled rows every text is
``und``; ties between languages go to the first in code-point order; rows are independent of each other, so
repeated rows agree; other columns are ignored, and language, source and id never enter a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import BASE, crc32_of, map_texts, mix, own

ORDER, DISCOUNT_FLOOR = 4, 0.1
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased letters with one 0 for each run of others, each text between two of them; offsets."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in low), np.int64, len(low))
    code = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_is_letter()[code], code, 0).astype(np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    keep[offsets[:-1]] = True
    run = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], run[offsets]


def _hashes(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` characters that end at each place from n - 1 on."""
    size = len(code) - n + 1
    h = np.full(max(size, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * BASE + code[j : j + len(h)].astype(np.uint64)
    return mix(h)


@dataclass
class Model:
    """Sorted n-gram hashes by order, log probabilities and log back-off weights by language, and the calibration."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    context: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    slope: float = 1.0
    offset: float = 0.0
    bound: float = float("inf")
    least_score: float = 0.5

    def log_probabilities(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the character at each place ``at`` (>= ORDER - 1) after those before it, by language."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            h = _hashes(code, n)[at[left] - n + 1]
            i = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][i] == h
            out[left[hit]] += self.logp[n - 1][i[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if n > 1:  # unseen in every language: the context's back-off weight, then the next lower order
                h = _hashes(code, n - 1)[at[left] - n + 1]
                i = np.minimum(np.searchsorted(self.context[n - 1], h), len(self.context[n - 1]) - 1)
                known = self.context[n - 1][i] == h
                out[left[known]] += self.backoff[n - 1][i[known]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by language, and whether a text has a letter."""
        code, offsets = characters(texts)
        code = np.concatenate([np.zeros(ORDER, np.uint32), code])
        total = np.zeros((len(texts), len(self.langs)))
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        place = np.arange(len(code) - ORDER) + ORDER
        inner = place - ORDER > offsets[:-1][row]  # all but each text's first mark
        lp = self.log_probabilities(code, place[inner]) if self.langs else np.zeros((int(inner.sum()), 0))
        n = np.bincount(row[inner], minlength=len(texts))
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(row[inner], lp[:, k], minlength=len(texts))
        letters = np.bincount(row, code[ORDER:] != 0, minlength=len(texts)) > 0
        return -total / np.maximum(n, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted."""
        h, letters = self.entropies(texts)
        lang = np.full(len(texts), "und", object)
        score, accepted = np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.langs:
            return lang, score, accepted
        best = np.argmin(h, 1)
        low = h[np.arange(len(h)), best]
        score = np.where(letters, _sigmoid(self.slope * _margin(h) + self.offset), 0.0)
        accepted = letters & (low <= self.bound) & (score >= self.least_score)
        names = np.array(self.langs, object)
        lang[letters] = names[best[letters]]
        return lang, score, accepted


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _margin(h: np.ndarray) -> np.ndarray:
    if h.shape[1] < 2:
        return np.ones(len(h))
    low = np.partition(h, 1, axis=1)
    return low[:, 1] - low[:, 0]


def _sample(labelled: DataFrame, lang: str, key: str, rows: int, seed: str) -> DataFrame:
    """About ``rows`` rows of each language, the same in every run: ids whose hash is under the language's share."""
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # one row per language
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, rows / n))).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < share * F.lit(1 << 20))


def _gram_counts(sample: DataFrame, lang: str) -> DataFrame:
    """lang, a, b (two characters each), n: order-four counts."""

    def run(part):
        names, out = part.column(lang).to_pylist(), []
        texts = part.column("text").to_pylist()
        for name in sorted(set(names)):
            code, offsets = characters([t for t, x in zip(texts, names) if x == name])
            code = np.concatenate([np.zeros(ORDER, np.uint32), code]).astype(np.int64)
            pad = np.setdiff1d(np.arange(ORDER, len(code)), offsets[:-1] + ORDER)
            a = code[pad - 3] << 21 | code[pad - 2]
            b = code[pad - 1] << 21 | code[pad]
            u, n = np.unique(np.stack([a, b]), axis=1, return_counts=True)
            out.append((name, u, n))
        return pa.RecordBatch.from_arrays(
            [pa.array([x for name, _, n in out for x in [name] * len(n)], pa.string()), pa.array(np.concatenate([u[0] for _, u, _ in out])), pa.array(np.concatenate([u[1] for _, u, _ in out])), pa.array(np.concatenate([n for *_, n in out]))],
            ["lang", "a", "b", "n"],
        )

    return map_texts(sample.select("text", lang), run, "lang string, a bigint, b bigint, n bigint").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def _kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order: n-grams, their probabilities, contexts, their back-off weights. ``grams`` has ORDER columns."""
    tables = {ORDER: (grams, counts.astype(float))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before the n-gram
        u, c = np.unique(tables[n + 1][0][:, 1:], axis=0, return_counts=True)
        tables[n] = (u, c.astype(float))
    result = []
    for n in range(1, ORDER + 1):
        g, c = tables[n]
        n1, n2 = max((c == 1).sum(), 1), max((c == 2).sum(), 1)
        d = min(max(n1 / (n1 + 2 * n2), DISCOUNT_FLOOR), 0.95)
        ctx, inverse = np.unique(g[:, :-1], axis=0, return_inverse=True)
        inverse = inverse.ravel()
        total, kinds = np.bincount(inverse, c), np.bincount(inverse)
        weight = d * kinds / total
        if n == 1:
            below = np.full(len(g), 1.0 / (len(g) + 1))
        else:
            below = _lookup(result[-1], g[:, 1:])
        p = np.maximum(c - d, 0) / total[inverse] + weight[inverse] * below
        result.append((g, p, ctx, weight))
    return result


def _lookup(table, grams: np.ndarray) -> np.ndarray:
    where = {tuple(x): p for x, p in zip(table[0].tolist(), table[1].tolist())}
    return np.array([where[tuple(x)] for x in grams.tolist()])


def _table_hashes(grams: np.ndarray) -> np.ndarray:
    n = grams.shape[1]
    h = np.full(len(grams), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * BASE + grams[:, j].astype(np.uint64)
    return mix(h)


def _joined(models: list[list[tuple]], langs: list[str]) -> Model:
    """The languages' tables over common sorted hash arrays."""
    floor = float(np.log(1.0 / (1 + max(len(m[0][0]) for m in models))))
    keys, logp, context, backoff = [], [], [], []
    for n in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([m[n - 1][0] for m in models]), axis=0)
        h = _table_hashes(grams)
        order = np.argsort(h)
        lp = np.zeros((len(grams), len(langs)), np.float32)
        ctx = np.unique(np.concatenate([m[n - 1][2] for m in models]), axis=0) if n > 1 else np.zeros((1, 0), int)
        ch = _table_hashes(ctx) if n > 1 else np.zeros(1, np.uint64)
        corder = np.argsort(ch)
        bo = np.zeros((len(ctx), len(langs)), np.float32)
        for k, m in enumerate(models):
            g, p, c, w = m[n - 1]
            own_h = np.sort(_table_hashes(g))
            by = np.argsort(_table_hashes(g))
            if n > 1:
                i = np.minimum(np.searchsorted(ch[corder], _table_hashes(c)), len(ch) - 1)
                bo[i, k] = np.log(w)
                low = np.searchsorted(keys[-1], _table_hashes(grams[:, 1:]))
                low = logp[-1][np.minimum(low, len(keys[-1]) - 1), k]
                at = np.minimum(np.searchsorted(ch[corder], _table_hashes(grams[:, :-1])), len(ch) - 1)
                lp[:, k] = bo[at, k] + low
            else:
                lp[:, k] = floor + np.log(w[0])
            i = np.minimum(np.searchsorted(own_h, h), len(own_h) - 1)
            hit = own_h[i] == h
            lp[hit, k] = np.log(p[by[i[hit]]])
        keys.append(h[order])
        logp.append(lp[order])
        context.append(ch[corder])
        backoff.append(bo)
    return Model(langs, keys, logp, context, backoff, floor)


def fit(labelled: DataFrame, lang: str = "lang", key: str = "doc_id", rows_per_lang: int = 1500, seed: str = "langid") -> Model:
    """A model from rows with text and language; three of four sample rows count, the fourth calibrates.

    Languages that have rows in the fourth only are counted from these, which then don't calibrate."""
    rows = own(labelled, key, "text", lang).where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    sample = _sample(rows, lang, key, rows_per_lang, seed)
    fourth = F.pmod(F.xxhash64(F.lit(seed + "-fold"), F.col(key)), F.lit(4)) == 0
    table = _gram_counts(sample.where(~fourth), lang).toArrow()  # bounded by the sample
    seen = table["lang"].unique().to_pylist()
    table = pa.concat_tables([table, _gram_counts(sample.where(fourth & ~F.col(lang).isin(seen)), lang).toArrow()])
    if not table.num_rows:
        return Model([], [], [], [], [], 0.0)
    names, a, b, n = (table[c].to_numpy() for c in ("lang", "a", "b", "n"))
    grams = np.stack([a >> 21, a & 0x1FFFFF, b >> 21, b & 0x1FFFFF], 1)
    langs = sorted(set(names.tolist()))
    model = _joined([_kneser_ney(grams[names == x], n[names == x]) for x in langs], langs)
    held = sample.where(fourth & F.col(lang).isin(seen or langs)).select("text", lang).limit(rows_per_lang * len(langs)).toArrow()
    if held.num_rows and len(langs) > 1:
        h, letters = model.entropies(held["text"].to_pylist())
        right = np.array(langs, object)[np.argmin(h, 1)] == held[lang].to_numpy()
        _calibrate(model, _margin(h)[letters], right[letters], h.min(1)[letters])
    return model


def _calibrate(model: Model, margin: np.ndarray, right: np.ndarray, low: np.ndarray) -> None:
    """Logistic curve by Newton steps with two prior rows of either outcome; bound: the 99.9 % quantile and a margin."""
    if not len(margin):
        return
    x = np.concatenate([margin, [0.0, 0.0, margin.max(), margin.max()]])
    y = np.concatenate([right, [0, 1, 1, 1]]).astype(float)
    w = np.zeros(2)
    f = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = _sigmoid(f @ w)
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2), f.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
    model.slope, model.offset = float(w[0]), float(w[1])
    model.bound = float(np.quantile(low, 0.999) * 1.1)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, lang_pred, score, accepted and lang_or_und (und where not accepted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = own(docs, *keep, "text")
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)

    def run(part):
        lang, score, accepted = shared.value.predict(part.column("text").to_pylist())
        sure = np.where(accepted, lang, "und")
        return pa.RecordBatch.from_arrays(
            [part.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score), pa.array(accepted), pa.array(sure, pa.string())], [*keep, "lang_pred", "score", "accepted", "lang_or_und"]
        )

    return map_texts(d, run, f"{kinds}, lang_pred string, score double, accepted boolean, lang_or_und string")


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    """A document without an id has no remainder: it is neither held out nor learned from."""
    held_out = F.pmod(crc32_of(F.col("doc_id")), F.lit(4)) == 2
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
