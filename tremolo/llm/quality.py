"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is described by facts of itself and of its neighbours (shares of character kinds, repeated words, word
lengths) and labelled good or bad; transitions tie neighbouring labels together. Training lines carry their
document's label; the likelihood and its gradient come from the forward-backward recursion over all sample documents
at once, and the weights from Adam steps. A document's quality is the mean of its lines' marginals of good,
weighted by line length, put on a probability scale by a logistic curve fitted to the sample.

The model is fitted to a bounded sample (``rows`` labelled documents, by hash of the id); scoring covers every whole
text. Labels, language, source and id never enter a score.

Defined results: a null or empty text is one empty line and gets the score of that; without labelled rows every
score is 0.5; rows with equal ids are scored each by its own text; of repeated label rows of an id one with the
highest label counts; labels of other values than 0 and 1 are ignored; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import Spans, crc32_of, list_array, map_texts, own, utf8, words

KINDS = ("lower", "upper", "digit", "space", "point", "mark", "bar", "bang", "high")
_KIND = np.full(256, KINDS.index("mark"), np.int8)
for _k, _bytes in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("point", b".,;:'\"-?()"), ("bar", b"|"), ("bang", b"!"), ("high", range(128, 256))):
    _KIND[list(_bytes)] = KINDS.index(_k)
OWN = len(KINDS) + 9
WIDTH = 3 * OWN + 3


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every line (cut at newlines, at least one a text), and lines per text."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], cut]), kind="stable")
    return starts, ends - starts, 1 + np.diff(np.searchsorted(cut, offsets))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of ``WIDTH`` numbers per line; line lengths; lines per text."""
    starts, length, counts = lines_of(data, offsets)
    kind = _KIND[data]
    share = np.zeros((len(starts), OWN), np.float32)
    size = np.maximum(length, 1)
    for k in range(len(KINDS)):
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=run[1:])
        share[:, k] = (run[starts + length] - run[starts]) / size
    lower, ws, we, _ = words(data, offsets)
    line = np.searchsorted(starts, ws, "right") - 1
    h = Spans(lower)(ws, we)
    same = np.zeros(len(ws), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    n = np.bincount(line, minlength=len(starts))
    k = len(KINDS)
    share[:, k] = np.bincount(line, same, minlength=len(starts)) / np.maximum(n, 1)
    share[:, k + 1] = np.bincount(line, we - ws, minlength=len(starts)) / np.maximum(n, 1) / 10
    share[:, k + 2] = np.log1p(n) / 5
    share[:, k + 3] = np.log1p(length) / 7
    share[:, k + 4] = length == 0
    share[:, k + 5] = share[:, KINDS.index("mark")] > 0.05
    share[:, k + 6] = share[:, KINDS.index("upper")] > 0.5
    share[:, k + 7] = share[:, k] > 0.2
    share[:, k + 8] = (share[:, KINDS.index("bar")] > 0.02) | (share[:, KINDS.index("bang")] > 0.05)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    x = np.zeros((len(starts), WIDTH), np.float32)
    x[:, :OWN] = share
    x[1:, OWN : 2 * OWN] = share[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = share[1:]
    x[first, OWN : 2 * OWN] = 0
    x[first + counts - 1, 2 * OWN : 3 * OWN] = 0
    x[first, -3] = 1
    x[first + counts - 1, -2] = 1
    x[:, -1] = 1
    return x, length, counts


def marginals(score: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, summed pair marginals (2 x 2), and the log partition sum of all texts.

    ``score`` is good's emission score over bad's; texts are stepped through together, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
    pot = np.exp(trans)
    emit = np.stack([np.zeros(len(score)), np.clip(score, -40, 40)], 1)
    top = emit.max(1)
    emit = np.exp(emit - top[:, None])
    alpha = np.zeros((len(score), 2))
    beta = np.ones((len(score), 2))
    z = float(top.sum())
    for t in range(steps):
        at = first[: active[t]] + t
        a = emit[at] * (1.0 if t == 0 else alpha[at - 1] @ pot)
        norm = a.sum(1)
        alpha[at] = a / norm[:, None]
        z += float(np.log(norm).sum())
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (emit[at + 1] * beta[at + 1]) @ pot.T
        beta[at] = b / b.sum(1)[:, None]
    p = alpha * beta
    p /= p.sum(1)[:, None]
    inner = np.ones(len(score), bool)
    inner[first + sizes - 1] = False
    at = np.flatnonzero(inner)
    pair = alpha[at][:, :, None] * pot[None] * (emit[at + 1] * beta[at + 1])[:, None, :]
    pair /= pair.sum((1, 2))[:, None, None]
    return p[:, 1], pair.sum(0), z


@dataclass
class Model:
    """Emission weights, transition scores, the feature scale and the logistic curve of document scores."""

    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def lines(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) and length of every line; lines per text."""
        x, length, counts = features(data, offsets)
        p, _, _ = marginals(((x - self.mean) / self.scale) @ self.weights, counts, self.trans)
        return p, length, counts

    def raw(self, p: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        row = np.repeat(np.arange(len(counts)), counts)
        weight = np.maximum(length, 1).astype(float)
        return np.bincount(row, p * weight, minlength=len(counts)) / np.bincount(row, weight, minlength=len(counts))

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(raw) + self.offset, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _slices(offsets: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of whole texts with about ``limit`` bytes each, so that the driver's temporaries stay small."""
    out, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.08, ridge: float = 1e-3) -> Model:
    """Weights that maximise the sample's conditional likelihood."""
    parts = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _slices(offsets)]
    x, length, counts = (np.concatenate(p) for p in zip(*parts))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    y = np.repeat(labels, counts).astype(float)
    stay = counts - 1
    seen = np.array([[stay[labels == 0].sum(), 0], [0, stay[labels == 1].sum()]], float)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p, pair, _ = marginals(x @ theta[:WIDTH], counts, theta[WIDTH:].reshape(2, 2))
        g = np.concatenate([x.T @ (y - p), (seen - pair).ravel()]) / max(len(y), 1) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = Model(theta[:WIDTH].astype(np.float32), theta[WIDTH:].reshape(2, 2), mean, scale)
    p, _, _ = marginals(x @ theta[:WIDTH], counts, model.trans)
    f = np.stack([_logit(model.raw(p, length, counts)), np.ones(len(labels))], 1)
    w = np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (q * (1 - q))[:, None]).T @ f + 1e-2 * np.eye(2), f.T @ (labels - q) - 1e-2 * w)
        w += np.clip(step, -2, 2)
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = 4000, seed: str = "quality", max_chars: int = 50_000) -> Model | None:
    """A model from documents and their 0/1 labels; None without labelled documents of both kinds.

    The sample has about ``rows`` documents, none of more than ``max_chars`` characters, so its bytes are bounded too."""
    known = own(labels, key, label).where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("label"))
    total = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < F.lit(min(1.0, rows / total) * (1 << 20))).limit(2 * rows)
    table = own(docs, key, "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(F.broadcast(chosen), key).select("text", "label").limit(4 * rows).toArrow()  # bounded by ``rows``
    y = table["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    order = np.argsort([hash_text(t) for t in table["text"].to_pylist()], kind="stable")  # the same order in every run
    table = table.take(pa.array(order))
    return train(*utf8(table["text"]), table["label"].to_numpy())


def hash_text(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def score_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), with_lines: bool = False) -> DataFrame:
    """Columns ``keep``, score (0 to 1), predicted and n_lines; with ``with_lines`` also the lines' marginals."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = own(docs, *dict.fromkeys((*keep, "text")))
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)

    def run(part):
        model = shared.value
        data, offsets = utf8(part.column("text"))
        if model is None:
            counts = lines_of(data, offsets)[2]
            p, score = np.full(int(counts.sum()), 0.5), np.full(len(counts), 0.5)
        else:
            p, length, counts = model.lines(data, offsets)
            score = model.scores(model.raw(p, length, counts))
        out = [part.column(c) for c in keep] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(counts)]
        names = [*keep, "score", "predicted", "n_lines"]
        if with_lines:
            out.append(list_array(p.astype(float), counts))
            names.append("line_good")
        return pa.RecordBatch.from_arrays(out, names)

    return map_texts(d, run, f"{kinds}, score double, predicted int, n_lines bigint" + ", line_good array<double>" * with_lines)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that the model does not reject (all of them without a model)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part):
        if shared.value is None:
            return part
        p, length, counts = shared.value.lines(*utf8(part.column("text")))
        return part.filter(pa.array(shared.value.scores(shared.value.raw(p, length, counts)) >= 0.5))

    return map_texts(docs, run, docs.schema)


def held_out(key="doc_id"):
    return F.pmod(crc32_of(F.col(key)), F.lit(3)) == 1


def fitted(spark, sf_dir: str) -> Model | None:
    """The production model: labels of ids whose crc32 modulo 3 is not 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit(docs, labels.where(~held_out()))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    """A document without an id has no remainder: it is neither held out nor learned from."""
    return score_documents(docs, fitted(spark, sf_dir)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "n_lines")
