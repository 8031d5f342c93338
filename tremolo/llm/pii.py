"""Personal data: base patterns and a character-level bidirectional LSTM with CRF transitions, in numpy.

The base finds e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers by their
published patterns. The model finds more forms of the same kinds (spelled-out or bracketed addresses, numbers without
a country code, cards with other separators). It is trained on the driver from labelled spans: texts of a bounded
sample (``rows``), whose base spans are labelled, with generated data of many forms put into them, and look-alikes
(dates, versions, prices, keys) that stay unlabelled.

What an added span looks like is for the model alone to say: a span needs a margin over ``none``, set by kind on
labelled windows that were not trained on, besides a number of digits (and Luhn) that its kind can have.

Texts are cut into overlapping windows of characters. Both LSTM directions run over all windows of a slice at once;
the CRF decodes each window, and spans of overlapping windows are reconciled over the whole text: spans cut by a
window's edge give way to those of the window that saw them whole, overlapping spans of a kind are joined, and of
different kinds the longer stays. Windows in which no emission can make up for leaving ``none`` decode to nothing,
which is proven from the emissions and transitions; only the others need the Viterbi recursion.

Defined results: a null or empty text has no spans; base spans always stay, and added ones never overlap them;
positions are code points, end exclusive; rows are independent, so repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import list_array, map_texts, own

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1
WINDOW, STRIDE, HIDDEN, BATCH = 512, 400, 8, 1024  # windows overlap by more than the 80 characters of the longest span

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    """Leftmost matches of local@domain: the local part is the run of its characters before an @, after the last match."""
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and LOCAL.match(text, left - 1):
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        done = m.end() if m else at + 1
        if m:
            yield left, done
        at = text.find("@", done)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# Character classes: 0 pads; some letters and marks for themselves.
_OWN = "@.-+() \n_%:/[]=\"#,*{}<>|atdoe"
CLASSES = len(_OWN) + 6
_CLASS = np.full(128, 1, np.uint8)
for _i, _c in enumerate(_OWN):
    _CLASS[ord(_c)] = 6 + _i
for _c in range(128):
    if chr(_c) not in _OWN:
        _CLASS[_c] = 2 if chr(_c).isdigit() else 3 if chr(_c).islower() else 4 if chr(_c).isupper() else 1


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], 5).astype(np.uint8)


class Lstm:
    """One direction. Gate rows: input, forget, output (halved, so that one tanh serves all), candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int = HIDDEN):
        self.x = rng.normal(0, 0.3, (4 * hidden, CLASSES)).astype(np.float32)
        self.h = rng.normal(0, 0.3, (4 * hidden, hidden)).astype(np.float32)
        self.x[hidden : 2 * hidden] += 0.5
        self.n = hidden

    def run(self, x: np.ndarray, keep: bool = False):
        """``x``: (time, batch) classes; returns (time, hidden, batch) outputs, and what ``back`` needs."""
        n, (steps, batch) = self.n, x.shape
        out = np.empty((steps, n, batch), np.float32)
        h, c = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
        saved = []
        x = x.astype(np.intp)
        for t in range(steps):
            z = np.take(self.x, x[t], axis=1, mode="clip")
            z += self.h @ h
            np.tanh(z, out=z)
            z[: 3 * n] *= 0.5
            z[: 3 * n] += 0.5
            before = c
            c = z[n : 2 * n] * c
            c += z[:n] * z[3 * n :]
            tc = np.tanh(c)
            last, h = h, np.multiply(z[2 * n : 3 * n], tc, out=out[t])
            if keep:
                saved.append((z, before, tc, last))
        return (out, saved) if keep else out

    def back(self, x: np.ndarray, saved: list, d_out: np.ndarray):
        """Gradients of the two weight tables for the outputs' gradient."""
        n, (steps, batch) = self.n, x.shape
        gx, gh = np.zeros_like(self.x), np.zeros_like(self.h)
        dh, dc = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
        for t in range(steps - 1, -1, -1):
            z, before, tc, last = saved[t]
            i, f, o, g = z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * 2 * i * (1 - i), dc * before * 2 * f * (1 - f), dh * tc * 2 * o * (1 - o), dc * i * (1 - g * g)])
            dz = dz.astype(np.float32)
            gh += dz @ last.T
            for k in range(4 * n):
                gx[k] += np.bincount(x[t], dz[k], minlength=CLASSES)
            dh, dc = self.h.T @ dz, dc * f
        return gx, gh


@dataclass
class Model:
    forward: Lstm
    backward: Lstm
    out: np.ndarray  # (TAGS, 2 * hidden)
    bias: np.ndarray
    trans: np.ndarray  # (TAGS, TAGS): from, to
    least: np.ndarray | None = None  # by kind, the margin over no span that an added span needs

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, TAGS, batch) for (time, batch) classes."""
        n = self.forward.n
        e = np.matmul(self.out[:, :n], self.forward.run(x))
        e += np.matmul(self.out[:, n:], self.backward.run(x[::-1])[::-1])
        e += self.bias[:, None]
        return e

    def spans(self, x: np.ndarray) -> dict[int, list[tuple[int, int, int, float]]]:
        """(first, kind, end, margin) of the best path of each window (column) that has any: the margin is what the
        span's part of the path scores above staying at ``none``."""
        out = {}
        stay = self.trans[0, 0]
        for w, (tags, e) in self.decode(x, True).items():
            turn = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]]))).tolist()
            spans = []
            for s, end in zip(turn, turn[1:]):
                if k := int(tags[s]):
                    steps = (end - s - 1) * self.trans[k, k] + self.trans[0, k] * (s > 0) + self.trans[k, 0] * (end < len(tags))
                    none = (end - s - 1 + (s > 0) + (end < len(tags))) * stay
                    spans.append((s, k - 1, end, float((e[s:end, k] - e[s:end, 0]).sum() + steps - none)))
            if spans:
                out[w] = spans
        return out

    def decode(self, x: np.ndarray, with_emissions: bool = False) -> dict[int, np.ndarray]:
        """Best tags of the windows (columns) that may have any but 0."""
        e = self.emissions(x)
        gain = max(0.0, float((self.trans - self.trans[0, 0]).max()))
        # A path that leaves tag 0 at a step gains at most its emission's lead and two better transitions.
        lead = (e[:, 1:] - e[:, :1]).max((0, 1))
        on = np.flatnonzero(lead + 2 * gain > 0)
        tags = self.viterbi(e[:, :, on])
        if with_emissions:
            return {int(w): (tags[:, k], e[:, :, w]) for k, w in enumerate(on) if tags[:, k].any()}
        return {int(w): tags[:, k] for k, w in enumerate(on) if tags[:, k].any()}

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        steps, _, batch = e.shape
        back = np.zeros((steps, TAGS, batch), np.int8)
        trans = self.trans[:, :, None].astype(np.float32)
        s = e[0].copy() if steps else np.zeros((TAGS, batch), np.float32)
        for t in range(1, steps):
            best = s[0] + trans[0]
            for k in range(1, TAGS):
                other = s[k] + trans[k]
                np.copyto(back[t], k, where=other > best)
                np.maximum(best, other, out=best)
            s = best + e[t]
        tags = np.zeros((steps, batch), np.int8)
        if steps:
            tags[-1] = s.argmax(0)
            for t in range(steps - 1, 0, -1):
                tags[t - 1] = back[t][tags[t], np.arange(batch)]
        return tags


def _crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray):
    """Of the log likelihood by emissions and transitions: (time, TAGS, batch), (TAGS, TAGS)."""
    steps, _, batch = e.shape
    pot = np.exp(trans)
    top = e.max(1, keepdims=True)
    p = np.exp(e - top)
    alpha, beta = np.empty_like(p), np.ones_like(p)
    alpha[0] = p[0] / p[0].sum(0)
    for t in range(1, steps):
        a = p[t] * (pot.T @ alpha[t - 1])
        alpha[t] = a / a.sum(0)
    for t in range(steps - 2, -1, -1):
        b = pot @ (p[t + 1] * beta[t + 1])
        beta[t] = b / b.sum(0)
    m = alpha * beta
    m /= m.sum(1, keepdims=True)
    ge = -m
    cols = np.arange(batch)
    gt = np.zeros_like(trans)
    for t in range(steps):
        ge[t, y[t], cols] += 1
        if t:
            pair = alpha[t - 1][:, None] * pot[:, :, None] * (p[t] * beta[t])[None]
            pair /= pair.sum((0, 1))
            gt -= pair.sum(2)
            np.add.at(gt, (y[t - 1], y[t]), 1)
    return ge, gt


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 260, batch: int = 160, rate: float = 0.02) -> Model:
    """A model from (time, windows) classes and tags, by Adam on the conditional likelihood."""
    rng = np.random.default_rng(seed)
    f, b = Lstm(rng), Lstm(rng)
    model = Model(f, b, rng.normal(0, 0.2, (TAGS, 2 * f.n)).astype(np.float32), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS)))
    params = [f.x, f.h, b.x, b.h, model.out, model.bias, model.trans]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = f.n
    for t in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], min(batch, x.shape[1]))
        bx, by = x[:, pick], y[:, pick].astype(np.int64)
        (hf, sf), (hb, sb) = f.run(bx, True), b.run(bx[::-1], True)
        hb = hb[::-1]
        e = np.matmul(model.out[:, :n], hf) + np.matmul(model.out[:, n:], hb) + model.bias[:, None]
        ge, gt = _crf_gradient(e, by, model.trans)
        go = np.concatenate([np.einsum("tkb,thb->kh", ge, hf), np.einsum("tkb,thb->kh", ge, hb)], 1)
        grads = [*f.back(bx, sf, np.matmul(model.out[:, :n].T, ge)), *b.back(bx[::-1], sb, np.matmul(model.out[:, n:].T, ge)[::-1]), go, ge.sum((0, 2)), gt]
        lr = rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
        for k, (p, g) in enumerate(zip(params, grads)):
            g = np.clip(g / len(pick), -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(p.dtype)
    return model


def _made(rng: np.random.Generator) -> tuple[str, int]:
    """A generated piece of personal data (kind + 1) or a look-alike (0)."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    w = lambda a, b: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(a, b + 1)))
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    kind = int(rng.choice(5, p=[0.34, 0.24, 0.12, 0.12, 0.18]))
    if kind == 1:
        local = w(2, 8) + pick("", "." + w(2, 6), d(2), "." + d(2), "_" + w(2, 5))
        host, top = w(2, 8) + pick("", d(1)), pick("com", "org", "net", "example.com", "de", "fr")
        at, dot = pick("@", "@", " at ", " [at] ", "(at)", " (at) ", "[at]", " @ "), pick(".", ".", " dot ", " [dot] ", "(dot)", "[dot]")
        if at == "@" and rng.random() < 0.7:
            dot = "."
        elif at.strip() in ("at",):
            dot = " dot "
        if rng.random() < 0.2:
            local, host = local.capitalize(), host.capitalize()
        return local + at + host + dot + top.replace(".", dot), 1
    if kind == 2:
        part = lambda: str(int(rng.integers(0, 256)))
        if rng.random() < 0.25:
            dot = pick("[.]", "(.)", " . ", "[dot]")
            return dot.join(part() for _ in range(4)), 2
        return ".".join(part() for _ in range(4)), 2
    if kind == 3:
        n = pick(16, 16, 16, 15, 13, 19)
        body = d(n - 1)
        body = pick("3", "4", "5", "6") + body[1:]
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick("", "", " ", "-", ".", "/")
        return sep.join(body[i : i + 4] for i in range(0, n, 4)), 3
    if kind == 4:
        style = int(rng.integers(0, 8))
        forms = (f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}")
        return forms[style], 4
    h = lambda n: "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, n))
    return pick(
        f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(2)}", f"${d(3)}.{d(2)}", f"password={h(18)}", f'token = "{h(40)}"', f"AKIA{h(16).upper()}",
        d(4), d(2), d(6), d(8), f"{d(2)}:{d(2)}", f"{d(1)}.", f"{d(1)}.{d(1)}.", f"v{d(1)}.{d(2)}.{d(1)}", f"@{w(3, 8)}", f"{w(2, 5)} at {w(2, 6)}", f"{d(2)}-{d(2)}", f"({d(1)})", f"[{d(2)}]", "#" + d(3), f"{d(3)},{d(3)}",
        f"{w(3, 6)} dot {w(2, 6)}", "".join(pick(*"atdoe") for _ in range(int(rng.integers(3, 9)))), f"{w(2, 4)}{pick('dodo', 'dota', 'atato', 'dot', 'at')}{pick('', '. ', ' ')}{w(1, 4)}", f"{d(2)} {d(2)} {d(2)}", f"{d(1)},{d(3)},{d(3)}", "+ " + d(2), "+" + d(2),
    ), 0


def labelled_windows(texts: list[str], seed: int = 11, size: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: pieces of the texts with their base spans, generated data and look-alikes between words."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    texts = [t for t in texts if t] or ["the of and to in"]
    for _ in range(2400):
        t = texts[int(rng.integers(0, len(texts)))]
        a = int(rng.integers(0, max(1, len(t) - size)))
        piece = t[a : a + size]
        spans = base_spans(piece)
        if rng.random() < 0.85 and not spans:
            made, kind = _made(rng)
            gaps = [m.start() for m in re.finditer(r"\s", piece)] or [len(piece)]
            gap = gaps[int(rng.integers(0, len(gaps)))]
            before, after = (" ", " ") if rng.random() < 0.8 else (" ", ". ")
            piece = piece[:gap] + before + made + after + piece[gap:].lstrip()
            spans = [(gap + 1, kind - 1, gap + 1 + len(made))] if kind else []
            shift = max(0, min(gap + 1 + len(made) // 2 - size // 2, len(piece) - size))
            piece, spans = piece[shift:], [(max(0, s - shift), k, e - shift) for s, k, e in spans]
        x, y = np.zeros(size, np.uint8), np.zeros(size, np.int8)
        c = classes(piece)[:size]
        x[: len(c)] = c
        for s, k, e in spans:
            y[s:e] = k + 1
        xs.append(x)
        ys.append(y)
    return np.stack(xs, 1), np.stack(ys, 1)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, precision: float = 0.9) -> Model:
    """Sets ``model.least``: by kind, the least margin with which ``precision`` of the spans found in labelled windows
    are labelled."""
    model.least = np.zeros(len(KINDS))
    found = [
        (k, margin, bool((y[s:e, w] == k + 1).mean() > 0.5))
        for w, spans in model.spans(x).items()
        for s, k, e, margin in spans
        if DIGITS[k][0] <= (x[s:e, w] == _CLASS[ord("0")]).sum() <= DIGITS[k][1]
    ]
    for kind in range(len(KINDS)):
        of = sorted(((m, ok) for k, m, ok in found if k == kind), reverse=True)
        good, at = 0, None
        for n, (m, ok) in enumerate(of, 1):
            good += ok
            if good >= precision * n:
                at = m
        model.least[kind] = at if at is not None else np.inf
    return model


#: Models fitted by this process, by what they were trained on.
_FITTED: dict[str, Model] = {}


def fit(docs: DataFrame, key: str = "doc_id", rows: int = 300, seed: int = 7, max_chars: int = 20_000) -> Model:
    """A model from a bounded sample: about ``rows`` texts, of longer ones ``max_chars`` characters from a place that
    their id gives. The same for the same rows; a process trains once for the same sample."""
    d = own(docs, key, "text")
    total = max(1, d.count())
    h = F.xxhash64(F.lit("pii"), F.col(key))
    share = F.pmod(h, F.lit(1 << 30)) < F.lit(min(1.0, rows / total) * (1 << 30))
    spare = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    piece = F.substring("text", F.pmod(F.xxhash64(h), spare).cast("int") + 1, F.lit(max_chars))
    texts = sorted(r[0] for r in d.where(share & F.col("text").isNotNull()).select(piece).limit(4 * rows).collect())
    name = hashlib.sha256("\0".join([str(seed), *texts]).encode("utf-8", "surrogatepass")).hexdigest()
    if name not in _FITTED:
        _FITTED[name] = calibrate(train(*labelled_windows(texts), seed=seed), *labelled_windows(texts, seed=12))
    return _FITTED[name]


#: Fewest and most digits of an added span of each kind; cards also pass Luhn. No span is longer than ``LONGEST``.
DIGITS, LONGEST = ((0, 80), (4, 12), (12, 19), (7, 15)), 80


def _plausible(text: str, start: int, end: int, kind: int) -> bool:
    """Digit counts, Luhn, whole words, and two parts of an address: the rest is for the model to say."""
    s = text[start:end]
    if len(s) > LONGEST or "\n" in s or text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    if kind == 0 and not re.search(r"\w[^\w.]+\w", s):
        return False
    d = _digits(s)
    return DIGITS[kind][0] <= len(d) <= DIGITS[kind][1] and (kind != 2 or luhn(d))


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first character of every window; the last window of a text ends with it."""
    count = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, np.minimum(place * STRIDE, np.maximum(sizes[text] - WINDOW, 0))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    t = text[start:end]
    return start + len(t) - len(t.lstrip(" .,;:-")), end - (len(t) - len(t.rstrip(" .,;:-(")))


def _rejoined(pieces: list[tuple[int, int, int]], text: str | None) -> list[tuple[int, int, int]]:
    """Cut spans of a kind that overlap as one; where what they make is not plausible in the text, those that are."""
    groups: list[list[tuple[int, int, int]]] = []
    for s, k, e in sorted(pieces, key=lambda x: (x[1], x[0], x[2])):
        if groups and groups[-1][0][1] == k and s < max(x[2] for x in groups[-1]):
            groups[-1].append((s, k, e))
        else:
            groups.append([(s, k, e)])
    out = []
    for g in groups:
        for option in ([(g[0][0], g[0][1], max(x[2] for x in g))], g):
            if text is not None:
                option = [(*_trimmed(text, s, e), k) for s, k, e in option]
                option = [(s, k, e) for s, e, k in option if s < e and _plausible(text, s, e, k)]
            if option:
                out += option
                break
    return out


def reconcile(found: list[tuple[int, int, int, bool]], base: list[tuple[int, int, int]], text: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of one text from windows' spans (start, kind, end, cut by an edge) and the base spans.

    With ``text``, cut spans are as the windows gave them, and tested once they are joined."""
    whole = sorted((s, k, e) for s, k, e, cut in found if not cut)
    for s, k, e in _rejoined([x[:3] for x in found if x[3]], text):  # a cut span counts where no window saw it whole
        if not any(a < e and s < b for a, _, b in whole):
            whole.append((s, k, e))
    joined: list[list[int]] = []
    for s, k, e in sorted(whole):
        if joined and joined[-1][1] == k and s < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
        else:
            joined.append([s, k, e])
    kept = list(base)
    for s, k, e in sorted(joined, key=lambda x: (x[0] - x[2], x[0], x[1])):  # longest first
        if not any(a < e and s < b for a, _, b in kept):
            kept.append((s, k, e))
    return sorted(kept)


def added_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """Spans of all windows of each text, in the text's code points. Those cut by an edge are left out where another
    window saw the place whole; the others are plausible or not once they are joined."""
    code = [classes(t) for t in texts]
    sizes = np.array([len(c) for c in code])
    flat = np.concatenate([*code, np.zeros(WINDOW, np.uint8)])
    first = np.cumsum(sizes) - sizes
    text, start = windows_of(sizes)
    opens = np.searchsorted(text, np.arange(len(texts) + 1))
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    for a in range(0, len(text), BATCH):
        row, at = text[a : a + BATCH], start[a : a + BATCH]
        x = flat[(first[row] + at)[None] + np.arange(WINDOW)[:, None]]
        x[np.arange(WINDOW)[:, None] >= (sizes[row] - at)[None]] = 0
        for w, spans in model.spans(x).items():
            r, s0, n = int(row[w]), int(at[w]), int(min(WINDOW, sizes[row[w]] - at[w]))
            for s, k, e, margin in spans:
                e = min(e, n)
                if s >= e:
                    continue
                if (s == 0 and s0 > 0) or (e == n and s0 + n < sizes[r]):
                    # what another window saw whole is for that one to say
                    others = start[opens[r] : opens[r + 1]]
                    seen = (others < s0 + s) & ((others + WINDOW > s0 + e) | (others + WINDOW >= sizes[r]))
                    if margin >= model.least[k] and not seen.any():
                        out[r].append((s0 + s, k, s0 + e, True))
                    continue
                s1, e1 = _trimmed(texts[r], s0 + s, s0 + e)
                if margin >= model.least[k] and s1 < e1 and _plausible(texts[r], s1, e1, k):
                    out[r].append((s1, k, e1, False))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, base (text of the base spans), found (array of kind, start, end of all) per row, and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = own(docs, *dict.fromkeys((*keep, "text")))
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)

    def run(part):
        texts = [t or "" for t in part.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        every = [reconcile(f, b, t) for f, b, t in zip(added_spans(texts, shared.value), base, texts)]
        n = np.array([np.bincount([k for _, k, _ in b], minlength=len(KINDS)) for b in base], np.int64).reshape(-1, len(KINDS))
        spans = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for x in every for _, k, _ in x], pa.string()), pa.array([s for x in every for s, _, _ in x], pa.int64()), pa.array([e for x in every for _, _, e in x], pa.int64())], ["kind", "start", "end"]
        )
        return pa.RecordBatch.from_arrays(
            [part.column(c) for c in keep] + [pa.array(n[:, k]) for k in range(len(KINDS))]
            + [pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(x) for x in every]), list_array(spans, np.array([len(x) for x in every]))],
            [*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"],
        )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_texts(d, run, f"{kinds}, {counts}, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs)).drop("found")
