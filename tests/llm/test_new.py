"""Nearest neighbours, importance resampling and conversation repair against plain versions on awkward rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from tests.conftest import SF
from tests.llm.test_operators import words_of
from tremolo.llm import ann, near, pii, resample, turns
from tremolo.llm.common import utf8

NAN, INF = float("nan"), float("inf")


def plain_nearest(data, asked, k):
    """Exact nearest rows by (score, id): rows of one id count once, with the least vector."""
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    by = {}
    for i, v in data:
        if i is not None and ok(v):
            by[i] = min(by.get(i, v), v)
    out = set()
    for q in sorted({i for i, v in data if i in asked and i in by}):
        found = sorted((-float(np.dot(np.array(v, float), np.array(by[q], float))), i) for i, v in by.items() if i != q and len(v) == len(by[q]))
        out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(found[:k])}
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in rng.standard_normal(12) * (1 if i % 7 else 30)]) for i in range(700)]
    data += [(1000 + i, data[i][1]) for i in range(0, 60)]  # ties
    data += [data[20], data[40], (40, [99.0] * 12), (None, data[5][1]), (2000, None), (2020, []), (2040, [0.0] * 12), (2060, [1.0] * 11 + [NAN]), (2080, [1.0] * 11 + [INF]), (2100, [1.0] * 11 + [None]), (2120, [1.0, 2.0]), (2140, [1.0, 3.0]), (2160, [5.0])]
    schema = "vec_id long, embedding array<float>, id string, vector string, length string, block string, score string, `rank` string"
    df = spark.createDataFrame([(*d, *"xxxxxx") for d in data], schema).repartition(3)
    want = plain_nearest(data, {i for i, _ in data if i is not None and i % 20 == 0}, 20)
    for sizes in ({}, {"block": 100, "group": 10}):
        got = ann.neighbours(df, df.where("vec_id % 20 = 0"), **sizes)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "double"]
        got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()}
        pairs = lambda s: {(q, v) for q, _, v, _ in s}
        assert len(pairs(got) & pairs(want)) >= 0.99 * len(want) and len(got) == len(want)
        # few vectors lie in all windows, so every one of them is found, in order
        small = {r for r in want if r[0] >= 2120}
        assert small == {r for r in got if r[0] >= 2120}
    assert ann.neighbours(df.where("false"), df.where("false")).count() == 0
    assert ann.neighbours(df, df.where("false")).count() == 0


def test_nearest_recall(spark):
    got = collections.defaultdict(list)
    for r in sorted(ann.op11_nearest(spark, SF).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = collections.defaultdict(list)
    for q, _, v, _ in sorted(plain_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)):
        want[q].append(v)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert set(got) == set(want) and hits >= 0.98 * sum(map(len, want.values()))


def test_windows_expand_to_the_whole_block():
    """Without a verified vector inside the radius, windows grow until they hold every row."""
    index = ann.Index(np.arange(30), np.concatenate([np.full((29, 3), -1.0), [[1e6, 0, 0]]]))
    q, v, s = index.nearest(np.array([100]), np.array([[1.0, 1.0, 1.0]]), 20)
    assert v[np.argmax(s)] == 29 and len(set(v)) == 30  # 29 tie for the other places


def plain_resample(docs, target, percent=5):
    def counted(texts):
        each = []
        for t in texts:
            w = words_of(t)
            each.append([" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)])
        return each

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    mine, theirs = counted(t for _, t in docs), counted(target)
    s, t = (collections.Counter(bucket(f) for fs in x for f in fs) for x in (mine, theirs))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    rows = []
    for (k, text), fs in zip(docs, mine):
        h = int(hashlib.sha256(f"42:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = collections.Counter()
    rank = {}
    for i, r in enumerate(order[: percent * len(order) // 100]):
        rank.setdefault(r[:4], []).append(i + 1)
    out = []
    for r in rows:
        places = rank.get(r[:4], [])
        out.append((*r[:4], places[drawn[r[:4]]] if r[4] and drawn[r[:4]] < len(places) else None))
        drawn[r[:4]] += r[4]
    return out


def test_resample(spark, docs, empty):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(["the quick brown fox jumps", None, "", "woods near river and the lazy dog"])], "item_id long, text string")
    texts = [r["text"] for r in target.collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: tuple(str(x) for x in r)
    for percent, sizes in ((5, {}), (50, {}), (60, {"range_rows": 1, "run_rows": 2, "block_rows": 1}), (100, {"range_rows": 2, "run_rows": 3, "block_rows": 2}), (0, {})):
        got = resample.resample(docs, target, percent=percent, **sizes)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(key, got.collect())) == sorted(map(key, plain_resample(rows, texts, percent)))
    assert resample.resample(empty, target).count() == 0
    assert resample.resample(docs, target.where("false")).count() == len(rows)


def test_resample_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = resample.op12_resampling(spark, SF)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_resample(rows, texts)))


def test_crc_of_joined_strings():
    rng = np.random.default_rng(1)
    a, b = ([rng.bytes(int(n)) for n in rng.integers(0, 3000, 200)] for _ in range(2))
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (resample.followed(crc(a), np.array([len(x) for x in b]), crc(b)) == crc([x + y for x, y in zip(a, b)])).all()


def test_tournament_merge():
    rng = np.random.default_rng(2)
    for runs in (1, 2, 7, 40):
        blocks, every = [], []
        for r in range(runs):
            keys = sorted(rng.integers(0, 50, int(rng.integers(1, 60))).tolist())
            every += keys
            blocks += [(r, [((k,), k) for k in keys[i : i + 3]]) for i in range(0, len(keys), 3)]
        blocks.sort(key=lambda b: b[1][0][0])
        for most in (0, 1, len(every) // 2, len(every), len(every) + 5):
            got = list(resample.merge_blocks(iter(blocks), most))
            assert [v for v, drawn in got if drawn] == sorted(every)[:most]
            assert sorted(v for v, _ in got) == sorted(every)


SPACE = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    f = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{f(conv)}:{f(turn)}".encode()) % 20
        role, text = f(role), f(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Faults, and the cheapest edits by dynamic programming over the number of edits so far, audits compared whole."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    counts, marks, seen = collections.Counter(), [], set()
    for _, _, role, text in rows:
        last = SPACE.findall(text)
        mark = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        counts[mark] += 1
        marks.append(mark)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", [])}

    def put(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, told) in list(table.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        put(table, step[state, role[0]], (cost + 2, audit + "I", [*told, (role, "")]))

    inserts(best)
    for (_, _, role, text), mark in zip(rows, marks):
        after = {}
        for state, (cost, audit, told) in best.items():
            put(after, state, (cost + 3, audit + "D", told))
            if mark in ("blank", "duplicate"):
                continue
            for name, price, edit in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                if (state, name[:1]) in step:
                    put(after, step[state, name[:1]], (cost + price + (mark == "truncated"), audit + edit, [*told, (name, text)]))
        inserts(after)
        best = after
    cost, audit, told = min(best[s] for s in ("", "a") if s in best)
    turns_ = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def plain_conversations(rows):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return sorted(str((c, *plain_repair(rs))) for c, rs in by.items())


def test_repair_is_cheapest_of_all_edits():
    """All edit strings of up to eight letters over short conversations."""

    def legal_state(initials, audit, must_go, cut):
        state, cost, i = 0, 0, 0
        for e in audit:
            if e == "I":
                state, cost = turns.AFTER[state], cost + 2
                continue
            if i == len(initials) or (must_go[i] and e != "D"):
                return None
            if e == "D":
                cost += 3
            else:
                state = turns.STEP.get((state, initials[i])) if e == "K" else turns.AFTER[state]
                cost += (e == "R") * 2 + cut[i]
                if state is None:
                    return None
            i += 1
        return (cost, state) if i == len(initials) else None

    rng = np.random.default_rng(5)
    audits = ["".join(a) for n in range(8) for a in itertools.product("DIKR", repeat=n) if a.count("I") <= 3]
    for _ in range(12):
        n = int(rng.integers(0, 5))
        initials, must_go, cut = list(rng.choice(list("suat"), n)), rng.random(n) < 0.2, rng.random(n) < 0.3
        cut &= ~must_go
        entry_best = {}
        for a in audits:
            found = legal_state(initials, a, must_go, cut)
            if found:
                entry_best[found[1]] = min(entry_best.get(found[1], (99, "")), (found[0], a))
        got = turns.repair(initials, must_go.tolist(), cut.tolist())
        assert {s: got[s] for s in entry_best if entry_best[s][0] <= 9} == {s: w for s, w in entry_best.items() if w[0] <= 9}
        assert list(turns.repair(initials, must_go.tolist(), cut.tolist(), 0, turns.LEGAL_END).values()) == [min(w for s, w in got.items() if s in turns.LEGAL_END)]


def conversation_rows():
    rng = np.random.default_rng(9)
    said = ["Hello there.", "What now?", "no end", " \n\t", "", None, "Yes!\n ", "日本語。", "x" * 30_000 + "."]
    rows = [(int(c), int(t) if rng.random() > 0.05 else None, str(rng.choice(["user", "assistant", "system", "tool", "u", ""])) if rng.random() > 0.05 else None, said[int(rng.integers(0, len(said)))]) for c in range(60) for t in rng.integers(0, 12, int(rng.integers(1, 12)))]
    rows += [(500, t, ["user", "assistant"][t % 2], f"turn {t % 90}.") for t in range(700)]  # one long conversation
    rows += [(501, None, "user", "a."), (501, None, "user", "a."), (None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b")]
    rows += [rows[3], rows[3], rows[-1]]
    # of these every turn is dropped
    rows += [(c, 0, "user", "gone.") for c in range(600, 700) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows


def test_conversations(spark):
    rows = conversation_rows()
    extra = "kind digest piece summary first latest again chars told"
    df = spark.createDataFrame([(*r, *["clash"] * 9) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in extra.split())).repartition(5)
    want = plain_conversations(rows)
    for most in (turns.ROWS, 7):
        got = turns.repair_conversations(turns.damage(df), df, most)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert turns.repair_conversations(turns.damage(df.where("false")), df.where("false")).count() == 0


def test_conversations_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in turns.op13_conversations(spark, SF).collect()) == plain_conversations(rows)


def test_near_duplicates_compare_words():
    """Words whose polynomial hashes modulo 2 ** 64 are equal are still different words."""
    a, b = "ab", "ba"
    for _ in range(10):
        a, b = a + b, b + a
    tail = " one two three four five six"
    sets = near.shingle_sets([a + tail, b + tail, a + tail, "", "one two", "two one", "one two three four five"])
    assert set(sets[0]) == set(sets[2]) != set(sets[1]) and len(set(sets[0]) & set(sets[1])) == 2
    assert [len(s) for s in sets] == [3, 3, 3, 0, 1, 1, 1] and sets[6][0] in sets[0] and sets[4][0] != sets[5][0]
    h, row = near.shingles(*utf8(pa.array([a, b])))
    assert row.tolist() == [0, 1] and h[0] != h[1]


def test_shingle_sets_are_those_of_words():
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é", "9"], int(n))) for n in rng.integers(0, 14, 60)]
    plain = [{tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if (w := words_of(t)) else set() for t in texts]
    sets = near.shingle_sets(texts)
    for i, j in itertools.product(range(60), repeat=2):
        assert len(set(sets[i]) & set(sets[j])) == len(plain[i] & plain[j])


class Always:
    """A model that finds one e-mail address at fixed places of the text, whatever window they are in."""

    def __init__(self, margin, least, size):
        self.margin, self.least, self.size = margin, np.full(len(pii.KINDS), least), size

    def spans(self, x):
        out = {}
        for w in range(x.shape[1]):
            at = np.flatnonzero(x[:, w] == pii.classes("@")[0])
            if len(at):
                out[w] = [(max(0, int(at[0]) - self.size), 0, min(pii.WINDOW, int(at[-1]) + self.size), self.margin)]
        return out


def test_added_spans_do_not_depend_on_the_place_of_a_window():
    for size in (20, 300):
        for place in (300, 380, 399, 400, 401, 420, 700):
            text = "x" * place + "a" * size + "@" + "b.c" * (size // 3) + " " + "y" * 900
            assert pii.added_spans([text], Always(1.0, np.inf, size)) == [[]]
            assert pii.reconcile(pii.added_spans([text], Always(1.0, 2.0, size))[0], [], text) == []
        short = ["x" * place + " aaaa bbbb@cccc ffff" + "y" * 900 for place in range(370, 430)]
        found = [pii.reconcile(f, [], t) for f, t in zip(pii.added_spans(short, Always(1.0, 0.5, 5)), short)]
        assert {tuple((s - i, k, e - i) for s, k, e in f) for i, f in enumerate(found)} == {tuple((s, k, e) for s, k, e in found[0])} and found[0]
