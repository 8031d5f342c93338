"""Every operator on awkward rows against a plain version, and on an empty table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, duck, rows
from tremolo.llm import decontam, langid, lines, media, mixing, near, pii, quality, suffix, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(got, want, columns):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, ([r[c] for c in columns] for r in got))) == sorted(map(key, want))


def test_media(docs, empty):
    def plain(k, t):
        b = (t or "").encode()
        p = b + b" " * ((-len(b)) % 192 if b else 192)
        return k, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])

    got = media.read_media(*media.store(docs), with_payload=True).collect()
    same(got, [plain(k, t) for k, t in collected(docs)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"])
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_sha256"] for r in got)
    assert media.read_media(*media.store(empty)).count() == 0


def test_media_cuts_follow_content():
    a = np.frombuffer(bytes(np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8)), np.uint8)
    b = np.concatenate([a[:1000], [7], a[1000:]]).astype(np.uint8)

    def parts(x):
        ends = media.cuts(x, np.array([0, len(x)]))[0].tolist()
        return {x[s:e].tobytes() for s, e in zip([0, *ends], ends)}

    assert len(parts(a) & parts(b)) > 0.9 * len(parts(a))


def test_pii(docs, empty):
    rx = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]

    def plain(t):
        return sorted((m.start(), k, m.end()) for k in range(4) for m in re.finditer(rx[k], t) if ok[k](m.group()))

    rng = np.random.default_rng(4)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab.@%-_+1234 9()é\n"), rng.integers(0, 30)))
        assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("1" * 20_000) == [] and pii.base_spans("a" * 100_000) == []
    model = pii.calibrate(pii.train(*pii.labelled_windows(["the of and to in that it was for on"]), steps=120), *pii.labelled_windows(["the of and to in"], seed=3))
    got = pii.find(docs, model).collect()
    for r, (k, t) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["base_sha256"])), sorted(collected(docs), key=lambda x: (str(x[0]), hashlib.sha256(pii._joined(plain(x[1] or "")).encode()).hexdigest()))):
        assert r["base_sha256"] == hashlib.sha256(pii._joined(plain(t or "")).encode()).hexdigest()
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain(t or "")} <= set(r["spans"].split(","))
    assert pii.find(empty, model).count() == 0


def held_out_spans(texts, n, seed):
    """Texts with one generated span or look-alike (None) each, of another seed than any training window."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        t = texts[int(rng.integers(0, len(texts)))]
        a = int(rng.integers(0, max(1, len(t) - 600)))
        piece = t[a : a + 600]
        gaps = [m.start() for m in re.finditer(r"\s", piece)]
        if pii.base_spans(piece) or not gaps:
            continue
        made, kind = pii._made(rng)
        g = gaps[int(rng.integers(0, len(gaps)))]
        out.append((piece[:g] + " " + made + " " + piece[g:].lstrip(), (g + 1, kind - 1, g + 1 + len(made)) if kind else None))
    return out


def test_pii_precision_and_recall_of_added_spans():
    texts = sorted(r[0] for r in duck("select text from documents where length(text) > 300 order by doc_id").itertuples(index=False))
    fit, other = texts[::2], texts[1::2]
    model = pii.calibrate(pii.train(*pii.labelled_windows(fit)), *pii.labelled_windows(fit, seed=12))
    found, right, gold = collections.Counter(), collections.Counter(), collections.Counter()
    held = held_out_spans(other, 800, 99)
    for (t, want), spans in zip(held, pii.added_spans([t for t, _ in held], model)):
        if want:
            gold[want[1]] += 1
        hit = False
        for s, k, e in pii.reconcile(spans, [], t):
            found[k] += 1
            ok = bool(want) and k == want[1] and 2 * (min(e, want[2]) - max(s, want[0])) > want[2] - want[0]
            right[k] += ok and not hit
            hit |= ok
    figures = {pii.KINDS[k]: (round(right[k] / max(1, found[k]), 2), round(right[k] / gold[k], 2)) for k in range(4)}
    print(figures)
    assert all(p >= 0.85 and r >= 0.6 for p, r in figures.values()), figures


def test_pii_reconcile():
    assert pii.reconcile([(0, 0, 9, True), (0, 0, 12, False)], []) == [(0, 0, 12)]
    assert pii.reconcile([(5, 2, 20, False)], [(10, 3, 22)]) == [(10, 3, 22)]
    assert pii.reconcile([(5, 2, 9, True)], []) == [(5, 2, 9)]


def test_pii_spans_across_windows():
    mail = "someone.with.a.very.long.name (at) quite-a-long-mail-host (dot) example (dot) org"[:80]
    assert 64 < len(mail) <= 80

    class Known(pii.Model):
        def __init__(self):
            self.trans, self.least = np.zeros((pii.TAGS, pii.TAGS)), np.zeros(len(pii.KINDS))

        def decode(self, x, with_emissions=False):
            starts = pii.windows_of(np.array([len(text)]))[1]
            tags = {w: np.array([int(at <= s0 + i < at + len(mail)) for i in range(pii.WINDOW)]) for w, s0 in enumerate(starts.tolist())}
            return {w: (t, np.zeros((pii.WINDOW, pii.TAGS))) for w, t in tags.items() if t.any()}

    for at in range(360, 520, 3):
        text = ("word " * 200)[: at - 1] + " " + mail + " " + "word " * 200
        assert pii.reconcile(pii.added_spans([text], Known())[0], [], text) == [(at, 0, at + len(mail))]
    text = "x " * 220 + mail + " and"
    assert pii.reconcile([(440, 0, 512, True), (448, 0, 440 + len(mail), True)], [], text) == [(440, 0, 440 + len(mail))]


def test_pii_viterbi_prune():
    rng = np.random.default_rng(2)
    model = pii.Model(pii.Lstm(rng), pii.Lstm(rng), rng.normal(0, 1, (5, 16)).astype("f4"), np.array([3, 0, 0, 0, 0], "f4"), rng.normal(0, 0.5, (5, 5)))
    x = rng.integers(0, pii.CLASSES, (40, 64))
    full = model.viterbi(model.emissions(x))
    found = model.decode(x)
    assert all((full[:, w] == found.get(w, np.zeros(40))).all() for w in range(64))


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "jumps over lazy dog and runs away"), (2, None), (3, ""), (4, "short"), (5, " ".join(words_of(collected(docs)[0][1] or "the quick brown")[:30])), (6, "short")], "item_id int, text string")

    def plain(t):
        w, hit, found = words_of(t), set(), set()
        for i, x in ((r["item_id"], words_of(r["text"])) for r in items.collect()):
            n = min(10, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        return len(w), len(hit), sorted(found), bool(hit)

    got = decontam.contamination(docs, items).collect()
    same(got, [(k, *plain(t)) for k, t in collected(docs)], ["doc_id", "n_words", "n_hit", "items", "contaminated"])
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(docs, items.where("false")).where("contaminated").count() == 0


@pytest.mark.parametrize("length, limit", [(200, suffix.LIMIT), (200, 1), (200, 3), (116, 2), (131, suffix.LIMIT), (400, 2)])
def test_suffix(spark, docs, empty, length, limit):
    """Against all strings of the texts; small limits send groups through runs of distances and single strings."""
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(rng.choice(list("abc de\u00e9"), n))
    shared, period = letters(700), letters(9) * 90
    made = [letters(rng.integers(0, 300)) + shared[a : a + n] + letters(rng.integers(0, 300)) for a, n in zip(rng.integers(0, 300, 24), rng.integers(100, 500, 24))]
    made += [period, period[3:] + "x", shared, shared[:-1] + "\0", shared[:-1], "\0" * 450, letters(20) + "\0" * 420, letters(300) * 2]
    data = collected(docs) + [(1000 + i, t) for i, t in enumerate(made)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    seen = collections.Counter((t or "").encode()[i : i + length] for _, t in data for i in range(len((t or "").encode()) - length + 1))

    def plain(k, t):
        b = (t or "").encode()
        gone = np.zeros(len(b) + length, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        return k, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()

    got = [{**r.asDict(), "n": len(r["spans"])} for r in suffix.removed_spans(table, length=length, limit=limit).collect()]
    same(got, [plain(k, t) for k, t in data], ["doc_id", "n_bytes", "n_removed", "n", "kept_sha256"])
    if length == 200:
        assert suffix.removed_spans(docs, limit=limit).count() == docs.count()
        assert suffix.removed_spans(empty, limit=limit).count() == 0


def test_language(spark, docs, empty):
    sf = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(sf)
    got = langid.identify(sf.select("doc_id", "text", "lang"), model).toPandas().merge(duck("select doc_id, lang from documents"), on="doc_id")
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    edge = langid.identify(docs, model).collect()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for r, (_, t) in zip(sorted(edge, key=lambda r: str(r["doc_id"])), sorted(collected(docs), key=lambda x: str(x[0]))) if r["doc_id"] != 0)
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]



def test_language_of_calibration_rows_only(spark):
    fourth = spark.range(60).where("pmod(xxhash64('langid-fold', id), 4) = 0").first()[0]
    data = [(i, "the cat sat on the mat and looked at the dog", "en") if i % 2 else (i, "der hund lief durch den wald und sah die katze", "de") for i in range(60) if i != fourth]
    data.append((fourth, "kissa istui matolla ja katsoi koiraa", "fi"))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert sorted(model.langs) == ["de", "en", "fi"]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()} == {k: x for k, _, x in data}
    assert langid.fit(df.where(f"doc_id = {fourth}")).langs == ["fi"]


def test_band():
    rng = np.random.default_rng(3)
    for e in (1, 2, 3):
        pairs = []
        while len(pairs) < 400:
            a = rng.integers(97, 101, rng.integers(2 * e + 2, 25)).tolist()
            b = list(a)
            for _ in range(rng.integers(0, 5)):
                b.insert(rng.integers(0, len(b)), 98) if rng.random() < 0.5 else b.pop(rng.integers(0, len(b)))
            a, b = sorted((a, b), key=len)
            if len(b) - len(a) <= e:
                pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
        got = lines.Band(e).within(*map(list, zip(*pairs)))
        assert got.tolist() == [distance(a.tolist(), b.tolist()) <= e for a, b in pairs]


@pytest.mark.parametrize("per_edit, block", [(lines.PER_EDIT, lines.BLOCK), (lines.PER_EDIT, 2), (2, 3), (8, 3)])
def test_lines(spark, docs, empty, per_edit, block):
    """Against all pairs of lines of 1 to 30 characters and more."""
    rng = np.random.default_rng(per_edit)
    letters = lambda n: "".join(rng.choice(list("abé日"), n))
    made = []
    for _ in range(90):
        x = list(letters(rng.integers(1, 31)))
        made.append("".join(x))
        for _ in range(rng.integers(0, 4)):
            x.insert(rng.integers(0, len(x) + 1), "z") if rng.random() < 0.5 else x.pop(rng.integers(0, len(x))) if x else None
            made.append("".join(x))
    same_start = ["the same words start here " + letters(5) for _ in range(12)]
    rows_ = collected(docs) + [(2000 + i, "\n".join(made[i : i + 30] + same_start[i % 12 : i % 12 + 2])) for i in range(0, len(made), 30)]
    table = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    data = [x for _, t in rows_ for x in (t or "").split("\n")]
    every = set(data)
    tolerated = lambda a, b: min(lines.EDITS, min(len(a), len(b)) // per_edit)
    some = [x for x in every if 0 < len(x) < 5000]
    link = {(a, b) for a in some for b in some if a < b and abs(len(a) - len(b)) <= tolerated(a, b) and distance(a, b) <= tolerated(a, b)}
    assert link
    degree = collections.Counter(x for p in link for x in p)
    found = lines.duplicate_lines(table, per_edit=per_edit, block=block).collect()
    got = {r["doc_id"]: r for r in found}
    for k, t in rows_[-3:]:
        assert got[k]["n_links"] == sum(degree[x] for x in t.split("\n"))
    assert sum(r["n_links"] for r in found) == sum(degree[x] for x in data)
    parent = {x: x for x in every}
    for a, b in link:
        ra, rb = a, b
        while parent[ra] != ra:
            ra = parent[ra]
        while parent[rb] != rb:
            rb = parent[rb]
        parent[ra] = rb
    top = lambda x: x if parent[x] == x else top(parent[x])
    filled = [top(x) for x in data if x]
    removed = sum(len(r["removed"]) for r in found)
    assert removed == len(filled) - len(set(filled))
    assert lines.duplicate_lines(empty).count() == 0


def test_lines_of_equal_polynomial_hashes(spark):
    """A Thue-Morse word of 1024 letters and its complement are two lines, far from each other."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    got = {r["doc_id"]: (r["removed"], r["n_links"]) for r in lines.duplicate_lines(spark.createDataFrame([(1, word + "\n" + other), (2, other), (3, word + "x")], "doc_id long, text string")).collect()}
    assert got == {1: ([], 1), 2: ([0], 0), 3: ([0], 1)}


def test_mixing(spark, docs, empty):
    got = mixing.mix_counts(docs).toPandas()
    assert len(got) == docs.count() and got.copies.between(0, 2).all()
    taken = (got["size"] * got.copies).groupby(got.source.fillna("~")).sum()
    target = got.groupby(got.source.fillna("~")).target.first()
    assert ((target - taken).abs() <= got["size"].max() / 2).all()
    assert mixing.mix(docs).count() == got.copies.sum() and mixing.mix(docs).columns == docs.columns
    assert mixing.mix_counts(empty).count() == 0
    two = spark.createDataFrame([(1, "word " * 100, "a"), (2, "word " * 90, "b")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.target, r.copies) for r in mixing.mix_counts(two, weights=(1, 1)).collect()} == {1: (142.5, 1), 2: (142.5, 2)}
    assert rows(mixing.op7_mixing(spark, SF).toPandas()) == rows(duck(mixing.ORACLE_SQL))


def test_decontamination_sql(spark):
    assert rows(decontam.op3_decontamination(spark, SF).toPandas()) == rows(duck(decontam.ORACLE_SQL))


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_tokenizer())
    data = sorted(collected(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, at = [], 0
    for k, t in data:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes()), int(ids[0]), 0))
        at += len(ids)
    same(tokens.token_table(docs, block_tokens=500).collect(), want, ["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "last_id"])
    assert tokens.token_table(empty).count() == 0


def test_added_tokens_of_any_form(tmp_path):
    import json

    from tokenizers import AddedToken, Tokenizer

    model = Tokenizer.from_file(tokens.default_tokenizer())
    model.add_tokens([AddedToken("[MARK]"), AddedToken("two words")])
    model.save(f"{tmp_path}/t.json")
    assert "[MARK]" in json.dumps(json.load(open(f"{tmp_path}/t.json"))["added_tokens"])
    texts = ["a [MARK] b", "some two words here", "plain text, 12 numbers", "It's\n\n  done", "<|endoftext|> x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(f"{tmp_path}/t.json")(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_clashing_columns_and_null_ids(spark, docs, tmp_path):
    """Stages keep every column of any name and its values; remainders are never null."""
    names = ["__row", "__copies", "__source", "__copy", "__h", "row", "number", "hash", "d", "r", "c0", "whole", "threshold"]
    some = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    items = spark.createDataFrame([(1, "jumps over lazy dog and runs away")], "item_id int, text string")
    key = lambda d: sorted(map(str, d.collect()))
    every = key(some)
    clean = key(decontam.keep_clean(some, items))
    mixed = key(mixing.mix(some))
    assert 0 < len(clean) <= len(every) and set(clean) <= set(every) and set(mixed) <= set(every)
    assert decontam.keep_clean(some, items).dtypes == some.dtypes == mixing.mix(some).dtypes
    assert set(key(near.keep_first(some))) <= set(every)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (langid.op5_language, quality.op10_quality):
        got = {r["doc_id"]: r["held_out"] for r in query(spark, str(tmp_path)).collect()}
        assert got[None] is False and None not in got.values()


def test_dac():
    v = np.random.default_rng(1).integers(0, 1 << 20, 3000)
    v[::3] &= 255
    coded = tokens.dac_encode(v)
    assert (tokens.dac_decode(*coded[:2]) == v).all() and all(tokens.access(*coded, i) == v[i] for i in range(0, 3000, 7))
    assert len(tokens.dac_decode(*tokens.dac_encode(np.zeros(0, np.uint32))[:2])) == 0


@pytest.mark.parametrize("block", [near.BLOCK, 2, 3])
def test_near(spark, docs, empty, block):
    rng = np.random.default_rng(12)
    base = [f"word{i}" for i in range(60)]
    near_copies = []
    for _ in range(30):
        x = list(base)
        for _ in range(rng.integers(0, 3)):
            x[rng.integers(0, 60)] = "other"
        near_copies.append(" ".join(x))
    docs = docs.unionByName(spark.createDataFrame([(3000 + i, t) for i, t in enumerate(near_copies)], "doc_id long, text string"), allowMissingColumns=True)
    data = collected(docs)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words_of(t)) else None for _, t in data]
    distinct = list({s for s in sets if s})
    link = {(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and 5 * len(a & b) >= 4 * len(a | b)}
    group = list(range(len(distinct)))
    for i, j in link:
        group = [group[i] if g == group[j] else g for g in group]
    where = {s: g for s, g in zip(distinct, group)}
    size = collections.Counter(where[s] for s in sets if s)
    degree = collections.Counter(x for p in link for x in p)
    want = [(k, degree[distinct.index(s)] if s else 0, size[where[s]] if s else 1) for (k, _), s in zip(data, sets)]
    same(near.near_classes(docs, block=block).collect(), want, ["doc_id", "n_links", "class_size"])
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(where.values())) + sum(s is None for s in sets)
    assert near.near_classes(empty).count() == 0


def test_near_links_count_different_texts(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [a, a, a.upper(), a + "!", a + " more", a + " MORE", "", ""]
    got = {r["doc_id"]: (r["n_links"], r["n_copies"], r["class_size"]) for r in near.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (4, 4 if i < 4 else 2, 6) for i in range(6)} | {6: (0, 1, 1), 7: (0, 1, 1)}


def test_near_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_quality(spark, docs, empty):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op10_quality(spark, SF).toPandas().merge(duck("select doc_id, quality from labels where quality is not null"), on="doc_id")
    assert (got.predicted == got.quality)[got.held_out].mean() > 0.9 and got.score.between(0, 1).all()
    model = quality.fit(d, labels)
    assert quality.score_documents(docs, model, with_lines=True).count() == docs.count()
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score_documents(empty, model).count() == 0
    assert quality.fit(d, labels.where("false")) is None
    assert {r["score"] for r in quality.score_documents(docs, None).collect()} == {0.5}


def test_crf_marginals():
    rng = np.random.default_rng(5)
    score, counts, trans = rng.normal(0, 2, 6), np.array([4, 2]), rng.normal(0, 1, (2, 2))
    p, _, z = quality.marginals(score, counts, trans)
    at, total = 0, 0.0
    for n in counts:
        weight = {}
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            weight[code] = np.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
        all_ = sum(weight.values())
        total += np.log(all_)
        for i in range(n):
            assert abs(p[at + i] - sum(w for c, w in weight.items() if c >> i & 1) / all_) < 1e-9
        at += n
    assert abs(z - total) < 1e-9
