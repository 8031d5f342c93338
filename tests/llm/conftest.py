import pytest

WORDS = "the quick brown fox jumps over lazy dog and runs away from here into deep dark green woods near river".split()


def text(n, seed=0):
    return " ".join(WORDS[(i * i + seed * i + seed) % len(WORDS)] + (str(i % 7) if i % 5 == seed % 5 else "") for i in range(n))


BASE = text(120, 3)
TEXTS = [
    BASE, BASE, BASE.replace("fox", "cat", 1), None, "", " \n\t ", "...!?", "one", "short text here", text(400, 5), text(400, 5) + " end",
    "Line number one is long enough to matter\nline two\n\nLine number one is long enough to mattre\n", "Line number one is long enough to matter\n", "日本語 テキスト é ü\n" * 3,
    "mail a.b@example.com ip 10.0.0.1 card 4111 1111 1111 1111 phone +1 (555) 123-4567", "aaaa" * 200, text(9000, 7), "x" * 50_000, text(60, 1).upper() + "!!", "[email protected]\r\nword\x00word",
]
EXTRA = "uid row core block class task key score n h1 sig hash threshold whole copies nodes segs part lens __row"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties and repeated rows, null ids, and extra columns of clashing names."""
    data = [(i if i != 8 else None, t, ["en", "de", None][i % 3], ["a", "a", "a", None, "b"][i % 5], len(t or "")) for i, t in enumerate(TEXTS)]
    data.append(data[0])
    names = EXTRA.split()
    return spark.createDataFrame([(*d, *["clash"] * len(names)) for d in data], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
