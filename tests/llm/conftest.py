import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, mark int, size int, block string, doc string, kept int, _id int, class_id int, rank int"
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def corpus_rows():
    """Small documents with copies, near copies, shared passages, runs and edge cases."""
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    passage, other = prose(rng, 70, stock), prose(rng, 55, stock)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(3, 220), stock)
        if i % 7 == 0:
            text = f"{text} {passage} {prose(rng, 20, stock)}"
        if i % 11 == 0:
            text = f"{other}\n{text}\t{other}"
        rows.append((i, text))
    base = prose(rng, 150, stock).split(" ")
    for i in range(60, 75):
        words = list(base)
        for _ in range(i - 60):
            words[rng.randrange(len(words))] = rng.choice(stock)
        rows.append((i, " ".join(words)))
    rows += [(75 + i, rows[i][1]) for i in range(5)]
    rows += [
        (80, None),
        (81, ""),
        (82, " \t\n "),
        (83, "uno"),
        (84, "ha " * 300),
        (85, "ha " * 180 + "and so on"),
        (86, "ab" * 400),
        (87, "ab" * 230 + "c"),
        (88, "1 2 3 !!"),
        (89, prose(rng, 6000, stock)),
        (90, "ünïcödé wörds ñandú €uro 漢字 \x1c odd blank"),
    ]
    return [(i, t, ["en", "es", None][i % 3], None if i % 10 == 9 else f"s{i % 4}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.createDataFrame(corpus_rows(), PLAIN)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, one id with several texts, and extra columns with clashing names."""
    rows = corpus_rows()
    rows += rows[:3] + [(3, "another text of the same id that has some words", "en", "s0", 5)]
    rows += [(None, "a text without id " * 20, "en", "s1", 1), (None, None, None, None, None)]
    wide = [(*r, "x", 1, 2, "y", "z", 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(wide, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark, corpus):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    items = [(0, " ".join(texts[5].split()[:20])), (1, "no such words anywhere in these documents at all"), (2, None), (3, ""), (4, "uno")]
    return spark.createDataFrame(items, "item_id long, text string")
