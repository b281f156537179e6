import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 long, kept string, key long"


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and clashing column names."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = say(120), say(60)
    texts = [say(r.randint(1, 200)) for _ in range(30)]
    texts += [base] * 5
    for _ in range(12):
        w = base.split()
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += [f"{say(20)} {passage} {say(15)}" for _ in range(6)]
    texts += [passage[:230] + say(5), say(3) + passage[40:260], "Whan " * 200, "ab" * 400, say(9000), "", None, "   \t\n ", "x", "one two three", "Ünïcödé " * 60, "Ünïcödé " * 61]
    rows = [(i, t, "en", ["s1", "s2", None, "s3"][i % 4], len(t or ""), i, "x", i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
