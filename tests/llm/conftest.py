import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def invent(seed=3, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, personal data, long and empty ones."""
    r = random.Random(seed)
    words = ["the", "of", "and", "to", "in"] + ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(300)]
    prose = lambda k: [r.choice(words) for _ in range(k)]
    passage, line = " ".join(prose(60)), " ".join(prose(10))
    out = [("", "src0"), (None, "src1"), ("Hello", None), ("one two\tthree\nfour five six", "src0"), ("a " * 400, "src0")]
    base = prose(120)
    for i in range(n):
        text = prose(r.randint(5, 90))
        if i % 5 == 0:
            text = list(base)
            for _ in range(i // 8):
                text[r.randrange(120)] = "edit" + str(r.random())[2:6]
        body = " ".join(text)
        if i % 4 == 1:
            body = body[: len(body) // 2] + " " + passage + " " + body[len(body) // 2 :]
        if i % 3 == 0:
            body += "\n" + line + "\n\n" + "Ünï " + body[:20]
        if i % 6 == 0:
            body += "\nmail a.b+c@x-y.example.com or 10.0.300.1 10.2.3.4 4111 1111 1111 1111 +1 (555) 123-4567"
        out.append((body, f"src{i % 3}"))
    out.append((out[10][0], "src0"))
    return [(i * 3 - 9, t, "en", s, len(t or "")) for i, (t, s) in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    got = invent()
    return [*got, got[12], (None, "null id " * 6, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with columns named like what operators make inside."""
    from pyspark.sql import functions as F

    names = ["k", "h", "t", "u", "ws", "x", "class", "size", "rid", "ids", "n", "root", "bucket", "runs", "row", "items", "spans", "start", "n_lines", "n_removed", "n_words", "at", "a", "b", "_score2"]
    return docs.withColumns({c: F.lit(f"own {c}") for c in names})
