import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, _t string, n int, w string, token long, bucket int, h string, doc long, url string, html string, page_id long"


def texts(rng, n, words=400):
    """Invented texts with copies, near copies, shared passages and repeated lines."""
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [line(40) for _ in range(3)]
    out = []
    for i in range(n):
        body = [line(rng.randint(4, 30)) + "." for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            body.insert(rng.randint(0, len(body)), rng.choice(shared))
        if rng.random() < 0.2:
            body.append(body[0])
        text = "\n".join(body)
        if out and rng.random() < 0.35:
            old = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 3)):
                old[rng.randrange(len(old))] = rng.choice(vocab)
            text = " ".join(old)
        out.append(text)
    return out


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text): nulls, blanks, a very long text, repeated rows, ties."""
    rng = random.Random(11)
    rows = list(enumerate(texts(rng, 70)))
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "ein Wort\x00und é漢😀   noch\x1ceins"), (None, rows[3][1]), (None, None), (75, "long " * 40_000), (76, "x" * 50_000)]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows as a table with more columns than operators want, some named like columns they make."""
    full = [(k, t, [None, "en", "xx"][i % 3], None, None, "k", "t", 1, "w", 2, 3, "h", 4, None, t, k) for i, (k, t) in enumerate(messy_rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("1 = 0")
