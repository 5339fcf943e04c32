from __future__ import annotations

import random

import pytest

#: Columns that clash with names the operators use inside.
EXTRA = "doc long, n long, label string, key string, spots string, part int, words string, digest string, runs int, score double"


def rows_of(texts, first: int = 0):
    return [(first + i, t, "en", "src0", len(t or ""), 1, 2, "l", "k", "s", 3, "w", "d", 4, 0.5) for i, t in enumerate(texts)]


SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def vocabulary(n: int = 400, seed: int = 7):
    r = random.Random(seed)
    return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]


def prose(r: random.Random, words, n: int) -> str:
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, empty, null, long, repeated and odd ones."""
    r = random.Random(3)
    words = vocabulary()
    base = [prose(r, words, r.randint(1, 120)) for _ in range(60)]
    passage = prose(r, words, 60)
    near = prose(r, words, 200)
    tokens = near.split()
    copies = []
    for i in range(12):
        t = list(tokens)
        t[(i * 37) % 200] = f"edit{i}"
        copies.append(" ".join(t))
    return [
        *base, None, "", " \n\t", base[3], base[3], base[5] + " " + passage, passage + " tail", "É" * 70, "É" * 70 + "x",
        near, *copies, "a b " * 300, "a b " * 301, prose(r, words, 20000), "one", "one", "one two three four five six seven eight nine ten eleven twelve",
    ]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(rows_of(corpus), SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
