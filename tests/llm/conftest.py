from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone light north market garden winter letter paper silver window".split()

#: Nulls, empty and blank texts, one that is long, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "A bé c 中文 \U0001f600"), (6, "A bé c 中文 \U0001f600"),
    (None, "no id at all"), (None, "no id at all"), (7, "é" * 3000), (8, "12 34 !! ??"), (9, "x " * 4000),
]


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Odd rows, copies, near copies and shared passages."""
    base = [passage(i, 120) for i in range(6)]
    shared = passage(99, 70)
    out = list(ODD)
    for i, text in enumerate(base):
        out += [(20 + i, text), (40 + i, text), (60 + i, text.replace(" ", "  ", 3) + " tail" * (i % 2)), (80 + i, f"{passage(200 + i, 40)} {shared} {passage(300 + i, 30)}")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """documents with columns whose names clash with inner ones."""
    extra = [(i, t, "en" if k % 3 else None, "s", len(t or ""), 1, 2, 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, fp long, key int, score int").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
