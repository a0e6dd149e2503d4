import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, gone string, line string, n_removed long, part int"


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text) as a documents table, with more columns whose names clash with inner ones."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t), "k", "g", "l", 7, 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def corpus():
    """A small corpus of invented words with copies, near copies, shared lines and odd rows."""
    r = random.Random(5)
    words = ["".join(r.choice(["ka", "lo", "mi", "tu", "re", "so"]) for _ in range(r.randint(1, 3))) for _ in range(150)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = ["\n".join(line(r.randint(4, 25)) for _ in range(r.randint(1, 6))) for _ in range(40)]
    common = line(9)
    for i in range(0, 40, 4):
        docs[i] += "\n" + common
    near = []
    for i in range(0, 20, 2):
        w = docs[i].split(" ")
        w[len(w) // 2] = "zzz"
        near += [" ".join(w), docs[i]]
    odd = [None, "", "   ", "\n\n", "x", "x", "é ü\tß", "wort " * 3000]
    return list(enumerate(docs + near + odd)) + [(None, docs[0]), (None, None), (3, docs[3])]
