"""Lines against benchmark items, by brute-force edit distance."""

import re

from corpusloom import catalog


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def grams(text):
    ws = re.findall("[a-z0-9]+", text.lower())
    return {tuple(ws[i : i + 6]) for i in range(len(ws) - 5)}


def test_lines_that_are_not_ascii_have_rows(spark, tmp_path):
    docs = [
        (1, "Plain words one two three four five six seven\n\nnothing of the kind"),
        (2, "Häuser – one two three four five six “seven”\nDéjà vu, the cat sat on the mat again, naïve 😀"),
        (3, "the cat sat on the mat again, naive"),
        (4, None),
    ]
    items = [(10, "plain words one two three four five six seven"), (11, "Déjà vu, the cat sat on the mat again, naïve"), (12, "été\none two three four five six")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lines = [(d, n, x) for d, t in docs if t for n, x in enumerate(t.split("\n")) if x.strip()]
    expected = sorted((d, n, i, round(1 - distance(x, t) / max(len(x), len(t)), 6)) for d, n, x in lines for i, t in items if grams(x) & grams(t))
    df = catalog.QUERIES["q35_text_similarity"](spark, str(tmp_path))
    got = sorted((r["doc_id"], r["line_no"], r["item_id"], r["similarity"]) for r in df.collect())
    assert got == expected and {x[:3] for x in got} >= {(2, 0, 10), (2, 1, 11), (3, 0, 11), (1, 0, 12)}
