"""Whole jobs without caps, and steps whose work grows with the input alone."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import assemble, dedup, fidelity, gates, tree
from corpusloom.sources import html, markdown, nodes as node_table, office


def star(labels):
    return [*labels, "root"], [len(labels)] * len(labels) + [-1]


def test_large_trees_are_compared(spark):
    a, b = star(["x"] * 6000), star(["x"] * 3000 + ["y"] + ["x"] * 2999)
    c = star([str(i) for i in range(6000)])
    d = star([str(i) if i not in (5, 2500, 5990) else "z" for i in range(6000)])
    df = spark.createDataFrame([(1, *a, *b), (2, *c, *d), (3, *a, *a)], "i int, a array<string>, p array<int>, b array<string>, q array<int>")
    found = {r[0]: r[1] for r in df.select("i", fidelity.structural_similarity("a", "p", "b", "q")).collect()}
    assert found == {1: 1 - 1 / 12002, 2: 1 - 3 / 12002, 3: 1.0}


def test_distance_by_a_plain_recursion():
    """Against the definition: delete, insert or match the last root of two forests."""
    from functools import cache

    def forest(labels, parents):
        kids = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                kids[p].append(i)
        node = lambda i: (labels[i], tuple(node(k) for k in kids[i]))
        return (node(len(labels) - 1),)

    @cache
    def plain(a, b):
        if not a and not b:
            return 0
        options = []
        if a:
            options.append(plain(a[:-1] + a[-1][1], b) + 1)
        if b:
            options.append(plain(a, b[:-1] + b[-1][1]) + 1)
        if a and b:
            options.append(plain(a[:-1], b[:-1]) + plain(a[-1][1], b[-1][1]) + (a[-1][0] != b[-1][0]))
        return min(options)

    r = random.Random(3)

    def some(n):
        kids = {i: [] for i in range(n)}
        for i in range(1, n):
            kids[r.randrange(i)].append(i)
        order, parent = [], {}

        def walk(i):
            for k in kids[i]:
                parent[k] = i
                walk(k)
            order.append(i)

        walk(0)
        at = {x: i for i, x in enumerate(order)}
        return [r.choice("ab") for _ in order], [at[parent[x]] if x in parent else -1 for x in order]

    for _ in range(150):
        a, b = some(r.randint(1, 9)), some(r.randint(1, 9))
        assert fidelity.tree_distance(*a, *b) == plain(forest(*a), forest(*b))


def test_long_sheets_are_read_whole():
    rows = "".join(f'<row><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 6002))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="u"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Type="u/worksheet" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    sheet = office.parse_xlsx(out.getvalue()).children[0]
    assert len(sheet.children[-1].children) == 6001 and "truncated" not in sheet.attrs


def test_documents_of_one_row_group_are_parsed_by_many_tasks(spark):
    docs = spark.createDataFrame([(i, "<p>x</p>" * 2000) for i in range(200)], "page_id long, html string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert html.read_html(docs).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_of_rows_does_not_matter(spark):
    texts = [(i, f"# H {i}\n\na **b** `c`\n\n- x\n- y\n\n  z\n\n| p | q |\n|---|---|\n| 1 | *2* |\n\n```\ncode\n```\n") for i in range(30)]
    nodes = markdown.read_markdown(spark.createDataFrame(texts, "doc_id long, text string"))
    mixed = nodes.repartition(7, "ord")
    rows = lambda df: sorted(map(repr, df.collect()))
    for step in (tree.text_content, tree.body_texts, tree.blocks_in_order, tree.inline_spans, tree.table_cells, fidelity.post_order, fidelity.features):
        assert rows(step(nodes)) == rows(step(mixed)) != []
    blocks = tree.blocks_in_order(nodes).where("doc_id = '0'").orderBy("ord").collect()
    assert [x["text"] for x in blocks] == ["H 0", "a b c", "x", "x", "yz", "y", "z", "p", "q", "1", "2", "code"]
    assert "Join" not in tree.blocks_in_order(nodes)._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_walked_as_they_are_parsed(spark):
    """One pass of Python, without ids, in as many tasks as were asked for, however small the notes."""
    given = [(i, f"# H {i}\n\na **b** `c`\n\n- x\n") for i in range(40)]
    nodes = markdown.read_markdown(spark.createDataFrame([*given, (None, "n"), (50, None)], "doc_id long, text string").coalesce(1))
    blocks = tree.blocks_in_order(nodes)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert blocks.select(F.spark_partition_id()).distinct().count() > 1
    kept = nodes.where("true")  # no longer straight from the reader
    assert tree.blocks_in_order(kept)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, tree.blocks_in_order(kept).collect()))
    assert blocks.count() == 161 and nodes.where("node_id is null").isEmpty()
    root = markdown.parse(given[0][1])
    assert node_table.rows("d", root, with_ids=False) == [(*r[:8], None, *r[9:]) for r in node_table.rows("d", root)]


def test_merging_many_restatements(spark):
    r = random.Random(5)
    given = [(r.choice("abc"), f"p{i:05d}", i % 3, f"t{i}", r.choice([None, f"r{i}"]), r.choice([0.1, 0.5, 0.9]), r.choice([0.2, 0.7])) for i in range(600)]
    units = spark.createDataFrame(given, "k string, path string, unit_order int, text string, rationale string, authority double, confidence double").withColumn("source", F.struct("path", "unit_order"))
    want = {}
    for k, path, order, text, why, auth, conf in sorted(given, key=lambda x: x[1:3]):
        if k not in want:
            want[k] = [path, text, why, auth, conf, 1, [(path, order)]]
            continue
        s = want[k]
        if auth > s[3] or auth == s[3] and conf > s[4]:
            s[1], s[2] = text, why if why is not None else s[2]
        else:
            s[2] = s[2] if s[2] is not None else why
        s[3], s[4], s[5] = max(s[3], auth), max(s[4], conf), s[5] + 1
        s[6].append((path, order))
    done = dedup.merge_restatements(units, ["k"], ["path", "unit_order"])
    got = {x["k"]: [x["path"], x["text"], x["rationale"], x["authority"], x["confidence"], x["n_units"], [tuple(s) for s in x["sources"]]] for x in done.collect()}
    assert got == want
    assert "array_distinct" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_spans_are_cut_from_blocks_of_the_file(spark):
    r = random.Random(7)
    text = "".join(r.choice("abcé—𝄞 \n") for _ in range(9000))
    spans = sorted({tuple(sorted((r.randrange(9000), r.randrange(9000)))) for _ in range(60)} | {(0, 9000), (31, 33), (32, 64)})
    spans = [(("f"), a, b) for a, b in spans if a < b]
    files = spark.createDataFrame([("f", text), ("g", "other")], "file string, text string")
    found = assemble.cuts(files, spark.createDataFrame(spans, "file string, start long, end long"), 32)
    assert {(x["start"], x["end"]): x["text"] for x in found.collect()} == {(a, b): text[a:b] for _, a, b in spans}


def test_every_word_of_a_stem_is_known():
    stems = {*T.SCOPE_WORDS, *map(T._stem_plain, T.SCOPE_WORDS), *T.UNITS}
    known = set(T._stemming_to(stems))
    ends = ("", "s", "es", "ies", "ing", "ed", "ings", "inges", "eds", "edes", "ses", "ingies", "ys")
    for s in stems:
        for w in {x + e for x in (s, s[:-1], s[:-2]) for e in ends}:
            assert (T._stem_plain(w) in stems) == (w in known), w


@pytest.mark.parametrize("grid", [3, 1024])
def test_sets_of_all_sizes_in_a_block(spark, monkeypatch, grid):
    monkeypatch.setattr(gates, "GRID", grid)
    r = random.Random(11)
    sets = {i: {f"w{r.randrange(40)}" for _ in range(r.choice((1, 2, 5, 20, 60)))} for i in range(60)}
    df = spark.createDataFrame([(i, i % 2, sorted(s)) for i, s in sets.items()], "doc_id long, block int, words array<string>")
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): round(share(a, b), 6) for a in sets for b in sets if a < b and a % 2 == b % 2 and share(a, b) >= 0.3}
    got = gates.similar_in_block(df, "block", "words", 0.3)
    assert {(x["a"], x["b"]): round(x["jaccard"], 6) for x in got.collect()} == want and got.count() == len(want)
