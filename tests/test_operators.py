"""Operators on small tables, with results worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import budget, classify, conflicts, dedup, diagnostics, extract, fidelity, gates, infer, lines, manifest, slugs, verify


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


UNIT = "doc_id int, k string, ord int, text string, rationale string, authority double, confidence double, source string"


def test_merging_is_a_fold(spark):
    rows = [(1, "k", 1, "first", None, 0.5, 0.9, "p1"), (2, "k", 2, "second", "why", 0.8, 0.3, "p2"), (3, "k", 3, "third", None, 0.8, 0.5, "p1")]
    for n in (1, 5):
        df = spark.createDataFrame(rows, UNIT).repartition(n)
        assert got(dedup.merge_restatements(df, ["k"], ["ord"]), "ord", "text", "rationale", "authority", "confidence", "n_units", "sources") == [(1, "second", "why", 0.8, 0.9, 3, ["p1", "p2"])]
    counts = dedup.restatement_counts(spark.createDataFrame(rows, UNIT), ["k"], ["doc_id", "ord"]).first()
    assert (counts["first"]["doc_id"], counts["n_units"], counts["authority"], counts["n_sources"]) == (1, 3, 0.8, 3)


def test_streamed_fold_is_the_fold(spark):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), i, f"t{i}", None, r.randint(0, 3) / 4, r.randint(0, 3) / 4, "p") for i in range(60)] + [(60, "c", 1, None, None, 0.5, 0.5, "p")]
    df = spark.createDataFrame(rows, UNIT).repartition(5)
    whole = dedup.merge_restatements(df, ["k"], ["ord"])
    streamed = dedup.fold_restatements(df, ["k"], ["ord"])
    columns = ["k", "ord", "text", "authority", "confidence"]
    assert got(streamed, *columns) == got(whole, *columns) and got(streamed, "k", "n_units") == got(whole, "k", "n_units")
    assert dedup.fold_restatements(df.limit(0), ["k"], ["ord"]).count() == 0


def test_budget_fill_is_not_a_running_sum(spark):
    rows = [("g", "s", None, t, v) for t, v in ((6, 3.0), (7, 2.0), (4, 1.0))] + [("h", "s", 1, 2, 2.0), ("h", "s", 1, 2, 1.0), ("h", None, None, 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, section string, max_units int, tokens long, value double").repartition(3)
    out = budget.fill(df, "g", [F.desc("value")], 10, 0)
    assert got(out, "g", "tokens", "place") == [("g", 4, "primary"), ("g", 6, "primary"), ("g", 7, "dropped"), ("h", 1, "unrouted"), ("h", 2, "dropped"), ("h", 2, "primary")]
    assert ("g", 7, "secondary") in got(budget.fill(df, "g", [F.desc("value")], 10, 8), "g", "tokens", "place")
    assert ("g", 7, "dropped") in got(budget.fill(df, "g", [F.desc("value")], 10, 8, "truncateLowestValue"), "g", "tokens", "place")
    with pytest.raises(Exception, match="exceeds its budget"):
        budget.fill(df, "g", [F.desc("value")], 10, 8, "fail").collect()
    with pytest.raises(ValueError):
        budget.fill(df, "g", [], 1, 1, "other")


def test_routing_takes_the_first_section(spark):
    sections = spark.createDataFrame([("a", 0, ["x", "y"], 1.0, None), ("b", 1, ["y", "z"], 2.0, 3)], budget.SECTIONS)
    units = spark.createDataFrame([("u1", "y"), ("u2", "z"), ("u3", "q")], "unit_id string, category string")
    assert got(budget.route(units, sections), "unit_id", "section", "weight") == [("u1", "a", 1.0), ("u2", "b", 2.0), ("u3", None, None)]


def test_absorption(spark):
    pairs = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 20, 30), (1, 3, 10, 40), (2, 1, 10, 20)], "category_a long, rank int, a long, b long")
    assert got(dedup.absorb(pairs)) == [(1, 10, 20, 10), (1, 10, 40, 10), (2, 10, 20, 10)]
    chain = spark.createDataFrame([("x", 1, "b", "c"), ("x", 2, "a", "b"), ("x", 3, "d", "c")], "category_a string, rank int, a string, b string")
    assert got(dedup.absorb(chain)) == [("x", "a", "b", "a"), ("x", "b", "c", "a")]  # c is held by a in the end
    units = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "unit_id string, text string")
    decisions = spark.createDataFrame([("a", "b", "better")], "kept string, absorbed string, surviving_text string")
    assert got(dedup.resolve_merges(units, decisions)) == [("a", "better"), ("c", "z")]


def test_similar_pairs(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.05], 1), (5, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [r[2:4] for r in got(dedup.similar_pairs(df, 0.9))] == [(1, 2)]
    assert [r[2:4] for r in got(dedup.similar_pairs(df, 0.9, across=True))] == [(1, 4), (2, 4)]
    old = dedup.BLOCK
    dedup.BLOCK = 2
    try:
        assert [r[2:4] for r in got(dedup.similar_pairs(df, 0.9, across=True))] == [(1, 4), (2, 4)]
    finally:
        dedup.BLOCK = old


def test_similar_pairs_of_odd_vectors_and_text_categories(spark):
    rows = [("a", [1.0, 0.0], "x"), ("b", [0.9, 0.1], "x"), ("c", None, "x"), ("d", [1.0], "x"), ("e", [None, 1.0], "x"), ("f", [1.0, 0.0], None), (None, [1.0, 0.0], "x"), ("g", [1.0, 0.0], "y"), ("h", [float("nan"), 0.0], "x"), ("i", [], "y")]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string")
    assert [r[:4] for r in got(dedup.similar_pairs(df, 0.9))] == [("x", "x", "a", "b")]
    across = dedup.similar_pairs(df, 0.9, across=True)
    assert [r[:4] for r in got(across)] == [("x", "y", "a", "g"), ("x", "y", "b", "g")] and got(dedup.top_across(across, 1), "a", "b") == [("a", "g")]
    assert dedup.similar_pairs(df.limit(0), 0.9).count() == 0 and dedup.similar_pairs(df.limit(0), 0.9, across=True).count() == 0
    assert got(dedup.absorb(dedup.capped_pairs(dedup.similar_pairs(df, 0.9)))) == [("x", "a", "b", "a")]


def test_units_without_tokens_cost_nothing(spark):
    df = spark.createDataFrame([("g", "s", None, None, 2.0), ("g", "s", None, 5, 1.0)], "g string, section string, max_units int, tokens long, value double")
    assert got(budget.fill(df, "g", [F.desc("value")], 5, 0), "tokens", "place") == [(5, "primary"), (None, "primary")]


def plain_grams(text, n, stop=()):
    w = [x for x in re.findall("[a-z0-9]+", text.lower()) if x not in stop]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("small_side", [2_000_000, 0])
def test_shared_ngrams_against_sets(spark, monkeypatch, small_side):
    monkeypatch.setattr(gates, "SMALL_SIDE", small_side)
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["the", "Cat", "sat", "é1", "on-a", "MAT.", "x9"]) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "cat " * 5000)]
    items = [(i, text(r.randint(3, 12))) for i in range(12)] + [(50, None), (51, "cat cat cat cat")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for n, stop in ((3, ()), (2, ("the", "on"))):
        want = sorted((a, b, len(g)) for a, x in docs for b, y in items if x and y and (g := plain_grams(x, n, stop) & plain_grams(y, n, stop)))
        assert want and got(gates.shared_ngrams(d, i, n, stop)) == sorted(want, key=repr)
    sets = lambda t: set(re.findall("[a-z0-9]+", t.lower())) - {"the"}
    want = [(a, b) for a, x in docs for b, y in items if x and y and len(sets(y)) >= 4 and sets(y) <= sets(x)]
    assert want and got(gates.signature_subsets(d, i, ("the",))) == sorted(want, key=repr)


def test_list_overlap(spark):
    rows = [(1, ["a", "a", "b"], ["a", "b", "b", "c"]), (2, ["x"], ["y"]), (3, [], ["y"])]
    out = gates.list_overlap(spark.createDataFrame(rows, "id int, e array<string>, a array<string>"), ["id"], "e", "a")
    assert [(r[0], *r[1:]) for r in got(out, "id", "matched", "precision", "recall")] == [(1, 2, 0.5, 2 / 3), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_conflict_triage(spark):
    rows = [("u1", "port", "80", "a.md"), ("u2", "port", "90", "b.md"), ("u3", "host", "x", "a.md"), ("u4", "host", "y", "a.md"), ("u5", "user", "me", "a.md"), ("u6", "user", "me", "b.md"), ("u7", "key", None, "a.md")]
    df = spark.createDataFrame(rows, "unit_id string, entity string, value string, path string")
    groups = conflicts.entity_groups(df, ["entity"], "value", "path")
    assert got(groups, "entity", "verdict") == [("host", "sequence"), ("port", "conflict"), ("user", "agreement")]
    assert got(conflicts.conflicts_with(df, ["entity"], "value", "path")) == [("u1", ["u2"]), ("u2", ["u1"])]
    assert got(conflicts.report(groups)) == [("port", "port: 80 | 90 in 2 sources")]


def test_slugs(spark):
    rows = [("d", i, s) for i, s in enumerate(["a", "a", "a-2", "b", "a"])] + [("e", 0, "a")]
    df = spark.createDataFrame(rows, "scope string, i int, base string")
    assert got(slugs.unique(df, "scope", "i", "base"), "scope", "i", "slug") == [("d", 0, "a"), ("d", 1, "a-2"), ("d", 2, "a-2-2"), ("d", 3, "b"), ("d", 4, "a-3"), ("e", 0, "a")]
    used = set()
    assert [slugs.next_slug(x, used) for x in ("a", "a", "a-2")] == ["a", "a-2", "a-2-2"]


def test_tree_distance():
    chain = (["a", "b", "r"], [2, 2, -1])
    assert fidelity.tree_distance(*chain, *chain) == 0
    assert fidelity.tree_distance(*chain, ["a", "b", "c", "r"], [3, 3, 3, -1]) == 1
    assert fidelity.tree_distance(*chain, ["a", "x", "r"], [2, 2, -1]) == 1
    assert fidelity.tree_distance([], [], *chain) == 3
    # f(d(a c(b)) e) and f(c(d(a b)) e): the worked example of the method's paper, distance 2.
    assert fidelity.tree_distance(["a", "b", "c", "d", "e", "f"], [3, 2, 3, 5, 5, -1], ["a", "b", "d", "c", "e", "f"], [2, 2, 3, 5, 5, -1]) == 2


def test_tree_distance_is_symmetric():
    r = random.Random(0)

    def tree(n):
        parents = [r.randrange(i + 1, n) if i < n - 1 else -1 for i in range(n)]
        kids = {i: [j for j in range(n) if parents[j] == i] for i in range(n)}
        order = []

        def walk(i):
            for k in kids[i]:
                walk(k)
            order.append(i)

        walk(n - 1)
        at = {x: i for i, x in enumerate(order)}
        return [r.choice("ab") for _ in order], [at[parents[x]] if parents[x] >= 0 else -1 for x in order]

    for _ in range(40):
        a, b = tree(r.randint(1, 7)), tree(r.randint(1, 7))
        d = fidelity.tree_distance(*a, *b)
        assert d == fidelity.tree_distance(*b, *a) and abs(len(a[0]) - len(b[0])) <= d <= len(a[0]) + len(b[0])


def test_table_grid():
    assert fidelity.grid([(0, 0, 1, 2), (0, 1, 1, 1), (1, 0, 2, 1), (1, 1, 1, 1), (1, 2, 1, 1), (2, 0, 1, 1)]) == [(0, 0), (0, 2), (1, 0), (1, 1), (1, 2), (2, 1)]


def test_bag_scores(spark):
    bag = lambda x: spark.createDataFrame([(1, c) for c in x], "pair_id int, k string")
    row = gates.bag_overlap(bag("xxy"), bag("xyy"), ["pair_id"], "k").first()
    assert (row["matched"], round(row["precision"], 6), round(row["recall"], 6), round(row["f1"], 6)) == (2, 0.666667, 0.666667, 0.666667)
    none = gates.bag_overlap(bag("x"), bag(""), ["pair_id"], "k").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    cells = spark.createDataFrame([(1, 0, 0, 1, 2, "h"), (1, 1, 0, 1, 1, "a")], "pair_id int, row int, col int, row_span int, col_span int, text string")
    flat = cells.withColumn("col_span", F.lit(1))
    assert fidelity.table_scores(cells, flat).first()["f1"] == 0.5 and fidelity.table_scores(cells, flat, False).first()["f1"] == 1.0


def test_intervals(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 25, 25), (2, 0, 1000)], "d int, start long, end long")
    b = spark.createDataFrame([(1, 10, 12), (1, 5, 30), (2, 999, 1001), (2, 1000, 1001)], "d int, start long, end long")
    want = [(1, 0, 10, 5, 30), (1, 10, 20, 10, 12), (1, 10, 20, 5, 30), (2, 0, 1000, 999, 1001)]
    for width in (1, 7, 10_000):
        assert got(verify.overlaps(a, b, ["d"], width), "l.d", "l.start", "l.end", "r.start", "r.end") == want


def test_verification(spark):
    fragments = spark.createDataFrame([("f1", "Drain  the queue.", ["u1"]), ("f2", "never said", ["u1"]), ("f3", "x", ["u9"]), ("f4", "x", [])], "fragment_id string, text string, unit_ids array<string>")
    units = spark.createDataFrame([("u1", "You must drain the queue first.")], "unit_id string, text string")
    checked = verify.check_fragments(fragments, units)
    assert got(checked) == [("f1", "contained"), ("f2", "not-contained"), ("f3", "no-unit"), ("f4", "no-unit")]
    assert tuple(verify.traceability(checked).first()) == (1, 4, 0.25)
    assert tuple(verify.traceability(checked.limit(0)).first()) == (0, 0, 1.0)  # and covers nothing
    pieces = spark.createDataFrame([("f", 0, "ab"), ("f", 1, "é😀"), ("g", 0, "x")], "file string, i int, text string")
    assert got(verify.offsets(pieces, ["file"], ["i"], "text"), "file", "start", "end") == [("f", 0, 2), ("f", 2, 4), ("g", 0, 1)]


def test_line_windows(spark):
    docs = spark.createDataFrame([(1, "A.\n\na\nB"), (2, None)], "doc_id int, text string")
    assert got(lines.lines(docs), "doc_id", "line_no", "line") == [(1, 0, "A."), (1, 2, "a"), (1, 3, "B")]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["h1", "x", None, "y", "h2", "z"])], "d int, i int, v string")
    near = lines.nearest_preceding(rows, ["d"], ["i"], F.col("v").like("h%"), head=F.col("v"))
    assert [r["head"] for r in near.orderBy("i").collect()] == [None, "h1", "h1", "h1", "h1", "h2"]
    runs = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "d int, i int, v string")
    assert [r["island"] for r in lines.islands(runs, ["d"], ["i"], "v").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
    levels = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 4, 3, 5])], "d int, i int, v int")
    assert got(lines.level_skips(levels, ["d"], ["i"], "v"), "i") == [(2,), (4,)]
    same = lines.occurrences(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "d int, i int, u string"), ["d", "u"], ["i"])
    assert [r["occurrence"] for r in same.orderBy("i").collect()] == [0, 0, 1]


def test_classification(spark):
    docs = spark.createDataFrame([("1", "docs/runbook.md", ["Rollback", "Restart"], "x", 2, 0, 0), ("2", "notes.txt", [], "plain", 0, 0, 0), ("3", "glossary-test.md", [], "x", 0, 0, 0)], "doc_id string, path string, headings array<string>, body string, n_fences int, n_rules int, n_definitions int")
    out = {r["doc_id"]: r for r in classify.classify(docs).collect()}
    assert out["1"]["role"] == "runbook" and out["1"]["margin"] == 1.0
    assert out["2"]["role"] == "unknown" and out["2"]["distribution"][0]["share"] == 1.0
    assert out["3"]["role"] == "unknown" and out["3"]["margin"] == 0.0 and out["3"]["uncertain"]
    opinions = spark.createDataFrame([("3", "testPolicy"), ("1", "meetingNotes")], "doc_id string, opinion string")
    assert dict(got(classify.apply_opinion(classify.classify(docs), opinions), "doc_id", "role")) == {"1": "runbook", "2": "unknown", "3": "testPolicy"}


def test_headings(spark):
    kind = "doc_id string, node_id string, text string, style_id string, style_name string, outline_level int, direct boolean, size_pt double, weight int, all_caps boolean, keep_with_next boolean"
    rows = [("d", "a", "Any", None, None, 1, False, 11.0, 400, False, False), ("d", "b", "Any", None, "Heading 3", None, False, 11.0, 400, False, False), ("d", "c", "Any", "Heading2", None, None, False, 11.0, 400, False, False), ("d", "e", "Big bold title", None, None, None, True, 18.0, 700, False, False), ("d", "f", "A plain sentence.", None, None, None, True, 11.0, 400, False, False), ("d", "g", "styled body", None, "Body", None, False, 11.0, 400, False, False)]
    df = spark.createDataFrame(rows, kind)
    out = {r["node_id"]: (r["chosen"], r["level"], round(r["score"], 2)) for r in infer.heading_candidates(df).collect()}
    assert out == {"a": ("heading", 2, 1.0), "b": ("heading", 3, 0.95), "c": ("heading", 2, 0.8), "e": ("heading", 1, 0.9), "f": ("paragraph", None, 0.1)}
    blocks = spark.createDataFrame([("d", 0, "n0", "table", None, ""), ("d", 1, "n1", "paragraph", "Caption", "T1"), ("d", 2, "n2", "paragraph", "Quote", "q1"), ("d", 3, "n3", "paragraph", "Quote", "q2"), ("d", 4, "n4", "paragraph", "Normal", "p"), ("d", 5, "n5", "paragraph", "Quote", "q3")], "doc_id string, ord int, node_id string, type string, style_name string, text string")
    assert got(infer.grouped_blocks(blocks), "ord", "role", "text") == [(2, "blockquote", "q1\nq2"), (5, "blockquote", "q3")]
    assert got(infer.bind_captions(infer.style_roles(blocks)), "node_id", "target") == [("n1", "n0")]


def test_extraction_keeps_one_unit_per_wording(spark):
    blocks = [("d", 0, "heading", "Rule 1", None), ("d", 1, "paragraph", "Modules must not import each other.", None), ("d", 2, "paragraph", "You must keep logs for a year. You may keep more.", None), ("d", 3, "code", "# c\n$ make test\nAPI_KEY=x", "sh"), ("d", 4, "paragraph", "Shard — a slice of data", None)]
    df = spark.createDataFrame(blocks, "doc_id string, ord int, type string, text string, lang string").withColumn("level", F.lit(1))
    roles = spark.createDataFrame([("d", "codingConventions")], "doc_id string, role string")
    units = extract.extract_units(df, roles)
    assert got(units, "category", "text", "entity_key") == sorted([("convention", "Modules must not import each other.", None), ("constraint", "You must keep logs for a year.", None), ("command", "make test", "command:test"), ("environment", "API_KEY=x", "API_KEY"), ("glossary", "Shard — a slice of data", "shard")], key=repr)
    assert sorted(r["unit_order"] for r in units.collect()) == [0, 1, 2, 3, 4] and units.select("unit_id").distinct().count() == 5


def test_baselines_manifest_diagnostics(spark):
    now = spark.createDataFrame([("f1", 0.9, 1.0), ("f2", 0.5, 0.5), ("new", 1.0, 1.0)], "fixture string, m1 double, m2 double")
    old = spark.createDataFrame([("f1", 0.904, 0.9), ("f2", 0.6, 0.5), ("gone", 1.0, 1.0)], "fixture string, m1 double, m2 double")
    states = {(r["fixture"], r["metric"]): r["state"] for r in fidelity.compare_to_baseline(now, old, ["fixture"], ["m1", "m2"]).collect()}
    assert states == {("f1", "m1"): "same", ("f1", "m2"): "improvement", ("f2", "m1"): "regression", ("f2", "m2"): "same", ("new", "m1"): "added", ("new", "m2"): "added", ("gone", "m1"): "missing", ("gone", "m2"): "missing"}
    measured = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "m double")
    assert fidelity.metric_means(measured, ["m"]).first()[0] == 0.5 and fidelity.metric_means(measured.where("m < 0"), ["m"]).first()[0] == -1.0
    a = spark.createDataFrame([("p", "h1"), ("q", "h2"), ("r", "h3")], "path string, h string")
    b = spark.createDataFrame([("p", "h1"), ("q", "old"), ("s", "h4")], "path string, h string")
    assert got(manifest.states(a, b, "path", "h"), "path", "state") == [("p", "unchanged"), ("q", "changed"), ("r", "new")]
    assert got(manifest.to_process(a, b, "path", "h"), "path") == [("q",), ("r",)]
    one = spark.range(1)
    bag = diagnostics.collect(one.select(*diagnostics.lost("CE-A-0001")), one.select(*diagnostics.info("CE-A-0002")), one.select(*diagnostics.unavailable("CE-A-0003")))
    assert got(diagnostics.strict(bag), "code") == [("CE-A-0001",), ("CE-A-0003",)]
    with pytest.raises(ValueError):
        diagnostics.error("bad")


def test_gates(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "six five four three two one")], "doc_id int, text string")
    items = spark.createDataFrame([(9, "two three four five six seven")], "item_id int, text string")
    assert got(gates.contamination(docs, items)) == [(1, 9, 1, True)]
    rows = spark.createDataFrame([(1, "b", ["x", "y", "z"]), (2, "b", ["x", "y", "q"]), (3, "c", ["x"]), (4, "b", [])], "doc_id int, block string, w array<string>")
    assert got(gates.similar_in_block(rows, "block", "w", 0.5)) == [(1, 2, 0.5)]
    r = random.Random(1)
    many = [(i, "b" if i % 3 else "c", sorted({r.choice("abcdefgh") for _ in range(5)})) for i in range(40)]
    want = sorted((a, b) for a, x, v in many for b, y, w in many if a < b and x == y and len(set(v) & set(w)) >= 0.6 * len(set(v) | set(w)))
    old = gates.GRID
    for size in (1024, 4):
        gates.GRID = size
        assert got(gates.similar_in_block(spark.createDataFrame(many, rows.schema), "block", "w", 0.6), "a", "b") == sorted(want, key=repr)
    gates.GRID = old
    pages = spark.createDataFrame([("b", i, f"Page {i}") for i in range(5)] + [("b", 0, "once")], "book string, page int, line string")
    assert got(gates.furniture(pages, "book", "page", "line"), "shape", "support") == [("page #", 5)]
    assert gates.repeated_keys(docs.union(docs), "doc_id").count() == 2 and gates.orphans(docs, docs.where("doc_id = 1"), "doc_id").count() == 1
