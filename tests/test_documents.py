"""Readers, trees, writers, layout and compilation."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classify, fidelity, infer, layout, normalize, profiles, tree, verify
from corpusloom.plans.compile import Previous, compile_corpus
from corpusloom.sinks import docx, markdown as md_sink, typst
from corpusloom.sinks import html as html_sink
from corpusloom.sinks import json as json_sink
from corpusloom.sources import html, markdown, nodes, office, pages, scan

from .test_operators import got

TEXTS = [
    "# One\n\nPara *a* **b** `c` ~~d~~ [l](http://x \"t\") ![i](u)\n",
    "- a\n- b\n  - c\n\n    more\n- [x] done\n\n3. x\n4. y\n",
    "> q\n> > n\n\n> [!NOTE]\n> careful\n",
    "| a | b |\n|:-|-:|\n| 1 | 2 \\| 3 |\n",
    "```py meta\nx = 1\n\n# no heading\n```\n\n    indented\n",
    "text[^1] and $x^2$ and \\*no\\* snake_case_word 2*3*4\n\n[^1]: note\n\n$$\na+b\n$$\n",
    "---\nby: me\nno: 7\n---\n\nSetext\n===\n\nline  \nbreak &copy; <b>raw</b>\n\n***\n",
    "1986\\. year\n\n\\# no\n\n+ plus\n\n[ref]: http://r\n",
    "日本語の文。 العربية\n\n**強調**\n",
    "", "\n\n", "*", "**a", "[x", "`", "a\n- b\nc\n1) d",
    "<table><tr><th rowspan=2>h<td>d<tr><td>z</table>\n",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("flavor", sorted(md_sink.FLAVORS))
def test_formatting_is_a_fixed_point(text, flavor):
    once = md_sink.format_text(text, flavor)
    assert md_sink.format_text(once, flavor) == once


@pytest.mark.parametrize("text", TEXTS)
def test_formatting_keeps_the_tree(text):
    shape = lambda n: (n.type, n.level, n.ordered, n.value if n.type in ("code", "inlineCode", "math", "yaml") else None, [shape(c) for c in n.children])
    assert shape(markdown.parse(md_sink.format_text(text))) == shape(markdown.parse(text))
    assert markdown.parse(md_sink.format_text(text)).text() == markdown.parse(text).text()


def types(n):
    return [n.type, *(t for c in n.children for t in types(c))]


def test_markdown_tree():
    root = markdown.parse("# A *b*\n\n1. x\n\n   y\n2. z\n\n***a** b*")
    assert types(root) == ["root", "heading", "text", "emphasis", "text", "list", "listItem", "paragraph", "text", "paragraph", "text", "listItem", "paragraph", "text", "paragraph", "emphasis", "strong", "text", "text"]
    assert root.text() == "A b\n\nx\n\ny\n\nz\n\na b"


def test_html_tree():
    root = html.parse("<title>t</title><div><p>a <b>b</b><p>c &middot; &copy;<ul><li>x<li>y</ul>tail <a href='#z'>q</a></div><foo>bar</foo></p></nope><script>x<1</script>")
    assert types(root) == ["root", "paragraph", "text", "strong", "text", "paragraph", "text", "list", "listItem", "paragraph", "text", "listItem", "paragraph", "text", "paragraph", "text", "crossReference", "text", "paragraph", "unknown", "text"]
    assert "c &middot; ©" in root.text() and root.text().endswith("bar")
    table = html.parse("<table><caption>C</caption><thead><tr><th colspan=2>h</thead><tr><td>1<td><ul><li>x</ul></table>").children[0]
    assert types(table)[:4] == ["figure", "table", "tableRow", "tableCell"] and table.children[0].attrs["headerRows"] == "1" and table.children[0].children[0].children[0].col_span == 2
    once = html_sink.Renderer().document(root)
    assert html_sink.Renderer().document(html.parse(once)).replace("<p>bar</p>", "") == once.replace("<p>bar</p>", "")


def docs(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_node_table(spark):
    df = docs(spark, TEXTS)
    table = markdown.read_markdown(df).cache()
    assert {r["check"]: r["n"] for r in tree.audit(table).collect()} == {"repeated node id": 0, "not nested": 0, "misplaced child": 0}
    back = dict(got(md_sink.render(table)))
    assert back == {str(i): md_sink.format_text(t) for i, t in enumerate(TEXTS)}
    texts = dict(got(tree.text_content(table)))
    for i, t in enumerate(TEXTS):
        assert "".join(texts.get(str(i), "").split()) == "".join(markdown.parse(t).text().split())
    lists = tree.subtrees(table, F.col("type") == "list")
    assert lists.count() + tree.without_subtrees(table, F.col("type") == "list").count() == table.count()
    assert got(tree.find(table.where("doc_id = '0'"), F.col("type") == "strong"), "type", "depth") == [("strong", 2)]
    assert tree.until(table.where("doc_id = '0'"), F.col("type") == "paragraph").count() == 4
    kept = tree.renumber(tree.without_subtrees(table, F.col("type") == "list"))
    assert {r["check"]: r["n"] for r in tree.audit(kept).collect()}["not nested"] == 0
    assert kept.groupBy("doc_id").agg((F.max("ord") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0
    bad = table.withColumn("type", F.when(F.col("type") == "listItem", "paragraph").otherwise(F.col("type")))
    assert tree.misplaced(bad).count() > 0
    again = markdown.read_markdown(df.repartition(5))
    assert got(again, "doc_id", "ord", "node_id") == got(table, "doc_id", "ord", "node_id")
    spans = got(tree.inline_spans(table.where("doc_id = '0'")), "mark", "start", "end")
    assert ("emphasis", 8, 9) in spans and ("strong", 10, 11) in spans


def test_structure_scores(spark):
    table = markdown.read_markdown(docs(spark, ["# a\n\nb\n\n- c", "# a\n\nb\n\n- c", "## a\n\nb"]))
    pairs = spark.createDataFrame([("0", "1"), ("0", "2"), ("0", "0")], "a string, b string")
    scores = {(a, b): s for a, b, s in got(fidelity.structure_scores(pairs, table))}
    assert scores["0", "1"] == scores["0", "0"] == 1.0
    assert scores["0", "2"] == pytest.approx(1 - 5 / 14)  # heading relabelled; list, item, paragraph, text removed
    delta = fidelity.census_delta(fidelity.census(table.where("doc_id = '0'")), fidelity.census(table.where("doc_id = '2'")), [])
    assert got(delta, "type", "delta") == [("list", -1), ("listItem", -1), ("paragraph", -1), ("text", -1)]


def test_table_cells(spark):
    page = spark.createDataFrame([(1, "<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c <b>d</b></td></tr></table>")], "page_id long, html string")
    cells = tree.table_cells(html.read_html(page))
    assert got(cells, "row", "col", "row_span", "col_span", "text") == [(0, 0, 1, 2, "h"), (1, 0, 2, 1, "a"), (1, 1, 1, 1, "b"), (2, 1, 1, 1, "c d")]


def test_normalising_is_idempotent(spark):
    rows = []
    n = nodes.Node
    rows += nodes.rows("d", n("root", [n("paragraph", [n("text", value="  a\n\u00adb "), n("text", value="  c"), n("strong", [n("text", value=" d ")]), n("text", value="e  ")]), n("code", value=" x  y ")]))
    df = spark.createDataFrame([(*r[:-1], dict(r[-1])) for r in rows], nodes.NODE)
    once = normalize.normalize(df)
    assert got(once.where("value is not null"), "value") == [(" d ",), (" x  y ",), ("a b c",), ("e",)]
    assert got(normalize.normalize(once)) == got(once)
    blocks = spark.createDataFrame([("d", 0, "a", False), ("d", 1, "", False), ("d", 2, " ", False), ("d", 3, "b", False), ("d", 4, "", True)], "doc_id string, ord int, text string, bordered boolean")
    assert got(normalize.absorb_spacing(blocks), "ord", "space_before_pt") == [(0, 0.0), (3, 24.0), (4, 0.0)]


def test_word_processing_round_trip(spark):
    text = "# T\n\nA **b** *i* [l](http://x) c[^1]\n\n- a\n  - b\n- c\n\n3. x\n4. y\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode\nx\n```\n\n> q\n\n[^1]: note\n"
    data = docx.Writer().package(markdown.parse(text))
    assert data == docx.Writer().package(markdown.parse(text))
    roots = dict(office.parse_docx(data))
    assert md_sink.Renderer().document(roots["body"]) == md_sink.format_text(text)
    merged = html.parse("<table><tr><td colspan=2>h</td></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>")
    back = dict(office.parse_docx(docx.Writer().package(merged)))["body"]
    assert html_sink.Renderer().document(back) == html_sink.Renderer().document(merged)
    assert docx.missing_styles(["normal", "Heading 1"]) == docx.STYLES[2:]
    table = markdown.read_markdown(docs(spark, [text]))
    assert bytes(docx.render(table).first()["bytes"]) == data


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


W = f'xmlns:w="{docx.W}"'
REL = docx.R


def test_style_cascade_and_revisions():
    styles = f'<w:styles {W}><w:docDefaults/><w:style w:styleId="A"><w:name w:val="A"/><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:name w:val="B"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="X"><w:basedOn w:val="Y"/></w:style><w:style w:styleId="Y"><w:basedOn w:val="X"/></w:style></w:styles>'
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="A"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="X"/></w:pPr><w:ins w:author="me"><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:rPr><w:b/><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r></w:p><w:altChunk/><w:sectPr/></w:body></w:document>'
    root = dict(office.parse_docx(package({"word/document.xml": body, "word/styles.xml": styles})))["body"]
    assert types(root) == ["root", "heading", "text", "paragraph", "insertion", "text", "deletion", "text", "superscript", "strong", "text", "unknown"]
    assert root.children[0].level == 2 and root.children[2].attrs["construct"] == "docx:altChunk"


def test_spreadsheet():
    assert [office.cell_place(x) for x in ("A1", "B7", "AA10")] == [(0, 0), (6, 1), (9, 26)]
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>in</t></is></c></row><row><c r="A2"><f>1+1</f><v>2</v></c><c r="B2" t="b"><v>1</v></c></row><row><c r="A3"><v>9</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells></worksheet>'
    data = package({"xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="r1" Type="{REL}/worksheet" Target="worksheets/s.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>sh</t></si></sst>", "xl/worksheets/s.xml": sheet})
    s = office.parse_xlsx(data).children[0]
    assert [[(c.text(), c.col_span) for c in r.children] for r in s.children[1].children] == [[("sh", 1), ("in", 1)], [("2", 1), ("TRUE", 1)], [("9", 2)]]
    assert s.attrs["formulas"] == "1" and office.parse_xlsx(data, 2).children[0].attrs["truncated"] == "1"


def test_presentation():
    shape = lambda kind, y, text: f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>{text}</p:txBody></p:sp>'
    p = lambda t, pr="": f"<a:p>{pr}<a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shape("", 900000, p("two") + p("three"))}{shape("title", 5000000, p("T"))}{shape("", 100000, p("one", "<a:pPr><a:buNone/></a:pPr>"))}</p:spTree></p:cSld></p:sld>'
    root = office.parse_pptx(package({"ppt/slides/slide10.xml": slide, "ppt/slides/slide2.xml": slide}))
    assert [s.attrs["number"] for s in root.children] == ["2", "10"]
    assert types(root.children[0]) == ["slide", "heading", "text", "paragraph", "text", "list", "listItem", "paragraph", "text", "listItem", "paragraph", "text"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.HTM").write_text("<h2>B</h2>")
    (tmp_path / "c.docx").write_bytes(docx.Writer().package(markdown.parse("# C")))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.bin").write_bytes(b"x")
    files = scan.read_folder(spark, str(tmp_path))
    assert got(files, "format") == [("docx",), ("docx",), ("html",), ("md",)] and files.where("source_text is not null").count() == 2
    table = scan.read_documents(files)
    assert got(table.where("type = 'heading'").select("level")) == [(1,), (1,), (2,)]
    assert got(scan.unreadable(table), "construct") == [("docx:unreadable",)]


def test_typst_and_json(spark):
    table = markdown.read_markdown(docs(spark, ["# A #b\n\n- x *y*\n\n<b>raw</b>\n\n| a |\n|-|\n| 1 |\n"]))
    row = typst.render(table).first()
    assert row["rendered"].startswith("= A \\#b\n\n- x #emph[y]") and "#table(columns: 1, [a], [1])" in row["rendered"] and row["lost"] == ["html"]
    assert json_sink.render(table).first()["rendered"] == json_sink.render(table.repartition(3)).first()["rendered"]


def run_rows(page, lines, x=50.0, size=10.0, y0=100.0):
    return [("d", page, 600.0, 800.0, t, x, y0 + i * 12, 5.0 * len(t), size, "F") for i, t in enumerate(lines)]


def test_layout(spark):
    rows = []
    for p in (1, 2, 3):
        rows += [("d", p, 600.0, 800.0, f"Report {p}", 50.0, 20.0, 50.0, 10.0, "F")]
        rows += run_rows(p, [f"left {p} {i} words here exam-" if i == 0 else f"ple text number {i} {'abc'[p - 1] * 3}" for i in range(6)])
        rows += run_rows(p, [f"right side {'xyz'[p - 1]} line {i}" for i in range(6)], x=350.0)
    rows += [("e", 1, 600.0, 800.0, "Title", 50.0, 50.0, 80.0, 20.0, "F"), ("e", 1, 600.0, 800.0, "- one", 50.0, 100.0, 30.0, 10.0, "F"), ("e", 1, 600.0, 800.0, "more", 60.0, 112.0, 30.0, 10.0, "F"), ("e", 1, 600.0, 800.0, "- two", 50.0, 124.0, 30.0, 10.0, "F"), ("e", 1, 600.0, 800.0, "Some", 50.0, 200.0, 20.0, 10.0, "F"), ("e", 1, 600.0, 800.0, "words", 75.0, 201.0, 25.0, 10.0, "F")]
    runs = spark.createDataFrame(rows, layout.RUN).repartition(3)
    cols = layout.columns(runs)
    assert got(cols.groupBy("doc_id", "page").count(), "doc_id", "page", "count") == [("d", 1, 2), ("d", 2, 2), ("d", 3, 2), ("e", 1, 1)]
    placed = layout.lines(layout.assign_columns(runs, cols))
    assert got(placed.where("doc_id = 'e' and y >= 200"), "text") == [("Some words",)]
    body = layout.without_furniture(placed)
    assert body.where("text like 'Report%'").count() == 0 and body.where("doc_id = 'd'").count() == 36
    blocks = layout.typed_blocks(layout.blocks(body))
    assert blocks.where("text like '%example text number 1%'").count() == 3
    assert got(blocks.where("kind = 'heading'"), "text", "level") == [("Title", 1)]
    assert got(layout.list_items(blocks), "text", "ordered") == [("one more", False), ("two", False)]
    sure = {(r["doc_id"], r["page"]): r["confidence"] for r in layout.reading_confidence(cols, F.lit(5.0)).collect()}
    assert sure["e", 1] == 0.95 and all(0.55 <= sure["d", p] <= 0.95 for p in (1, 2, 3))


def test_recognised_pages(spark):
    chunks = spark.createDataFrame([("d", 1, "A para-\ngraph here\n\n- x\n- y\n\nend"), ("d", 2, " ")], "doc_id string, page int, text string")
    blocks = pages.text_blocks(chunks)
    assert got(pages.grouped(blocks), "kind", "texts") == [("list", ["x", "y"]), ("paragraph", ["A paragraph here"]), ("paragraph", ["end"])]
    assert got(pages.diagnostics(blocks.withColumn("confidence", F.lit(0.5)), chunks.select("doc_id", "page")), "page", "code") == [(1, "CE-OCR-0001"), (2, "CE-OCR-0002")]


def test_profiles():
    found = {"base": profiles.BASE, "small": {"id": "small", "version": 1, "kind": "flat", "extends": "base", "budget": {"primary": 10, "secondary": 0, "chars_per_token": 3.8, "overflow": "truncateLowestValue"}}}
    assert profiles.resolve(found, "small")["sections"] == profiles.BASE["sections"] and profiles.resolve(found, "small")["budget"]["primary"] == 10
    found["a"] = {"id": "a", "version": 1, "kind": "flat", "extends": "b"}
    found["b"] = {"id": "b", "version": 1, "kind": "flat", "extends": "a"}
    with pytest.raises(ValueError, match="extend each other"):
        profiles.resolve(found, "a")
    with pytest.raises(ValueError, match="lacks"):
        profiles.resolve({"c": {"id": "c"}}, "c")


CORPUS = [
    ("1", "docs/runbook-deploy.md", "# Deploy\n\nYou must drain the queue before a restart.\n\n```sh\n# comment\n$ make deploy\nexport API_TIMEOUT=30\n```\n\n```bash\nmake rollback\n```\n\n## Rollback\n\nNever restart two nodes at once.", None),
    ("2", "conventions/style-guide.md", "# Naming\n\n## Rule 1\n\nFunctions are named with verbs.\n\n## Rule 2\n\nModules must not import each other in cycles.\n\n## Rule 3\n\nUse spaces.\n\nEvery public function has a docstring and a test.", None),
    ("3", "adr/0007-queue.md", "# ADR 7 Use a queue\n\nWe use one queue per tenant.\n\nBecause tenants must not block each other.\n\n# Consequences\n\nYou must drain the queue before a restart", None),
    ("4", "glossary.md", "# Terms\n\nTenant — a paying customer.\n\nNode — one machine of the cluster.\n\nShard — a slice of the data.\n\n```env\nAPI_TIMEOUT=60\n```", None),
]


def test_compilation(spark):
    df = spark.createDataFrame(CORPUS, "doc_id string, path string, text string, reviewed date")
    c = compile_corpus(df)
    assert dict(got(c.roles, "doc_id", "role")) == {"1": "runbook", "2": "codingConventions", "3": "decisionRecord", "4": "domainGlossary"}
    assert got(c.conflicts.where("verdict = 'conflict'"), "entity_key", "values") == [("API_TIMEOUT", ["30", "60"])]
    drain = c.units.where("text like 'You must drain%'").collect()
    assert len(drain) == 1 and len(drain[0]["sources"]) == 2
    assert c.checked.where("status <> 'contained'").count() == 0 and c.checked.count() == 16
    text = c.files.first()["text"]
    assert "## Commands\n\n```\nmake deploy\nmake rollback\n```" in text and "- We use one queue per tenant.\n  - Because tenants" in text
    rebuilt = c.fragments.orderBy("frag_idx").collect()
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rebuilt) and rebuilt[-1]["end"] == len(text)
    tight = compile_corpus(df.repartition(4), profiles.BASE | {"budget": {"primary": 30, "secondary": 0, "chars_per_token": 3.8, "overflow": "truncateLowestValue"}})
    assert tight.placed.where("place = 'primary'").agg(F.sum("tokens")).first()[0] <= 30 and tight.placed.where("place = 'dropped'").count() > 5
    assert compile_corpus(df.limit(0)).files.count() == 0
    assert c.passed() and c.violations.isEmpty() and got(c.traced.groupBy("state").count()) == [("supported", len([x for x in text.split("\n") if x]))]
    assert got(c.conflict_report, "line") == [("environment/API_TIMEOUT: 30 | 60 in 2 sources",)]
    assert got(c.conflict_sides, "value", "path", "place") == [("30", "docs/runbook-deploy.md", 1), ("60", "glossary.md", 2)]
    assert c.units.where("size(conflicts_with) = 1").count() == 2
    m = json.loads(c.manifest_json())
    assert [x["path"] for x in m["sources"]] == sorted(p for _, p, _, _ in CORPUS) and m["files"][0]["content_hash"] == hashlib.sha256(text.encode()).hexdigest()
    ids = {u["unit_id"]: u["text"] + " " + (u["rationale"] or "") for u in m["units"]}
    assert m["spans"] and all(text[x["start"] : x["end"]] in ids[x["unit_id"]] for x in m["spans"])


def test_semantic_merging(spark):
    df = spark.createDataFrame(CORPUS + [("5", "docs/more.md", "# More\n\nYou must empty the queue before a restart.\n\nYou must always empty the queue before a restart.\n\nYou must restart before the queue is empty.", None)], "doc_id string, path string, text string, reviewed date")
    plain = compile_corpus(df)
    by_text = {r["text"]: r["unit_id"] for r in plain.units.where("category = 'constraint'").collect()}
    a, b = next(v for k, v in by_text.items() if k.startswith("You must drain")), by_text["You must empty the queue before a restart."]
    always, other = by_text["You must always empty the queue before a restart."], by_text["You must restart before the queue is empty."]
    vectors = spark.createDataFrame([(a, [1.0, 0.0]), (b, [0.99, 0.1]), (always, [0.98, 0.15]), (other, [0.9, 0.3]), ("gone", [1.0, 0.0])], "unit_id string, embedding array<double>")
    said = spark.createDataFrame([(b, a, True, "You must empty the queue before a restart."), (b, always, True, "x"), (a, other, False, None)], "a string, b string, same_fact boolean, surviving_text string")
    c = compile_corpus(df, embeddings=vectors, answers=said)
    state = {frozenset((r["a"], r["b"])): r["state"] for r in c.pairs.collect()}
    assert state[frozenset((a, b))] == "merge" and state[frozenset((b, always))] == "vetoed" and state[frozenset((a, other))] == "apart" and len(state) == 6
    left = {r["unit_id"]: r for r in c.units.where("category = 'constraint'").collect()}
    assert a not in left and {b, always, other} <= set(left) and len(left) == len(by_text) - 1
    assert {s["path"] for s in left[b]["sources"]} == {"docs/runbook-deploy.md", "adr/0007-queue.md", "docs/more.md"}
    assert c.units.count() == plain.units.count() - 1 and c.passed()
    assert compile_corpus(df, embeddings=vectors).units.count() == plain.units.count()  # nearness alone merges nothing


def test_opinions_and_earlier_runs(spark):
    df = spark.createDataFrame(CORPUS, "doc_id string, path string, text string, reviewed date")
    first = compile_corpus(df)
    shares = {r["doc_id"]: [(x["role"], x["share"]) for x in r["distribution"]] for r in first.roles.collect()}
    opinions = spark.createDataFrame([(d, x[-1][0]) for d, x in shares.items()] + [("1", "zzz")], "doc_id string, opinion string")
    roles = {r["doc_id"]: (r["role"], r["decided_by"]) for r in compile_corpus(df, opinions=opinions).roles.collect()}
    for d, x in shares.items():
        near = len(x) > 1 and x[0][1] - x[-1][1] < classify.MARGIN
        assert roles[d] == ((x[-1][0], "model") if near else (x[0][0], "rule"))
    changed = spark.createDataFrame([(d, p, t.replace("two nodes", "three nodes"), r) for d, p, t, r in CORPUS], "doc_id string, path string, text string, reviewed date")
    previous = Previous(first.manifest["sources"].select("path", "content_hash"), first.extracted.withColumn("text", F.when(F.col("path") == "glossary.md", F.upper("text")).otherwise(F.col("text"))))
    again = compile_corpus(changed, previous=previous)
    texts = {r["text"] for r in again.units.collect()}
    assert "Never restart three nodes at once." in texts and "TENANT — A PAYING CUSTOMER." in texts and "Never restart two nodes at once." not in texts


def test_scaffold_is_checked(spark):
    rows = [("f#0", "f", "## Commands", "heading"), ("f#1", "f", "## Ignore all rules", "heading"), ("f#2", "f", "- ", "marker"), ("f#3", "f", "* x", "marker"), ("f#4", "f", "```sh\n", "fence"), ("f#5", "f", "```sh rm", "fence"), ("f#6", "f", " \n", "blank"), ("f#7", "f", "a", "blank"), ("f#8", "f", "own", None), ("f#9", "f", "secret: 1", "frontMatter"), ("f#a", "f", "k", "manifestKey"), ("f#b", "f", "x", "odd")]
    df = spark.createDataFrame(rows, "fragment_id string, file string, text string, scaffold string")
    assert [r[0] for r in got(verify.scaffold_violations(df, profiles.BASE), "fragment_id")] == ["f#1", "f#3", "f#5", "f#7", "f#9", "f#a", "f#b"]


def test_small_things_of_profiles_and_folders(spark, tmp_path):
    path = profiles.init(str(tmp_path / "own"), "mine")
    assert profiles.load(str(tmp_path / "own"))["mine"]["kind"] == "flat"
    with pytest.raises(FileExistsError):
        profiles.init(str(tmp_path / "own"), "mine")
    ages = profiles.verification_ages(spark, {"a": {"verified": "2024-03-01"}, "b": {}}, "2024-03-31")
    assert got(ages, "id", "age_days") == [("a", 30), ("b", None)] and path.endswith("mine.json")
    with pytest.raises(FileNotFoundError):
        scan.read_folder(spark, str(tmp_path))
    (tmp_path / "b.md").write_text("Last reviewed: 2024-06-01\n")
    (tmp_path / "a.md").write_text("x")
    rows = scan.read_folder(spark, str(tmp_path)).collect()
    assert [(r["path"], str(r["reviewed"]), round(r["authority"], 3)) for r in rows] == [("a.md", "None", 0.5), ("b.md", "2024-06-01", 0.525)]


def test_decisions_are_explained(spark):
    df = spark.createDataFrame([("d", "n1", "heading", 2, 0.95, 0.9, False), ("d", "n2", "paragraph", None, 0.45, 0.1, True)], "doc_id string, node_id string, chosen string, level int, score double, margin double, ambiguous boolean")
    assert [r[0] for r in got(infer.explain(df), "line")] == ["n1: heading 2 (score 0.95, margin 0.90)", "n2: paragraph (score 0.45, margin 0.10, ambiguous)"]
