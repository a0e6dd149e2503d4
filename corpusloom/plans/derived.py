"""Queries over documents made from the tables: each text becomes an HTML page, a Markdown note, a
package or placed text runs, of which it is known what readers, writers and the compiler must find."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from ..functions import hashing, text as T
from ..operators import assemble, classify, dedup, extract, fidelity, infer, layout, lines as L, profiles, tree
from ..sinks import docx as docx_sink, html as html_sink, markdown as md_sink
from ..sources import html, markdown, scan
from .compile import compile_corpus
from .corpus import _LINES, _NORM, _SIGNALS, _signal_sql
from .registry import query, table
from .store import written
from .tables import _CAPPED

_FLAT = r"trim(regexp_replace(line, '[ \t\r\n\f\v]+', ' ', 'g'))"
_TEXT_SQL = f"SELECT doc_id, count(*) AS n_blocks, sha256(string_agg({_FLAT}, chr(10) || chr(10) ORDER BY line_no)) AS digest FROM ({_LINES}) GROUP BY doc_id"


def _lines(spark, d):
    """doc_id, lines: the lines with content of every text that has any."""
    full = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "source", "n_chars", full.alias("lines")).where("size(lines) > 0")


def _pages(spark, d, shape=lambda x, i: F.concat(F.lit("<p>"), T.escape_html(x), F.lit("</p>"))):
    return _lines(spark, d).select("doc_id", F.array_join(F.transform("lines", shape), "").alias("html"))


def _nodes(spark, d, *shape):
    return html.read_html(_pages(spark, d, *shape), "doc_id", "html")


def _text_digest(nodes):
    return tree.body_texts(nodes).select(F.col("doc_id").cast("long").alias("doc_id"), "n_blocks", hashing.sha256_hex(F.col("text")).alias("digest"))


@query("q45_html_text", _TEXT_SQL)
def html_text(spark, d):
    return _text_digest(_nodes(spark, d))


@query("q46_docx_round_trip", _TEXT_SQL)
def docx_round_trip(spark, d):
    """Pages to word-processing packages and back."""
    files = docx_sink.render(_nodes(spark, d)).withColumn("format", F.lit("docx"))
    return _text_digest(scan.read_documents(files))


@query("q47_html_round_trip", _TEXT_SQL)
def html_round_trip(spark, d):
    return _text_digest(html.read_html(html_sink.render(_nodes(spark, d)), "doc_id", "rendered"))


@query("q48_markdown_round_trip", _TEXT_SQL)
def markdown_round_trip(spark, d):
    return _text_digest(markdown.read_markdown(md_sink.render(_nodes(spark, d)), column="rendered"))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_REL = "urn:relations"


@F.pandas_udf(BinaryType())
def _workbook(lines: pd.Series) -> pd.Series:
    """A sheet with the number and the text of each line."""

    def one(own) -> bytes:
        rows = "".join(f'<row><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for i, x in enumerate(own, 1))
        book = f'<workbook xmlns:r="{_REL}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
        links = f'<Relationships><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/s.xml"/></Relationships>'
        return _zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/worksheets/s.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})

    return lines.map(one)


@query("q49_spreadsheet_cells", f"SELECT doc_id, 2 * count(*) AS n_cells, sha256(string_agg({_FLAT}, chr(10) ORDER BY line_no)) AS digest FROM ({_LINES}) GROUP BY doc_id")
def spreadsheet_cells(spark, d):
    files = _lines(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), _workbook("lines").alias("bytes"), F.lit("xlsx").alias("format"))
    cells = tree.table_cells(scan.read_documents(files))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("col") == 1, F.struct("row", "text")))), lambda x: F.trim(T.collapse(x["text"], T.TREE_SPACE))), "\n")
    return cells.groupBy("doc_id").agg(F.count("*").alias("n_cells"), hashing.sha256_hex(text).alias("digest")).select(F.col("doc_id").cast("long").alias("doc_id"), "n_cells", "digest")


@F.pandas_udf(BinaryType())
def _deck(lines: pd.Series) -> pd.Series:
    """A slide for each line: its number as the title, the text in a box below."""

    def one(own) -> bytes:
        shape = lambda kind, y, x: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:pPr><a:buNone/></a:pPr><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody></p:sp>'
        head = '<p:ph type="title"/>'
        slide = lambda i, x: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shape("", 900000, x)}{shape(head, 0, str(i))}</p:spTree></p:cSld></p:sld>'
        return _zipped({f"ppt/slides/slide{i}.xml": slide(i, x) for i, x in enumerate(own, 1)})

    return lines.map(one)


@query(
    "q50_presentation_text",
    f"""SELECT doc_id, count(*) AS n_slides, sha256(string_agg(CAST(n AS VARCHAR) || chr(10) || {_FLAT}, chr(10) ORDER BY n)) AS digest
    FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM ({_LINES})) GROUP BY doc_id""",
)
def presentation_text(spark, d):
    files = _lines(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), _deck("lines").alias("bytes"), F.lit("pptx").alias("format"))
    nodes = scan.read_documents(files)
    blocks = tree.blocks_in_order(nodes).where("type in ('heading', 'paragraph')").withColumn("text", F.trim(T.collapse(F.col("text"), T.TREE_SPACE)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return blocks.groupBy("doc_id").agg(F.count(F.when(F.col("type") == "heading", 1)).alias("n_slides"), hashing.sha256_hex(text).alias("digest")).select(F.col("doc_id").cast("long").alias("doc_id"), "n_slides", "digest")


# A note of every kind of fact, made from each document's columns.

_NOTE = (
    "# Rule {doc_id}\n\nUse {lang} for text.\n\n```bash\nmake deploy\n# remark\nexport DOC_{doc_id}={n_chars}\nexport SHARED_LIMIT={third}\n```\n\n"
    "## Terms\n\nTerm {doc_id} — kept in {lang}.\n\nYou must never drop source {source} now. It has {n_chars} signs today.\n\n- You should keep {lang} lines short enough.\n"
)


def _filled(text: str):
    """The note's text as one column expression."""
    values = {"doc_id": F.col("doc_id").cast("string"), "lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars").cast("string"), "third": F.pmod("n_chars", F.lit(3)).cast("string")}
    parts, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def _filled_sql(text: str) -> str:
    values = {"doc_id": "CAST(doc_id AS VARCHAR)", "lang": "lang", "source": "source", "n_chars": "CAST(n_chars AS VARCHAR)", "third": "CAST(n_chars % 3 AS VARCHAR)"}
    quoted = "'" + text.replace("'", "''") + "'"
    for name, sql in values.items():
        quoted = quoted.replace("{" + name + "}", f"' || {sql} || '")
    return quoted.replace("\n", "' || chr(10) || '")


def _notes(spark, d):
    own = table(spark, d, "documents").where("lang is not null and source is not null and n_chars is not null")
    return own.select("doc_id", F.concat(F.lit("notes/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("path"), _filled(_NOTE).alias("text"), F.lit(None).cast("date").alias("reviewed"))


#: category, text, confidence, entity key, entity value of each unit of a note, in the order of extraction.
_FACTS = [
    ("convention", "Use {lang} for text.", 0.9, None, None),
    ("environment", "DOC_{doc_id}={n_chars}", 0.95, "DOC_{doc_id}", "{n_chars}"),
    ("environment", "SHARED_LIMIT={third}", 0.95, "SHARED_LIMIT", "{third}"),
    ("command", "make deploy", 0.95, "command:deploy", "make deploy"),
    ("glossary", "Term {doc_id} — kept in {lang}.", 0.9, "term {doc_id}", "kept in {lang}."),
    ("antiPattern", "You must never drop source {source} now.", 0.8, None, None),
    ("constraint", "You should keep {lang} lines short enough.", 0.65, None, None),
]
_PATH_SQL = "'notes/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.md'"
_FACTS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {_PATH_SQL} AS path, '{c}' AS category, {_filled_sql(t)} AS text, {conf}::DOUBLE AS confidence, {_filled_sql(k) if k else 'CAST(NULL AS VARCHAR)'} AS entity_key, {_filled_sql(v) if v else 'CAST(NULL AS VARCHAR)'} AS entity_value FROM documents"
    for c, t, conf, k, v in _FACTS
)


@query("q51_extracted_units", f"SELECT doc_id, category, text, confidence, entity_key, entity_value, sha256('{{\"category\":' || to_json(category) || ',\"text\":' || to_json(text) || '}}') AS content_hash FROM ({_FACTS_SQL})")
def extracted_units(spark, d):
    notes = _notes(spark, d)
    blocks = written(tree.blocks_in_order(markdown.read_markdown(notes)), "blocks")
    roles = notes.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("unknown").alias("role"))
    units = extract.extract_units(blocks, roles)
    return units.select(F.col("doc_id").cast("long").alias("doc_id"), "category", "text", "confidence", "entity_key", "entity_value", "content_hash")


def _compiled(spark, d):
    wide = profiles.BASE | {"budget": profiles.BASE["budget"] | {"primary": 1 << 40}}
    return compile_corpus(_notes(spark, d), wide)


@query(
    "q42_compiled_units",
    f"""WITH u AS (SELECT *, trim(regexp_replace(lower(text), '[.;:,]+$', '')) AS norm FROM ({_FACTS_SQL})),
    m AS (SELECT category, norm, min(text) AS text, count(DISTINCT path) AS n_sources, min(path) AS path, min(entity_key) AS entity_key, min(entity_value) AS entity_value FROM u GROUP BY category, norm),
    c AS (SELECT category, entity_key FROM m WHERE entity_key IS NOT NULL GROUP BY category, entity_key HAVING count(DISTINCT entity_value) > 1)
    SELECT m.category, m.text, m.n_sources, m.path, CASE WHEN c.entity_key IS NULL THEN 0 ELSE (SELECT count(*) - 1 FROM m x WHERE x.category = m.category AND x.entity_key = m.entity_key) END AS n_conflicts
    FROM m LEFT JOIN c ON m.category = c.category AND m.entity_key = c.entity_key""",
)
def compiled_units(spark, d):
    """What the compiler keeps of all notes: one unit for a fact, with its sources and contradictions."""
    units = _compiled(spark, d).units
    return units.select("category", "text", F.size("sources").cast("long").alias("n_sources"), "path", F.coalesce(F.size("conflicts_with"), F.lit(0)).cast("long").alias("n_conflicts"))


@query(
    "q52_source_manifest",
    f"SELECT {_PATH_SQL} AS path, sha256({_filled_sql(_NOTE)}) AS content_hash, 'unknown' AS role, CAST({len(_FACTS)} AS BIGINT) AS n_units FROM documents",
)
def source_manifest(spark, d):
    return _compiled(spark, d).sources


@query("q53_emitted_spans", f"SELECT text, count(*) AS n_paths FROM (SELECT DISTINCT path, text FROM ({_FACTS_SQL})) GROUP BY text")
def emitted_spans(spark, d):
    """The manifest's spans, cut out of the emitted file: each is a fact, with the sources that it rests on."""
    done = _compiled(spark, d)
    owned = done.fragments.where("size(unit_ids) > 0").select("file", "fragment_id", "start", "end")
    cut = assemble.cuts(done.files, owned).select("file", "fragment_id", "text")
    return done.spans.select("file", "fragment_id", "path").join(cut, ["file", "fragment_id"]).groupBy("text").agg(F.count_distinct("path").alias("n_paths"))


# Headings, restatements, opinions, merges

_SOFT = "least(1.0, greatest(0.0, greatest(0.0, least(0.5, (size / body - 1) * 1.5)) + CASE WHEN weight >= 600 THEN 0.2 ELSE 0 END + CASE WHEN caps THEN 0.1 ELSE 0 END + CASE WHEN n BETWEEN 1 AND 80 THEN 0.1 ELSE 0 END + CASE WHEN NOT regexp_matches(line, '[.!?;:,]\\s*$') THEN 0.1 ELSE 0 END + CASE WHEN first THEN 0.15 ELSE 0 END - CASE WHEN n > 200 THEN 0.4 ELSE 0 END))"


@query(
    "q54_heading_candidates",
    f"""WITH p AS (SELECT doc_id, line_no, line, length(line) AS n, line_no = 0 AS first, CASE WHEN line_no = 0 THEN 16.0 ELSE 10.0 + line_no % 3 END::DOUBLE AS size, CASE WHEN doc_id % 2 = 0 THEN 700 ELSE 400 END AS weight, upper(line) = line AS caps,
      CASE WHEN doc_id % 5 = 0 AND line_no = 0 THEN 1 END AS outline, CASE WHEN doc_id % 3 = 0 AND line_no = 0 THEN 2 END AS named FROM ({_LINES})),
    b AS (SELECT doc_id, CAST(median(size) AS DOUBLE) AS body FROM p GROUP BY doc_id),
    s AS (SELECT p.*, body, CAST(CASE WHEN outline IS NOT NULL THEN 1.0 WHEN named IS NOT NULL THEN 0.95 ELSE {_SOFT} END AS DOUBLE) AS score FROM p JOIN b USING (doc_id))
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN round(score, 6) > 0.5 THEN 'heading' ELSE 'paragraph' END AS chosen,
      CAST(CASE WHEN round(score, 6) <= 0.5 THEN NULL WHEN outline IS NOT NULL THEN 2 WHEN named IS NOT NULL THEN 2 WHEN size / body >= 1.6 THEN 1 WHEN size / body >= 1.35 THEN 2 WHEN size / body >= 1.15 THEN 3 ELSE 4 END AS BIGINT) AS level, round(score, 6) AS score FROM s""",
)
def heading_candidates(spark, d):
    """Every line as a paragraph with styles and typography that follow from its place."""
    first = F.col("line_no") == 0
    rows = L.lines(table(spark, d, "documents")).select(
        "doc_id", F.col("line_no").cast("long").alias("node_id"), F.col("line").alias("text"), F.lit(None).cast("string").alias("style_id"), F.when((F.col("doc_id") % 3 == 0) & first, "Heading 2").alias("style_name"),
        F.when((F.col("doc_id") % 5 == 0) & first, 1).alias("outline_level"), F.lit(True).alias("direct"), F.when(first, 16.0).otherwise(10.0 + F.col("line_no") % 3).cast("double").alias("size_pt"),
        F.when(F.col("doc_id") % 2 == 0, 700).otherwise(400).alias("weight"), (F.upper("line") == F.col("line")).alias("all_caps"), first.alias("keep_with_next"),
    )
    return infer.heading_candidates(rows).select("doc_id", F.col("node_id").alias("line_no"), "chosen", F.col("level").cast("long").alias("level"), F.round("score", 6).alias("score"))


@query(
    "q55_restatement_fold",
    f"""WITH RECURSIVE q AS (SELECT doc_id, max(quality)::DOUBLE AS quality FROM labels GROUP BY doc_id),
    u AS (SELECT lang, md5({_NORM}) AS unit, line, coalesce(quality, 0.5)::DOUBLE AS authority, (length(line) % 10)::DOUBLE AS confidence, row_number() OVER (PARTITION BY lang, {_NORM} ORDER BY l.doc_id, line_no) AS n
      FROM ({_LINES}) l LEFT JOIN q ON l.doc_id = q.doc_id),
    f AS (SELECT lang, unit, n, line, authority, confidence FROM u WHERE n = 1
      UNION ALL SELECT u.lang, u.unit, u.n, CASE WHEN u.authority > f.authority OR (u.authority = f.authority AND u.confidence > f.confidence) THEN u.line ELSE f.line END, greatest(f.authority, u.authority), greatest(f.confidence, u.confidence)
      FROM f JOIN u ON u.lang = f.lang AND u.unit = f.unit AND u.n = f.n + 1)
    SELECT lang, unit, md5(line) AS text, authority, confidence, n AS n_units FROM f QUALIFY row_number() OVER (PARTITION BY lang, unit ORDER BY n DESC) = 1""",
)
def restatement_fold(spark, d):
    quality = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    docs = table(spark, d, "documents").join(quality, "doc_id", "left").withColumn("authority", F.coalesce("quality", F.lit(0.5)))
    units = L.lines(docs, "lang", "authority").withColumn("unit", F.md5(T.normalize_unit(F.col("line")))).select("lang", "unit", "doc_id", "line_no", F.col("line").alias("text"), "authority", (F.length("line") % 10).cast("double").alias("confidence"))
    return dedup.fold_restatements(units, ["lang", "unit"], ["doc_id", "line_no"]).select("lang", "unit", F.md5("text").alias("text"), "authority", "confidence", "n_units")


_OPINION_SQL = _signal_sql().partition("SELECT doc_id, CASE WHEN total = 0")[0].rstrip()


@query(
    "q56_role_opinions",
    f"""{_OPINION_SQL}, o AS (SELECT doc_id, CASE WHEN max(toxic) > 0 THEN 'policy' ELSE 'guide' END AS opinion FROM labels GROUP BY doc_id),
    ruled AS (SELECT doc_id, CASE WHEN total = 0 OR margin < {classify.TIE} THEN 'unknown' ELSE role END AS role FROM best),
    shares AS (SELECT doc_id, max(share) AS first, max(CASE WHEN role = opinion THEN share END) AS own, min(opinion) AS opinion FROM ranked LEFT JOIN o USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN own > 0 AND first - own < {classify.MARGIN} AND opinion <> role THEN opinion ELSE role END AS role, CASE WHEN own > 0 AND first - own < {classify.MARGIN} AND opinion <> role THEN 'model' ELSE 'rule' END AS decided_by FROM ruled JOIN shares USING (doc_id)""",
)
def role_opinions(spark, d):
    cut = F.split("text", "\n")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("body"), "n_chars", F.slice(cut, 1, 1).alias("headings"), F.size(cut).alias("n_lines"), F.lit("").alias("path"))
    said = table(spark, d, "labels").groupBy("doc_id").agg(F.when(F.max("toxic") > 0, "policy").otherwise("guide").alias("opinion"))
    return classify.apply_opinion(classify.classify(docs, _SIGNALS), said).select("doc_id", "role", "decided_by")


@query(
    "q57_merge_decisions",
    f"""WITH RECURSIVE s AS (SELECT *, a % 4 = b % 4 AS same, (a + b) % 8 = 0 AS turned FROM ({_CAPPED}) WHERE n <= 24),
    c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY n) AS n, CASE WHEN turned THEN b ELSE a END AS a, CASE WHEN turned THEN a ELSE b END AS b FROM s WHERE same AND a % 3 = b % 3),
    f AS (
      SELECT label, n, [b] AS gone, a AS kept, b AS absorbed, true AS merged FROM c WHERE n = 1
      UNION ALL
      SELECT c.label, c.n, CASE WHEN list_contains(f.gone, c.a) OR list_contains(f.gone, c.b) THEN f.gone ELSE list_append(f.gone, c.b) END, c.a, c.b, NOT (list_contains(f.gone, c.a) OR list_contains(f.gone, c.b))
      FROM f JOIN c ON c.label = f.label AND c.n = f.n + 1)
    SELECT CAST(label AS VARCHAR) AS category, CAST(kept AS VARCHAR) AS kept, CAST(absorbed AS VARCHAR) AS absorbed FROM f WHERE merged""",
)
def merge_decisions(spark, d):
    """The compiler's semantic merging over the vectors: units whose text says a number, answers that
    merge some of the shortlist and turn some of it, and the veto on numbers that differ."""
    vectors = table(spark, d, "embeddings").where("vec_id is not null and label is not null")
    name = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    units = vectors.select(name("vec_id").alias("unit_id"), F.col("label").cast("string").alias("category"), F.lit(None).cast("string").alias("entity_key"), F.concat(F.lit("Keep "), (F.col("vec_id") % 3).cast("string"), F.lit(" of "), "vec_id").alias("text"), F.col("vec_id").alias("first"))
    salient = units.withColumn("text", F.regexp_replace("text", " of .*$", " items"))
    pairs = written(dedup.shortlist(salient, vectors.select(name("vec_id").alias("unit_id"), "embedding"), 0.25), "shortlist")
    number = lambda c: F.col(c).cast("long")
    # The texts of a pair that isn't vetoed are equal: what survives is told by a mark, then taken away.
    marked = pairs.withColumn("text_b", F.concat("text_b", F.lit(" ")))
    answers = marked.select("a", "b", (number("a") % 4 == number("b") % 4).alias("same_fact"), F.when((number("a") + number("b")) % 8 == 0, F.col("text_b")).otherwise(F.col("text_a")).alias("surviving_text"))
    decided = dedup.decide(marked, answers)
    done = dedup.absorb(decided.where("state = 'merge'"))
    return done.select("category", F.col("kept").cast("long").cast("string").alias("kept"), F.col("absorbed").cast("long").cast("string").alias("absorbed"))


# Layout and likeness


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(lengths: pd.Series) -> pd.Series:
    """Where each word of a line starts, from the words' lengths, one space between."""
    return lengths.map(lambda n: np.cumsum(n + 1, dtype=np.int32) - n - 1)


@query("q58_page_lines", f"SELECT doc_id, count(*) AS n_lines, sha256(string_agg({_FLAT}, chr(10) ORDER BY line_no)) AS digest FROM ({_LINES}) GROUP BY doc_id")
def page_lines(spark, d):
    """Each word a text run on a page, forty lines to a page: runs to lines again."""
    words = F.filter(F.split(F.trim(T.collapse(F.col("line"), T.TREE_SPACE)), " "), lambda w: w != "")
    # Dealt out before they become runs: what is shuffled is the texts.
    rows = _lines(spark, d).select("doc_id", "lines").repartition("doc_id").select("doc_id", F.posexplode("lines").alias("n", "line")).withColumn("words", words)
    runs = rows.select("doc_id", "n", F.explode(F.arrays_zip(F.col("words").alias("w"), _starts(F.transform("words", F.length)).alias("at"))).alias("r"))
    placed = runs.select(F.col("doc_id").cast("string").alias("doc_id"), F.floor(F.col("n") / 40).cast("int").alias("page"), F.lit(0).alias("column"), F.lit(1e6).alias("page_width"), F.lit(800.0).alias("page_height"), F.col("r.w").alias("text"), (F.col("r.at") * 5.0).alias("x"), (100.0 + F.col("n") % 40 * 12).cast("double").alias("y"), (F.length("r.w") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit("F").alias("font"))
    placed.whole_documents = True
    found = layout.lines(placed)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "\n")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), hashing.sha256_hex(text).alias("digest")).select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "digest")


@query(
    "q59_tree_likeness",
    f"SELECT doc_id, round(1 - 2.0 * k / (2 + 4 * n - 2 * k), 6)::DOUBLE AS structural FROM (SELECT doc_id, count(*) AS n, least(doc_id % 3, count(*) - 1) AS k FROM ({_LINES}) GROUP BY doc_id)",
)
def tree_likeness(spark, d):
    """Each page against itself without its first paragraphs: an edit distance that is known."""
    own = _lines(spark, d)
    fewer = own.withColumn("lines", F.slice("lines", F.least(F.col("doc_id") % 3, F.size("lines") - 1).cast("int") + 1, F.size("lines")))
    shape = lambda x: F.concat(F.lit("<p>"), T.escape_html(x), F.lit("</p>"))
    read = lambda rows: html.read_html(rows.select("doc_id", F.array_join(F.transform("lines", shape), "").alias("html")), "doc_id", "html")
    a, b = fidelity.post_order(read(own)), fidelity.post_order(read(fewer)).select("doc_id", F.col("labels").alias("lb"), F.col("parents").alias("pb"))
    return a.join(b, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.round(fidelity.structural_similarity("labels", "parents", "lb", "pb"), 6).alias("structural"))


def _f1_sql(total: str, missed: str) -> str:
    return f"SELECT doc_id, {total} AS expected, {total} - {missed} AS matched, round(({total} - {missed}) / ({total})::DOUBLE, 6) AS f1 FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i FROM ({_LINES})) GROUP BY doc_id"


@query("q60_table_likeness", _f1_sql("2 * count(*)", "count(*) FILTER (WHERE i % 4 = 0)"))
def table_likeness(spark, d):
    """Lines as tables of two columns, against the same with every fourth text changed."""
    row = lambda x, i, more: F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit("</td><td>"), T.escape_html(x), more, F.lit("</td></tr>"))

    def cells(changed: bool):
        body = F.transform("lines", lambda x, i: row(x, i, F.when(F.lit(changed) & (i % 4 == 0), "!").otherwise("")))
        pages = _lines(spark, d).select("doc_id", F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>")).alias("html"))
        return tree.table_cells(html.read_html(pages, "doc_id", "html")).withColumnRenamed("doc_id", "pair_id")

    out = fidelity.table_scores(cells(False), cells(True))
    return out.select(F.col("pair_id").cast("long").alias("doc_id"), "expected", "matched", F.round("f1", 6).alias("f1"))


@query("q61_span_likeness", _f1_sql("count(*)", "count(*) FILTER (WHERE i % 3 = 0)"))
def span_likeness(spark, d):
    """Lines in bold, against the same with every third in italics."""

    def spans(changed: bool):
        mark = lambda x, i: F.when(F.lit(changed) & (i % 3 == 0), F.concat(F.lit("<p><em>"), T.escape_html(F.trim(x)), F.lit("</em></p>"))).otherwise(F.concat(F.lit("<p><strong>"), T.escape_html(F.trim(x)), F.lit("</strong></p>")))
        return tree.inline_spans(_nodes(spark, d, mark)).withColumnRenamed("doc_id", "pair_id")

    out = fidelity.span_scores(spans(False), spans(True))
    return out.select(F.col("pair_id").cast("long").alias("doc_id"), "expected", "matched", F.round("f1", 6).alias("f1"))
