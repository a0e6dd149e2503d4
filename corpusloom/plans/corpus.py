"""Queries over the documents, labels and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, text as T
from ..operators import budget, classify, conflicts, dedup, gates, lines as L, verify
from .registry import query, table

_LINES = """SELECT doc_id, lang, source, line, line_no FROM (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
) WHERE trim(line) <> ''"""
_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_NORM = f"trim(regexp_replace(trim(regexp_replace(lower(nfc_normalize(line)), '{_SPACE}', ' ', 'g')), '[.;:,]+$', ''))"
_TREE = r"[ \t\r\n\f\v]+"


@query(
    "q01_text_content",
    rf"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS digest
    FROM (SELECT doc_id, trim(regexp_replace(text, '{_TREE}', ' ', 'g')) AS t FROM documents)""",
)
def text_content(spark, d):
    docs = table(spark, d, "documents").withColumn("t", L.text_content(F.col("text")))
    return docs.select("doc_id", F.length("t").cast("long").alias("n_chars"), hashing.sha256_hex(F.col("t")).alias("digest"))


@query(
    "q02_unit_tokens",
    f"""SELECT lang, count(*) AS n_lines, CAST(sum(CAST(ceil(length(line) / 3.8::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens, count(DISTINCT {_NORM}) AS n_distinct
    FROM ({_LINES}) GROUP BY lang""",
)
def unit_tokens(spark, d):
    rows = L.lines(table(spark, d, "documents"), "lang").withColumn("unit", F.md5(T.normalize_unit(F.col("line"))))
    # Distinct by 128 bits of hash: the texts themselves need not be shuffled.
    return rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(T.count_tokens(F.col("line"))).alias("tokens"), F.count_distinct("unit").alias("n_distinct"))


@query(
    "q03_restatement_dedup",
    f"""SELECT u.lang, md5({_NORM}) AS unit, min(u.doc_id) AS doc_id, min(line_no) FILTER (WHERE u.doc_id = first_doc) AS line_no, count(*) AS n_units,
      CAST(max(coalesce(quality, 0.5)) AS DOUBLE) AS authority, count(DISTINCT u.doc_id) AS n_sources
    FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, {_NORM}) AS first_doc FROM ({_LINES})) u LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON u.doc_id = q.doc_id
    GROUP BY u.lang, {_NORM}""",
)
def restatement_dedup(spark, d):
    quality = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    # Labels join the documents, before these become ten times as many lines.
    docs = table(spark, d, "documents").join(quality, "doc_id", "left").withColumn("authority", F.coalesce("quality", F.lit(0.5)))
    units = L.lines(docs, "lang", "authority").withColumn("unit", F.md5(T.normalize_unit(F.col("line")))).withColumn("line_no", F.col("line_no").cast("long"))
    found = dedup.restatement_counts(units, ["lang", "unit"], ["doc_id", "line_no"])
    return found.select("lang", "unit", "first.doc_id", "first.line_no", "n_units", "authority", "n_sources")


_SIGNALS = (
    classify.Signal("contract", "body", 1, r"@|http"),
    classify.Signal("contract", "structure", 2, "n_chars", 4000),
    classify.Signal("guide", "body", 1, r"with|avec"),
    classify.Signal("guide", "structure", 3, "n_lines", 5),
    classify.Signal("notes", "body", 1, r" und | der "),
    classify.Signal("notes", "heading", 2, r"de|la"),
    classify.Signal("policy", "body", 2, r"copyright|rights reserved"),
    classify.Signal("policy", "heading", 1, r"of"),
    classify.Signal("reference", "body", 2, r"licen[cs]e"),
    classify.Signal("reference", "heading", 1, r"the"),
)


def _signal_sql() -> str:
    def hit(s):
        if s.kind == "heading":
            return f"CASE WHEN regexp_matches(lower(h), '{s.pattern}') THEN {s.weight} ELSE 0 END"
        if s.kind == "body":
            return f"CASE WHEN regexp_matches(lower(text), '{s.pattern}') THEN {s.weight} ELSE 0 END"
        return f"CASE WHEN {s.pattern} >= {s.least} THEN {s.weight} ELSE 0 END"

    roles = sorted({s.role for s in _SIGNALS})
    scored = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS role, CAST({' + '.join(hit(s) for s in _SIGNALS if s.role == r)} AS DOUBLE) AS score FROM docs" for r in roles)
    return f"""WITH docs AS (SELECT doc_id, text, n_chars, string_split(text, chr(10))[1] AS h, len(string_split(text, chr(10))) AS n_lines FROM documents),
    scored AS ({scored}),
    ranked AS (SELECT doc_id, role, score / sum(score) OVER (PARTITION BY doc_id) AS share, sum(score) OVER (PARTITION BY doc_id) AS total,
      row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, role) AS n FROM scored),
    best AS (SELECT doc_id, max(CASE WHEN n = 1 THEN role END) AS role, CASE WHEN max(total) = 0 THEN 1.0 ELSE max(CASE WHEN n = 1 THEN share END) - max(CASE WHEN n = 2 THEN share END) END AS margin, max(total) AS total FROM ranked GROUP BY doc_id)
    SELECT doc_id, CASE WHEN total = 0 OR margin < {classify.TIE} THEN 'unknown' ELSE role END AS role, CAST(round(margin, 6) AS DOUBLE) AS margin FROM best"""


@query("q04_role_classification", _signal_sql())
def role_classification(spark, d):
    cut = F.split("text", "\n")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("body"), "n_chars", F.slice(cut, 1, 1).alias("headings"), F.size(cut).alias("n_lines"), F.lit("").alias("path"))
    return classify.classify(docs, _SIGNALS).select("doc_id", "role", F.round("margin", 6).alias("margin"))


@query(
    "q05_budget_fill",
    """WITH RECURSIVE u AS (
      SELECT source, doc_id, tokens, row_number() OVER (PARTITION BY source ORDER BY value DESC, doc_id) AS n FROM (
        SELECT d.source, d.doc_id, CAST(ceil(n_chars / 3.8::DOUBLE) AS BIGINT) AS tokens,
          1.0::DOUBLE * (0.4::DOUBLE + 0.3::DOUBLE * coalesce(quality, 0.5::DOUBLE) + 0.2::DOUBLE * (1 - coalesce(toxic, 0::DOUBLE)) + 0.1::DOUBLE * 0.0::DOUBLE) AS value
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS quality, max(toxic)::DOUBLE AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)
    ), f AS (
      SELECT source, doc_id, n, tokens, CASE WHEN tokens <= 4000 THEN 'primary' WHEN tokens <= 24000 THEN 'secondary' ELSE 'dropped' END AS place,
        CASE WHEN tokens <= 4000 THEN tokens ELSE 0 END AS p, CASE WHEN tokens > 4000 AND tokens <= 24000 THEN tokens ELSE 0 END AS s FROM u WHERE n = 1
      UNION ALL
      SELECT u.source, u.doc_id, u.n, u.tokens, CASE WHEN f.p + u.tokens <= 4000 THEN 'primary' WHEN f.s + u.tokens <= 24000 THEN 'secondary' ELSE 'dropped' END,
        CASE WHEN f.p + u.tokens <= 4000 THEN f.p + u.tokens ELSE f.p END,
        CASE WHEN f.p + u.tokens > 4000 AND f.s + u.tokens <= 24000 THEN f.s + u.tokens ELSE f.s END
      FROM f JOIN u ON u.source = f.source AND u.n = f.n + 1
    ) SELECT source, doc_id, tokens, place FROM f""",
)
def budget_fill(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    value = budget.value_of(F.lit(1.0), F.coalesce("quality", F.lit(0.5)), 1 - F.coalesce("toxic", F.lit(0.0)), F.lit(1))
    units = docs.select("source", "doc_id", F.ceil(F.col("n_chars").cast("double") / F.lit(3.8)).cast("long").alias("tokens"), value.alias("value"), F.lit("all").alias("section"), F.lit(None).cast("int").alias("max_units"))
    return budget.fill(units, "source", [F.desc("value"), "doc_id"], 4000, 24000).select("source", "doc_id", "tokens", "place")


@query(
    "q08_line_occurrence",
    f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, row_number() OVER (PARTITION BY doc_id, {_NORM} ORDER BY line_no) - 1 AS occurrence FROM ({_LINES})""",
)
def line_occurrence(spark, d):
    rows = L.lines(table(spark, d, "documents")).withColumn("unit", F.md5(T.normalize_unit(F.col("line"))))
    return L.occurrences(rows.select("doc_id", "line_no", "unit"), ["doc_id", "unit"], ["line_no"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("occurrence").cast("long").alias("occurrence"))


_WORDS = "[w for w in regexp_split_to_array(lower({0}), '[^a-z0-9]+') if w <> '']"


@query(
    "q11_contamination",
    f"""WITH d AS (SELECT doc_id, text, {_WORDS.format('text')} AS ws FROM documents), i AS (SELECT item_id, text, {_WORDS.format('text')} AS ws FROM benchmark),
    dg AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 6], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 5)) AS p FROM d WHERE len(ws) >= 6)),
    ig AS (SELECT DISTINCT item_id, array_to_string(ws[p + 1 : p + 6], ' ') AS g FROM (SELECT item_id, ws, unnest(range(len(ws) - 5)) AS p FROM i WHERE len(ws) >= 6)),
    hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_shared, contains(d.text, i.text) AS verbatim FROM hits JOIN d USING (doc_id) JOIN i USING (item_id)""",
)
def contamination(spark, d):
    return gates.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


_SECTIONS = [("core", 0, ["de", "en"], 1.5, None), ("romance", 1, ["fr", "en", "it"], 1.0, None)]


@query(
    "q13_route_and_order",
    """WITH s AS (SELECT * FROM (VALUES ('core', 0, 0, 'de'), ('core', 0, 1, 'en'), ('romance', 1, 0, 'fr'), ('romance', 1, 1, 'en'), ('romance', 1, 2, 'it')) t(section, si, ci, lang)),
    f AS (SELECT lang, section, si, ci, row_number() OVER (PARTITION BY lang ORDER BY si, ci) AS n FROM s)
    SELECT doc_id, section, row_number() OVER (PARTITION BY section ORDER BY si, ci, source, doc_id) AS position
    FROM documents d LEFT JOIN (SELECT * FROM f WHERE n = 1) f ON d.lang = f.lang""",
)
def route_and_order(spark, d):
    sections = spark.createDataFrame(_SECTIONS, budget.SECTIONS)
    routed = budget.route(table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("category")), sections)
    return budget.unit_order(routed, ["section"], "source", "doc_id").select("doc_id", "section", F.col("position").cast("long").alias("position"))


@query(
    "q14_word_set_jaccard",
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS block, list_distinct({_WORDS.format('text')}) AS ws FROM documents)
    SELECT a, b, round(j, 6) AS jaccard FROM (
      SELECT p.doc_id AS a, q.doc_id AS b, CAST(len(list_intersect(p.ws, q.ws)) AS DOUBLE) / (len(p.ws) + len(q.ws) - len(list_intersect(p.ws, q.ws))) AS j
      FROM d p JOIN d q ON p.block = q.block AND p.doc_id < q.doc_id WHERE len(p.ws) > 0 AND len(q.ws) > 0
    ) WHERE j >= 0.3 - 1e-9""",
)
def word_set_jaccard(spark, d):
    own = table(spark, d, "documents").where("text is not null").select("doc_id", "text").repartition("doc_id")
    docs = own.select("doc_id", F.md5(F.element_at(F.split("text", "\n"), 1)).alias("block"), F.array_distinct(T.words(F.col("text"))).alias("words"))
    return gates.similar_in_block(docs, "block", "words", 0.3).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    "q16_furniture",
    r"""WITH p AS (SELECT source, doc_id, trim(regexp_replace(lower(regexp_replace(string_split(text, chr(10))[-1], '[0-9]+', '#', 'g')), '[ \t\r\n\f\v]+', ' ', 'g')) AS shape FROM documents),
    t AS (SELECT source, count(DISTINCT doc_id) AS pages FROM p GROUP BY source)
    SELECT p.source, shape, count(DISTINCT doc_id) AS support, max(pages) AS pages FROM p JOIN t USING (source) GROUP BY p.source, shape
    HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= ceil(max(pages) * 0.1::DOUBLE)""",
)
def furniture(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("source", "doc_id", F.element_at(F.split("text", "\n"), -1).alias("line"))
    return gates.furniture(docs, "source", "doc_id", "line", ratio=0.1).select("source", "shape", "support", "pages")


_UNIT_NORM = f"trim(regexp_replace(trim(regexp_replace(lower({{0}}), '{_SPACE}', ' ', 'g')), '[.;:,]+$', ''))"


@query(
    "q17_fragment_containment",
    f"""WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS text, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id END AS claim FROM documents)
    SELECT f.doc_id AS fragment_id, CASE WHEN d.doc_id IS NULL THEN 'no-unit' WHEN contains({_UNIT_NORM.replace('{0}', 'd.text')}, {_UNIT_NORM.replace('{0}', 'f.text')}) THEN 'contained' ELSE 'not-contained' END AS status
    FROM f LEFT JOIN documents d ON d.doc_id = f.claim""",
)
def fragment_containment(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    claim = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).when(F.col("doc_id") % 7 == 0, F.lit(-1)).otherwise(F.col("doc_id"))
    fragments = docs.select(F.col("doc_id").alias("fragment_id"), F.element_at(F.split("text", "\n"), 1).alias("text"), F.array(claim).alias("unit_ids"))
    return verify.check_fragments(fragments, docs.select(F.col("doc_id").alias("unit_id"), "text"))


@query(
    "q18_interval_coverage",
    """WITH l AS (SELECT doc_id, line, seg, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seg) - length(line) - 1 AS start
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS seg FROM documents)),
    f AS (SELECT doc_id, i * 300 AS start, i * 300 + 200 AS stop FROM (SELECT doc_id, unnest(range((length(text) + 299) // 300)) AS i FROM documents))
    SELECT l.doc_id, CAST(l.seg AS BIGINT) AS seg, count(f.doc_id) AS n_fragments FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND f.start < l.start + length(line) AND f.stop > l.start
    WHERE length(line) > 0 GROUP BY l.doc_id, l.seg""",
)
def interval_coverage(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    segments = verify.line_segments(docs)
    n = F.floor((F.length("text") + 299) / 300).cast("long")
    spans = docs.where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i")).select("doc_id", (F.col("i") * 300).alias("start"), (F.col("i") * 300 + 200).alias("end"))
    pairs = verify.overlaps(segments, spans, ["doc_id"], 300)
    counts = pairs.groupBy("l.doc_id", "l.seg").agg(F.count("*").alias("n_fragments"))
    return segments.join(counts, ["doc_id", "seg"], "left").select("doc_id", F.col("seg").cast("long").alias("seg"), F.coalesce("n_fragments", F.lit(0)).alias("n_fragments"))


@query("q19_median_length", "SELECT lang, source, CAST(median(n_chars) AS DOUBLE) AS median_chars, count(*) AS n FROM documents GROUP BY lang, source")
def median_length(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.median("n_chars").alias("median_chars"), F.count("*").alias("n"))


@query(
    "q20_section_text",
    """SELECT lang, source, count(*) AS n_units, sha256('## ' || lang || chr(10) || chr(10) || string_agg('- ' || first || chr(10), '' ORDER BY n)) AS digest
    FROM (SELECT lang, source, string_split(text, chr(10))[1] AS first, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
    WHERE n <= 50 GROUP BY lang, source""",
)
def section_text(spark, d):
    w = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    top = table(spark, d, "documents").select("lang", "source", F.element_at(F.split("text", "\n"), 1).alias("first"), F.row_number().over(w).alias("n")).where("n <= 50")  # a section's max_units
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "first"))), lambda x: F.concat(F.lit("- "), x["first"], F.lit("\n"))), "")
    return top.groupBy("lang", "source").agg(F.count("*").alias("n_units"), body.alias("body")).select("lang", "source", "n_units", hashing.sha256_hex(F.concat(F.lit("## "), F.col("lang"), F.lit("\n\n"), F.col("body"))).alias("digest"))


@query("q22_unit_digest", """SELECT doc_id, sha256('{"category":' || to_json(lang) || ',"text":' || to_json(text) || '}') AS digest FROM documents""")
def unit_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.unit_digest(F.col("lang"), F.col("text")).alias("digest"))


@query(
    "q21_incremental_manifest",
    """WITH prev AS (SELECT d.doc_id, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS digest FROM documents d JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))
    SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN 'new' WHEN p.digest = sha256(d.text) THEN 'unchanged' ELSE 'changed' END AS state FROM documents d LEFT JOIN prev p ON d.doc_id = p.doc_id""",
)
def incremental_manifest(spark, d):
    from ..operators import manifest

    docs = table(spark, d, "documents").select("doc_id", hashing.sha256_hex(F.col("text")).alias("digest"), hashing.sha256_hex(F.concat("text", F.lit("!"))).alias("other"))
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    previous = docs.join(known, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.col("other")).otherwise(F.col("digest")).alias("digest"))
    return manifest.states(docs.select("doc_id", "digest"), previous, "doc_id", "digest").select("doc_id", "state")


@query(
    "q28_bag_scores",
    f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), i AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark),
    dg AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 6], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 5)) AS p FROM d WHERE len(ws) >= 6)),
    ig AS (SELECT DISTINCT item_id, array_to_string(ws[p + 1 : p + 6], ' ') AS g FROM (SELECT item_id, ws, unnest(range(len(ws) - 5)) AS p FROM i WHERE len(ws) >= 6)),
    pairs AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)),
    e AS (SELECT doc_id, item_id, w, count(*) AS e FROM (SELECT doc_id, item_id, unnest(ws) AS w FROM pairs JOIN i USING (item_id)) GROUP BY ALL),
    a AS (SELECT doc_id, item_id, w, count(*) AS a FROM (SELECT doc_id, item_id, unnest(ws) AS w FROM pairs JOIN d USING (doc_id)) GROUP BY ALL),
    s AS (SELECT doc_id, item_id, sum(least(coalesce(e, 0), coalesce(a, 0)))::DOUBLE AS m, sum(coalesce(e, 0)) AS e, sum(coalesce(a, 0)) AS a FROM e FULL JOIN a USING (doc_id, item_id, w) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, CAST(m AS BIGINT) AS matched, round(m / a, 6) AS precision, round(m / e, 6) AS recall, round(CASE WHEN m = 0 THEN 0 ELSE 2 * (m / a) * (m / e) / (m / a + m / e) END, 6) AS f1 FROM s""",
)
def bag_scores(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    pairs = gates.shared_ngrams(docs, items).select("doc_id", "item_id")
    bags = lambda df, key, name: df.select(key, T.words(F.col("text")).alias(name))
    rows = pairs.join(bags(items, "item_id", "expected"), "item_id").join(bags(docs, "doc_id", "actual"), "doc_id")
    out = gates.list_overlap(rows, ["doc_id", "item_id"], "expected", "actual")
    return out.select("doc_id", "item_id", "matched", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(
    "q29_baseline_regressions",
    """WITH m AS (SELECT source, lang, CAST(avg(n_chars) / 7919 AS DOUBLE) AS length, avg(CASE WHEN contains(text, '@') THEN 1.0 ELSE 0.0 END)::DOUBLE AS contact FROM documents GROUP BY source, lang),
    b AS (SELECT source, lang, CAST(avg(n_chars) / 7919 AS DOUBLE) AS length, avg(CASE WHEN contains(text, '@') THEN 1.0 ELSE 0.0 END)::DOUBLE AS contact FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source, lang),
    x AS (SELECT source, lang, 'length' AS metric, length AS value FROM m UNION ALL SELECT source, lang, 'contact', contact FROM m),
    y AS (SELECT source, lang, 'length' AS metric, length AS baseline FROM b UNION ALL SELECT source, lang, 'contact', contact FROM b)
    SELECT source, lang, metric, round(value, 6) AS value, round(baseline, 6) AS baseline,
      CASE WHEN baseline IS NULL THEN 'added' WHEN value IS NULL THEN 'missing' WHEN value < baseline - 0.005 THEN 'regression' WHEN value > baseline + 0.005 THEN 'improvement' ELSE 'same' END AS state
    FROM x FULL JOIN y USING (source, lang, metric)""",
)
def baseline_regressions(spark, d):
    from ..operators import fidelity

    docs = table(spark, d, "documents")
    measure = lambda df: df.groupBy("source", "lang").agg((F.avg("n_chars") / 7919).alias("length"), F.avg(F.contains("text", F.lit("@")).cast("double")).alias("contact"))
    base = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    out = fidelity.compare_to_baseline(measure(docs), measure(base), ["source", "lang"], ["length", "contact"])
    return out.select("source", "lang", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "state")


@query(
    "q30_diagnostics",
    """WITH d AS (
      SELECT doc_id, 'CE-TEXT-0001' AS code, 'warning' AS severity, true AS lossy FROM documents WHERE n_chars < 100
      UNION ALL SELECT doc_id, 'CE-LIC-0001', 'info', false FROM documents WHERE regexp_matches(lower(text), 'licen[cs]ed|rights reserved')
      UNION ALL SELECT doc_id, 'CE-PII-0001', 'error', true FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')
      UNION ALL SELECT doc_id, 'CE-LABEL-0001', 'info', false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
    SELECT code, severity, count(*) AS n, CAST(sum(CASE WHEN lossy THEN 1 ELSE 0 END) AS BIGINT) AS n_strict FROM d GROUP BY code, severity""",
)
def diagnostics(spark, d):
    from ..operators import diagnostics as D

    docs = table(spark, d, "documents")
    found = D.collect(
        docs.where("n_chars < 100").select("doc_id", *D.lost("CE-TEXT-0001")),
        docs.where(F.lower("text").rlike("licen[cs]ed|rights reserved")).select("doc_id", *D.info("CE-LIC-0001")),
        docs.where(F.col("text").rlike("[A-Za-z0-9._]+@[A-Za-z0-9.]+")).select("doc_id", *D.error("CE-PII-0001")),
        gates.orphans(docs, table(spark, d, "labels"), "doc_id").select("doc_id", *D.info("CE-LABEL-0001")),
    )
    return D.summary(found)


@query(
    "q32_heading_scores",
    f"""SELECT lang, kind, count(*) AS n, round(sum(score), 4) AS total FROM (
      SELECT lang, round(s, 6) AS score, CASE WHEN abs(2 * s - 1) < 0.15 THEN 'ambiguous' WHEN s > 0.5 THEN 'heading' ELSE 'paragraph' END AS kind FROM (
        SELECT lang, CASE WHEN length(line) <= 80 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN NOT regexp_matches(line, '[.!?;:,]$') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN upper(line) = line THEN 0.1::DOUBLE ELSE 0 END
          + CASE WHEN line_no = 0 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN length(line) > 200 THEN 0.4::DOUBLE ELSE 0 END AS s FROM ({_LINES})))
    GROUP BY lang, kind""",
)
def heading_scores(spark, d):
    from ..operators import infer

    rows = L.lines(table(spark, d, "documents"), "lang")
    score = infer.line_heading_score(F.col("line"), F.col("line_no"))
    return rows.select("lang", F.round(score, 6).alias("score"), infer.decision(score).alias("kind")).groupBy("lang", "kind").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_SENTENCES = r"""SELECT doc_id, lang, trim(s) AS s, pos FROM (
      SELECT doc_id, lang, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM (
        SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?]+["'')\]]*)[ \t]+([\p{Lu}0-9])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS parts FROM documents)) WHERE trim(s) <> ''"""


@query("q33_sentences", f"SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM ({_SENTENCES}) GROUP BY doc_id")
def sentences(spark, d):
    cut = table(spark, d, "documents").where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s")).where("size(s) > 0")
    return cut.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


# DuckDB's levenshtein counts bytes: each letter beyond ASCII stands for one byte that texts don't have.
_LETTERS = "óéèñüöäßêíçÉÈÑÊÇÄÖÜÓÍ"
_BYTES = " || ".join(f"chr({i})" for i in [*range(1, 9), 11, 12, *range(14, 25)])
_BYTEWISE = f"translate({{0}}, '{_LETTERS}', {_BYTES})"


@query(
    "q35_text_similarity",
    f"""WITH l AS (SELECT doc_id, line_no, line, {_WORDS.format('line')} AS ws FROM ({_LINES})),
    i AS (SELECT item_id, text, {_WORDS.format('text')} AS ws FROM benchmark),
    lg AS (SELECT DISTINCT doc_id, line_no, array_to_string(ws[p + 1 : p + 6], ' ') AS g FROM (SELECT doc_id, line_no, ws, unnest(range(len(ws) - 5)) AS p FROM l WHERE len(ws) >= 6)),
    ig AS (SELECT DISTINCT item_id, array_to_string(ws[p + 1 : p + 6], ' ') AS g FROM (SELECT item_id, ws, unnest(range(len(ws) - 5)) AS p FROM i WHERE len(ws) >= 6)),
    pairs AS (SELECT DISTINCT doc_id, line_no, item_id FROM lg JOIN ig USING (g))
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, item_id, round(1 - CAST(levenshtein({_BYTEWISE.format('line')}, {_BYTEWISE.format('i.text')}) AS DOUBLE) / greatest(length(line), length(i.text)), 6) AS similarity
    FROM pairs JOIN l USING (doc_id, line_no) JOIN i USING (item_id)""",
)
def text_similarity(spark, d):
    """Of every line and item that share a run of six words, the likeness by code points."""
    return _similar_lines(L.lines(table(spark, d, "documents")), table(spark, d, "benchmark"))


def _similar_lines(lines, items):
    rows = lines.select(F.struct("doc_id", "line_no").alias("doc_id"), F.col("line").alias("text"))
    pairs = gates.shared_ngrams(rows, items).select("doc_id", "item_id").join(rows, "doc_id").join(gates.checked_broadcast(items.select("item_id", F.col("text").alias("item"))), "item_id")
    return pairs.select("doc_id.doc_id", F.col("doc_id.line_no").cast("long").alias("line_no"), "item_id", F.round(T.text_similarity(F.col("text"), F.col("item")), 6).alias("similarity"))


@query(
    "q37_normative_sentences",
    f"""WITH s AS (SELECT doc_id, pos, s, lower(trim(regexp_replace(s, '[ \\t\\r\\f\\v]+', ' ', 'g'))) AS k FROM ({_SENTENCES})
      WHERE regexp_matches(lower(s), 'licen[sc]e|copyright|released|rights reserved') AND len([w for w in string_split(s, ' ') if w <> '']) >= 3)
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, k AS claim FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM s) WHERE n = 1""",
)
def normative_sentences(spark, d):
    from ..operators import extract

    cut = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(extract.all_sentences(F.col("text"))).alias("pos", "s")).where("s <> ''")
    return extract.first_claims(cut, F.lower("s").rlike("licen[sc]e|copyright|released|rights reserved"), least_words=3, order=["doc_id", "pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "claim")


@query(
    "q38_audits",
    """SELECT 'documents without label' AS audit, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
    UNION ALL SELECT 'labels without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL SELECT 'repeated doc_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
    UNION ALL SELECT 'wrong n_chars', count(*) FROM documents WHERE n_chars <> length(text)""",
)
def audits(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("audit"), "n")
    return (
        count("documents without label", gates.orphans(docs, labels, "doc_id"))
        .unionByName(count("labels without document", gates.orphans(labels, docs, "doc_id")))
        .unionByName(count("repeated doc_id", gates.repeated_keys(docs, "doc_id")))
        .unionByName(count("wrong n_chars", docs.where(F.col("n_chars") != F.length("text"))))
    )
