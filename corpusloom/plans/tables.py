"""Queries over events, conversations, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conflicts, dedup, fidelity, lines as L, slugs
from ..sources import html as H
from .corpus import _LINES
from .registry import query, table


@query(
    "q06_nearest_preceding",
    """SELECT conv_id, turn, CAST(u_turn AS BIGINT) AS user_turn, CAST(u_len AS BIGINT) AS user_chars FROM (
      SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS u_turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS u_len
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'""",
)
def nearest_preceding(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    out = L.nearest_preceding(rows, ["conv_id"], ["turn"], F.col("role") == "user", user_turn=F.col("turn"), user_chars=F.col("n"))
    return out.where("role = 'assistant'").select("conv_id", "turn", "user_turn", "user_chars")


@query(
    "q07_level_skips",
    """SELECT event_id, user_id, round(value - before, 6) AS jump FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value > before + 1""",
)
def level_skips(spark, d):
    out = L.level_skips(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", "user_id", F.round(F.col("value") - F.col("before"), 6).alias("jump"))


@query(
    "q09_islands",
    """SELECT user_id, island, min(event_type) AS event_type, count(*) AS n, min_by(event_id, (ts, event_id)) AS first_event, max_by(event_id, (ts, event_id)) AS last_event FROM (
      SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (
        SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events))
    GROUP BY user_id, island""",
)
def islands(spark, d):
    rows = L.islands(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    at = F.struct("ts", "event_id")
    return rows.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).select(
        "user_id", "island", "event_type", "n", F.col("a.event_id").alias("first_event"), F.col("b.event_id").alias("last_event")
    )


_COSINE = "round(list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))), 6)"
_CAPPED = f"""SELECT label, a, b, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, a, b) AS n FROM (
      SELECT p.label, p.vec_id AS a, q.vec_id AS b, {_COSINE} AS s FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) p JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) q ON p.label = q.label AND p.vec_id < q.vec_id) WHERE s >= 0.25"""


@query("q10_near_pairs", f"SELECT CAST(label AS BIGINT) AS label, a, b, s AS similarity, n AS rank FROM ({_CAPPED}) WHERE n <= 24")
def near_pairs(spark, d):
    pairs = dedup.capped_pairs(dedup.similar_pairs(table(spark, d, "embeddings"), 0.25))
    return pairs.select(F.col("category_a").alias("label"), "a", "b", "similarity", F.col("rank").cast("long").alias("rank"))


@query(
    "q12_cross_category_pairs",
    f"""SELECT CAST(least(x, y) AS BIGINT) AS label_a, CAST(greatest(x, y) AS BIGINT) AS label_b, count(*) AS n_pairs, max(s) AS best FROM (
      SELECT p.label AS x, q.label AS y, {_COSINE} AS s FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) p JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) q ON p.label <> q.label AND p.vec_id < q.vec_id) WHERE s >= 0.3
    GROUP BY least(x, y), greatest(x, y)""",
)
def cross_category_pairs(spark, d):
    pairs = dedup.similar_pairs(table(spark, d, "embeddings"), 0.3, across=True)
    return pairs.groupBy(F.least("category_a", "category_b").alias("label_a"), F.greatest("category_a", "category_b").alias("label_b")).agg(F.count("*").alias("n_pairs"), F.max("similarity").alias("best"))


@query(
    "q31_greedy_absorption",
    f"""WITH RECURSIVE c AS (SELECT * FROM ({_CAPPED}) WHERE n <= 24),
    f AS (
      SELECT label, n, [b] AS gone, a AS kept, b AS absorbed, true AS merged FROM c WHERE n = 1
      UNION ALL
      SELECT c.label, c.n, CASE WHEN list_contains(f.gone, c.a) OR list_contains(f.gone, c.b) THEN f.gone ELSE list_append(f.gone, c.b) END, c.a, c.b, NOT (list_contains(f.gone, c.a) OR list_contains(f.gone, c.b))
      FROM f JOIN c ON c.label = f.label AND c.n = f.n + 1)
    SELECT CAST(label AS BIGINT) AS label, kept, absorbed FROM f WHERE merged""",
)
def greedy_absorption(spark, d):
    pairs = dedup.capped_pairs(dedup.similar_pairs(table(spark, d, "embeddings"), 0.25))
    return dedup.absorb(pairs).select(F.col("category").alias("label"), "kept", "absorbed")


@query(
    "q15_conflicts",
    """SELECT user_id, k, count(DISTINCT event_type) AS n_values, count(DISTINCT CAST(ts AS DATE)) AS n_paths, count(*) AS n_units,
      CASE WHEN count(DISTINCT event_type) = 1 THEN 'agreement' WHEN count(DISTINCT CAST(ts AS DATE)) = 1 THEN 'sequence' ELSE 'conflict' END AS verdict, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS entity_values
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id, k""",
)
def conflict_groups(spark, d):
    events = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", F.to_date("ts").alias("day"))
    return conflicts.entity_groups(events, ["user_id", "k"], "event_type", "day").select("user_id", "k", "n_values", "n_paths", "n_units", "verdict", F.array_join("values", "|").alias("entity_values"))


@query(
    "q36_source_authority",
    """SELECT year(ts) AS year, month(ts) AS month, count(*) AS n, round(greatest(0.25, least(0.85, 0.3 + (year(ts) + month(ts) / 12.0::DOUBLE - 2020) * 0.05)), 6) AS authority FROM events GROUP BY ALL""",
)
def source_authority(spark, d):
    rows = table(spark, d, "events").select(F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month"), T.authority(F.col("ts")).alias("authority"))
    return rows.groupBy("year", "month").agg(F.count("*").alias("n"), F.round(F.max("authority"), 6).alias("authority"))


@query(
    "q23_unique_slugs",
    r"""SELECT page_id, lang, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM (
      SELECT page_id, lang, s, row_number() OVER (PARTITION BY lang, s ORDER BY page_id) AS n FROM (
        SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, CASE WHEN x = '' THEN 'section' ELSE x END AS s FROM (
          SELECT page_id, html, regexp_replace(trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9\s-]+', '', 'g')), '[\s-]+', '-', 'g') AS x FROM pages)))""",
)
def unique_slugs(spark, d):
    meta = H.metadata(table(spark, d, "pages"))
    return slugs.unique(meta.select("page_id", "lang", T.slug(F.col("title")).alias("base")), "lang", "page_id", "base").select("page_id", "lang", "slug")


@query("q24_tag_census", "SELECT type, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([[:alpha:]][[:alnum:]]*)', 1))) AS type FROM pages) GROUP BY type")
def tag_census(spark, d):
    tags = H.tags(table(spark, d, "pages"))
    per_page = fidelity.census(tags, "page_id")
    return per_page.groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("n_pages"))


@query(
    "q25_page_metadata",
    """SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta[^>]*charset="([^"]*)"', 1) AS charset FROM pages""",
)
def page_metadata(spark, d):
    return H.metadata(table(spark, d, "pages")).select("page_id", "title", "lang", "charset")


@query(
    "q26_visible_text",
    r"""SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style|head)\b[^>]*>.*?</(?:script|style|head)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)""",
)
def visible_text(spark, d):
    t = H.visible_text(F.col("html"))
    return table(spark, d, "pages").withColumn("t", t).select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(
    "q27_census_delta",
    """WITH c AS (SELECT page_id, type, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([[:alpha:]][[:alnum:]]*)', 1))) AS type FROM pages) GROUP BY page_id, type),
    p AS (SELECT page_id FROM pages WHERE page_id + 1 IN (SELECT page_id FROM pages)),
    a AS (SELECT page_id, type, n FROM c JOIN p USING (page_id)), b AS (SELECT page_id - 1 AS page_id, type, n FROM c WHERE page_id - 1 IN (SELECT page_id FROM p))
    SELECT page_id, type, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (page_id, type) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def census_delta(spark, d):
    counts = fidelity.census(H.tags(table(spark, d, "pages")), "page_id")
    pages = table(spark, d, "pages").select("page_id")
    both = pages.join(pages.select((F.col("page_id") - 1).alias("page_id")), "page_id", "left_semi")
    a = counts.join(both, "page_id", "left_semi")
    b = counts.withColumn("page_id", F.col("page_id") - 1).join(both, "page_id", "left_semi")
    return fidelity.census_delta(a, b, ["page_id"]).select("page_id", "type", "a", "b", "delta")


def _salient_sql(c: str) -> str:
    stem = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, 'ies$', 'y'), '(ss|x|ch|sh)es$', '\\1'), '([^s])s$', '\\1'), '([a-z]{{3}})(ing|ed)$', '\\1')"
    numbers = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.NUMBERS.items()) + " ELSE CASE WHEN regexp_matches(w, '^[0-9]+$') THEN regexp_replace(w, '^0+([0-9])', '\\1') ELSE w END END"
    keep = ", ".join(f"'{x}'" for x in sorted({*T.SCOPE_WORDS, *map(T._stem_plain, T.SCOPE_WORDS), *T.UNITS}))
    bare = f"[regexp_replace(w, '^[.-]+|[.-]+$', '', 'g') for w in regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9_.\\- ]', ' ', 'g'), ' +')]"
    named = f"[{numbers} for w in {bare}]"
    return f"list_sort(list_distinct([CASE WHEN regexp_matches(w, '[0-9_]') THEN w ELSE {stem('w')} END for w in {named} if regexp_matches(w, '[0-9_]') OR {stem('w')} IN ({keep})]))"


@query(
    "q34_merge_verdicts",
    f"""WITH l AS (SELECT doc_id, line_no, {_salient_sql('line')} AS x FROM ({_LINES})),
    p AS (SELECT doc_id, line_no, x, lead(x) OVER (PARTITION BY doc_id ORDER BY line_no) AS y FROM l)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN x <> y THEN 'block' WHEN len(x) = 0 THEN 'abstain' ELSE 'allow' END AS verdict FROM p WHERE y IS NOT NULL""",
)
def merge_verdicts(spark, d):
    """Of a document's lines each with the next: both stand in one row, so that nothing is shuffled
    and each line's tokens are found once."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("line_no"), x.alias("line")))
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.filter(numbered, lambda e: F.trim(e["line"]) != "").alias("lines"))
    own = lines.select("doc_id", F.transform("lines", lambda e: F.struct(e["line_no"].alias("line_no"), T.salient_tokens(e["line"]).alias("t"))).alias("own"))
    pairs = own.select("doc_id", F.explode(F.arrays_zip(F.col("own").alias("x"), F.slice("own", F.lit(2), F.greatest(F.size("own"), F.lit(1))).alias("y"))).alias("p")).where("p.y is not null")
    return pairs.select("doc_id", "p.x.line_no", T.token_verdict(F.col("p.x.t"), F.col("p.y.t")).alias("verdict"))


@query("q39_page_node_census", None)
def page_node_census(spark, d):
    """Nodes of all pages by type, from the tree parser."""
    return fidelity.census(H.read_html(table(spark, d, "pages"))).select("type", "n")


@query("q40_page_markdown", None)
def page_markdown(spark, d):
    """Every page converted to Markdown."""
    from ..sinks import markdown

    out = markdown.render(H.read_html(table(spark, d, "pages")))
    return out.select(F.col("doc_id").cast("long").alias("page_id"), F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("digest"))


@query("q41_round_trip_fidelity", "SELECT doc_id, 1.0::DOUBLE AS structural, 1.0::DOUBLE AS text, 1.0::DOUBLE AS table_f1, 1.0::DOUBLE AS span_f1 FROM documents WHERE text IS NOT NULL")
def round_trip_fidelity(spark, d):
    """Documents as Markdown, rendered and read again: every measure of likeness must be whole."""
    from ..api import METRICS, compare
    from ..sinks import markdown as sink
    from ..sources.markdown import read_markdown

    first = read_markdown(table(spark, d, "documents").where("text is not null"))
    second = read_markdown(sink.render(first), column="rendered")
    return compare(first, second).select(F.col("doc_id").cast("long").alias("doc_id"), *(F.round(m, 6).alias(m) for m in METRICS))


@query("q43_page_audits", "SELECT * FROM (VALUES ('repeated node id', CAST(0 AS BIGINT)), ('not nested', 0), ('misplaced child', 0)) t(\"check\", n)")
def page_audits(spark, d):
    from ..operators import tree

    return tree.audit(H.read_html(table(spark, d, "pages")))
