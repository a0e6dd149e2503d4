"""Structure from evidence: headings that no style names, quotes, code, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import islands

AMBIGUOUS = 0.15
DEFAULT_SIZE = 11.0
STYLE_ROLES = {
    "quote": "blockquote", "intense quote": "blockquote", "block text": "blockquote",
    "source code": "code", "html preformatted": "code", "code": "code", "verbatim": "code",
    "caption": "caption", "table caption": "caption", "image caption": "caption",
    "definition term": "descriptionTerm", "definition": "descriptionDetails",
}


def line_heading_score(line: Column, line_no: Column) -> Column:
    """Evidence that a plain line is a heading: short, no closing punctuation, capitals, first."""
    is_ = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return (
        is_(F.length(line) <= 80, 0.1) + is_(~line.rlike(r"[.!?;:,]$"), 0.1) + is_(F.upper(line) == line, 0.1) + is_(line_no == 0, 0.3) - is_(F.length(line) > 200, 0.4)
    )


def decision(score: Column, margin: float = AMBIGUOUS) -> Column:
    """Heading or paragraph (whose score is the rest to 1), ambiguous if they are near."""
    return F.when(F.abs(2 * score - 1) < margin, "ambiguous").when(score > 0.5, "heading").otherwise("paragraph")


def body_sizes(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("doc_id").agg(F.coalesce(F.median("size_pt"), F.lit(DEFAULT_SIZE)).alias("body_pt"))


def heading_candidates(paragraphs: DataFrame) -> DataFrame:
    """Decisions on paragraphs with style evidence (doc_id, node_id, text, style_id, style_name, outline_level,
    direct BOOLEAN, size_pt, weight, all_caps, keep_with_next): chosen interpretation, level, score,
    margin, ambiguous. Outline levels and style names settle it; else typography adds up."""
    p = paragraphs.join(body_sizes(paragraphs), "doc_id")
    named = F.regexp_extract(F.lower(F.coalesce("style_name", F.lit(""))), r"^heading ([1-6])$", 1)
    by_id = F.regexp_extract(F.lower(F.coalesce("style_id", F.lit(""))), r"^heading([1-6])$", 1)
    ratio = F.coalesce(F.col("size_pt"), F.col("body_pt")) / F.col("body_pt")
    is_ = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    n = F.length("text")
    soft = (
        F.greatest(F.lit(0.0), F.least(F.lit(0.5), (ratio - 1) * 1.5)) + is_(F.col("weight") >= 600, 0.2) + is_(F.col("all_caps"), 0.1)
        + is_((n >= 1) & (n <= 80), 0.1) + is_(~F.col("text").rlike(r"[.!?;:,]\s*$"), 0.1) + is_(F.col("keep_with_next"), 0.15) - is_(n > 200, 0.4)
    )
    score = (
        F.when(F.col("outline_level") <= 8, 1.0).when(named != "", 0.95).when(by_id != "", 0.8).when(~F.coalesce("direct", F.lit(False)), F.lit(None)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), soft)))
    )
    level = (
        F.when(F.col("outline_level") <= 8, F.col("outline_level") + 1).when(named != "", named.try_cast("int")).when(by_id != "", by_id.try_cast("int"))
        .when(ratio >= 1.6, 1).when(ratio >= 1.35, 2).when(ratio >= 1.15, 3).otherwise(4)
    )
    scored = p.withColumn("score", score).where("score is not null")
    heading = F.col("score") > 0.5
    margin = F.when(heading, F.abs(2 * F.col("score") - 1)).otherwise(F.lit(1.0))  # a lone candidate
    return scored.select(
        "doc_id", "node_id", F.when(heading, "heading").otherwise("paragraph").alias("chosen"), F.when(heading, level).alias("level"), "score",
        margin.alias("margin"), (margin < AMBIGUOUS).alias("ambiguous"),
    )


def resolve(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Ambiguous decisions take a given answer (doc_id, node_id, answer) if it is one of the
    candidates; others keep what the rules chose."""
    joined = decisions.join(answers, ["doc_id", "node_id"], "left")
    legal = F.col("ambiguous") & F.col("answer").isin("heading", "paragraph")
    return joined.withColumn("chosen", F.when(legal, F.col("answer")).otherwise(F.col("chosen"))).drop("answer")


def style_roles(paragraphs: DataFrame) -> DataFrame:
    """role by style name, and the run of neighbouring paragraphs of one role that form a block."""
    role = F.create_map(*(F.lit(x) for kv in STYLE_ROLES.items() for x in kv))[F.lower("style_name")]
    return islands(paragraphs.withColumn("role", F.coalesce(role, F.lit("paragraph"))), ["doc_id"], ["ord"], "role")


def grouped_blocks(paragraphs: DataFrame) -> DataFrame:
    """Quotes and code: one block per run, texts joined by line feeds."""
    runs = style_roles(paragraphs).where("role in ('blockquote', 'code')")
    return runs.groupBy("doc_id", "island", "role").agg(F.min("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


def bind_captions(blocks: DataFrame) -> DataFrame:
    """Each caption with the table or figure next to it: the one before, else the one after."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    near = lambda f: F.when(f("type").over(w).isin("table", "image", "figure"), f("node_id").over(w))
    return blocks.withColumn("target", F.coalesce(near(F.lag), near(F.lead))).where("role = 'caption'")


def explain(decisions: DataFrame) -> DataFrame:
    """A line of text for each decision on a heading."""
    what = F.concat(F.col("chosen"), F.when(F.col("level").isNotNull(), F.concat(F.lit(" "), F.col("level").cast("string"))).otherwise(""))
    sure = F.when(F.col("ambiguous"), ", ambiguous").otherwise("")
    return decisions.select("doc_id", "node_id", F.concat(F.col("node_id").cast("string"), F.lit(": "), what, F.lit(" (score "), F.format_number("score", 2), F.lit(", margin "), F.format_number("margin", 2), sure, F.lit(")")).alias("line"))
