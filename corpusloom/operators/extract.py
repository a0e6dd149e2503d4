"""Atomic units from documents: structured sections, code, definitions, rules in prose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text as T

SHELLS = ("sh", "bash", "shell", "zsh", "console")
ENV_LINE = r"^(?:export )?((?![0-9_])[0-9A-Z_]{3,})=(.*)$"


def all_sentences(c: Column) -> Column:
    """As text.sentences, empty ones kept, so that positions stay."""
    cut = F.regexp_replace(c, r"([.!?]+[\"')\]]*)[ \t]+([\p{Lu}0-9])", "$1\n$2")
    return F.transform(F.split(cut, r"\n"), lambda x: F.trim(x))


def first_claims(rows: DataFrame, wanted: Column, least_words: int, order: list[str], text: str = "s") -> DataFrame:
    """Wanted sentences of at least so many words, the first of each normalised wording."""
    claim = F.trim(T.collapse(F.lower(text), T.TREE_SPACE))
    enough = F.size(F.filter(F.split(text, " "), lambda w: w != "")) >= least_words
    first = Window.partitionBy("claim").orderBy(*order)
    return rows.where(wanted & enough).withColumn("claim", claim).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def sections(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, ord, type, text, ...) with section: the number of headings up to each, and
    heading: its own section's."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    is_heading = F.col("type") == "heading"
    return blocks.withColumn("section", F.sum(is_heading.cast("int")).over(w)).withColumn("heading", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(w))


def _unit(rows: DataFrame, extractor: int, category: Column, text: Column, confidence: Column, rationale: Column | None = None, key: Column | None = None, value: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_id", F.lit(extractor).alias("extractor"), "ord", F.col("pos").alias("pos") if "pos" in rows.columns else F.lit(0).alias("pos"), category.alias("category"), text.alias("text"),
        (rationale if rationale is not None else none).alias("rationale"), confidence.cast("double").alias("confidence"), (key if key is not None else none).alias("entity_key"), (value if value is not None else none).alias("entity_value"),
    )


def structured(blocks: DataFrame) -> DataFrame:
    """Decision records and numbered rules: a heading with the first paragraph of its section."""
    body = sections(blocks).where("heading is not null and type = 'paragraph'")
    said = body.groupBy("doc_id", "section", "heading").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    said = said.select("doc_id", "heading", F.element_at("p", 1).getField("ord").alias("ord"), F.element_at("p", 1).getField("text").alias("text"), F.filter("p", lambda x: F.lower(x["text"]).rlike(r"^(because|rationale|reason|why)")).alias("why"))
    why = F.get(F.col("why"), F.lit(0))["text"]
    record, rule = F.lower("heading").rlike(r"^(adr|decision)[ :-]*[0-9]+"), F.lower("heading").rlike(r"^rule[ :-]*[0-9]+")
    category = F.when(record & (why.isNull() | T.asserts_rule(F.col("text"))), "constraint").when(record, "decision").otherwise("convention")
    confidence = F.when(record & why.isNull(), 0.6).when(record, 0.95).otherwise(0.9)
    return _unit(said.where(record | rule), 1, category, F.col("text"), confidence, why)


def code(blocks: DataFrame) -> DataFrame:
    """Environment settings in any fence, commands in shell fences; comments and blanks skipped."""
    rows = sections(blocks).where("type = 'code'").select("doc_id", "ord", "lang", "heading", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.regexp_replace(F.trim("line"), r"^\$ ", "")).where("line <> '' and not line like '#%'")
    key, value = F.regexp_extract("line", ENV_LINE, 1), F.regexp_extract("line", ENV_LINE, 2)
    settings = _unit(rows.where(key != ""), 2, F.lit("environment"), F.concat(key, F.lit("="), value), F.lit(0.95), key=key, value=value)
    verb = F.regexp_extract(F.lower(F.coalesce("heading", F.lit(""))), r"(?<![a-z])(build|test|deploy|run|install|lint|release|start)(?![a-z])", 1)
    task = F.coalesce(F.nullif(verb, F.lit("")), F.nullif(F.regexp_extract(F.lower("line"), r"(?<![a-z])(build|test|deploy|run|install|lint|release|start)(?![a-z])", 1), F.lit("")))
    commands = _unit(rows.where((key == "") & F.lower("lang").isin(*SHELLS)), 2, F.lit("command"), F.col("line"), F.lit(0.95), key=F.when(task.isNotNull(), F.concat(F.lit("command:"), task)), value=F.when(task.isNotNull(), F.col("line")))
    return settings.unionByName(commands)


def definitions(blocks: DataFrame) -> DataFrame:
    rows = blocks.where("type in ('paragraph', 'listItem')")
    term = F.regexp_extract("text", r"^(\S[^—–]{0,59}?)\s*[—–]\s+(\S.*)$", 1)
    return _unit(rows.where((term != "") & (F.size(F.split(term, r"\s+")) <= 6)), 3, F.lit("glossary"), F.col("text"), F.lit(0.9), key=F.lower(term), value=F.regexp_extract("text", r"^(\S[^—–]{0,59}?)\s*[—–]\s+(\S.*)$", 2))


def _prose(blocks: DataFrame) -> DataFrame:
    rows = blocks.where("type in ('paragraph', 'listItem')").select("doc_id", "ord", F.posexplode(all_sentences(F.col("text"))).alias("pos", "s"))
    return rows.where(F.size(F.filter(F.split("s", r"\s+"), lambda w: w != "")) >= 4)


def normative(blocks: DataFrame) -> DataFrame:
    rows = _prose(blocks).where(T.asserts_rule(F.col("s")))
    ban = T.is_prohibition(F.col("s"))
    return _unit(rows, 4, F.when(ban, "antiPattern").otherwise("constraint"), F.col("s"), F.when(ban, 0.8).otherwise(0.65))


def role_implied(blocks: DataFrame, roles: DataFrame) -> DataFrame:
    """First sentences of 4 to 40 words in documents whose role makes them conventions."""
    rows = _prose(blocks).where("pos = 0").join(roles.where("role in ('codingConventions', 'testPolicy')").select("doc_id"), "doc_id", "left_semi")
    return _unit(rows.where(F.size(F.split("s", r"\s+")) <= 40), 5, F.lit("convention"), F.col("s"), F.lit(0.7))


def extract_units(blocks: DataFrame, roles: DataFrame) -> DataFrame:
    """All extractors in order; of one document's equal wordings the first extractor's stays. Then
    every unit gets its place in the document, content hash and id."""
    found = reduce(DataFrame.unionByName, [structured(blocks), code(blocks), definitions(blocks), normative(blocks), role_implied(blocks, roles)])
    first = Window.partitionBy("doc_id", T.claim_key(F.col("text"))).orderBy("extractor", "ord", "pos")
    unique = found.where(F.trim("text") != "").withColumn("n", F.row_number().over(first)).where("n = 1")
    place = Window.partitionBy("doc_id").orderBy("extractor", "ord", "pos")
    digest = hashing.unit_digest(F.col("category"), F.col("text"))
    return unique.withColumn("unit_order", F.row_number().over(place) - 1).withColumn("content_hash", digest).withColumn("unit_id", hashing.unit_id(hashing.sha256_hex(F.concat_ws("\n", "doc_id", "content_hash")))).drop("n", "extractor", "pos")


def locate(source: Column, text: Column) -> Column:
    """Offset (from 0) of a unit in its source text: by its first 60 characters, else its first 20, else
    both without marks of emphasis and code (then the offset is that in the bare source); null if absent."""
    bare = lambda c: F.regexp_replace(c, r"[*_`~]+", "")
    at = lambda s, t, n: F.nullif(F.instr(s, F.substring(t, 1, n)), F.lit(0)) - 1
    return F.coalesce(at(source, text, 60), at(source, text, 20), at(bare(source), bare(text), 60))
