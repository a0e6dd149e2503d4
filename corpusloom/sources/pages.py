"""Recognised pages to nodes: blocks (doc_id, page, block_no, kind, level, text, confidence) from any recogniser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lines import islands

LOW = 0.6
BULLET = r"^\s*(?:[-*•·]|[0-9]{1,3}[.)])\s+"


def text_blocks(chunks: DataFrame) -> DataFrame:
    """Plain recognised text (doc_id, page, text) to blocks: blank lines divide; a chunk of bullets
    only is a list; words that a line end divides are rejoined."""
    parts = chunks.select("doc_id", "page", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("block_no", "t")).where(F.trim("t") != "")
    rows = F.filter(F.split(F.trim("t"), "\n"), lambda x: F.trim(x) != "")
    bullets = F.forall(rows, lambda x: x.rlike(BULLET))
    joined = F.regexp_replace(F.regexp_replace(F.trim("t"), r"([a-z])-\n\s*(?=[a-z])", "$1"), r"\s*\n\s*", " ")
    items = F.when(bullets, F.transform(rows, lambda x: F.struct(F.lit("listItem").alias("kind"), F.regexp_replace(x, BULLET, "").alias("text")))).otherwise(F.array(F.struct(F.lit("paragraph").alias("kind"), joined.alias("text"))))
    out = parts.select("doc_id", "page", "block_no", F.posexplode(items).alias("i", "b"))
    w = Window.partitionBy("doc_id", "page").orderBy("block_no", "i")
    return out.select("doc_id", "page", (F.row_number().over(w) - 1).alias("block_no"), "b.kind", F.lit(None).cast("int").alias("level"), "b.text", F.lit(None).cast("double").alias("confidence"))


def grouped(blocks: DataFrame) -> DataFrame:
    """Neighbouring list items of a page form one list; other blocks stand alone."""
    own = blocks.withColumn("k", F.when(F.col("kind") == "listItem", "list").otherwise(F.concat_ws("#", "kind", "block_no")))
    runs = islands(own, ["doc_id", "page"], ["block_no"], "k")
    items = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    return runs.groupBy("doc_id", "page", "island").agg(F.min("block_no").alias("block_no"), F.when(F.min("kind") == "listItem", "list").otherwise(F.min("kind")).alias("kind"), F.min(F.greatest(F.lit(1), F.least(F.lit(6), "level"))).alias("level"), items.alias("texts"), F.min("confidence").alias("confidence"))


def diagnostics(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page) read with little confidence, and pages without any block, which are lost."""
    read = blocks.groupBy("doc_id", "page").agg(F.avg("confidence").alias("confidence"))
    both = pages.join(read, ["doc_id", "page"], "left")
    empty = both.join(blocks.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").select("doc_id", "page", F.lit("CE-OCR-0002").alias("code"), F.lit(True).alias("lossy"))
    low = both.where(F.col("confidence") < LOW).select("doc_id", "page", F.lit("CE-OCR-0001").alias("code"), F.lit(False).alias("lossy"))
    return empty.unionByName(low)
