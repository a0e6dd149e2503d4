"""Documents in canonical form: composed text, single spaces, merged runs, nothing empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.nodes import BLOCK_TYPES

VERBATIM = tuple("html yaml toml code math equationBlock inlineMath inlineCode".split())
LINE_PT = 12.0


def clean_text(nodes: DataFrame) -> DataFrame:
    """Composition, soft hyphens and white space of texts; verbatim nodes are left alone."""
    cleaned = T.collapse(T.strip_soft_hyphens(T.nfc(F.col("value"))), T.TREE_SPACE)
    return nodes.withColumn("value", F.when(F.col("type") == "text", cleaned).otherwise(F.col("value")))


def merge_adjacent_text(nodes: DataFrame) -> DataFrame:
    """Neighbouring texts of one parent become one, at the first one's place."""
    by = ["doc_id", "root_kind", "parent_ord"]
    w = Window.partitionBy(*by).orderBy("ord")
    text = F.col("type") == "text"
    breaks = (~text) | (F.coalesce(F.lag("type").over(w), F.lit("")) != "text")
    runs = nodes.withColumn("run", F.sum(breaks.cast("int")).over(w))
    whole = Window.partitionBy(*by, "run")
    first = F.row_number().over(whole.orderBy("ord"))
    pieces = F.array_sort(F.collect_list(F.struct("ord", "value")).over(whole))
    merged = runs.withColumn("n", first).withColumn("value", F.when(text, F.array_join(F.transform(pieces, lambda x: x["value"]), "")).otherwise(F.col("value")))
    return merged.where((F.col("n") == 1) | ~text).drop("n", "run")


def trim_edges(nodes: DataFrame) -> DataFrame:
    """No white space at the ends of a block's inline content, and no empty texts."""
    parent = nodes.select("doc_id", "root_kind", F.col("ord").alias("parent_ord"), F.col("type").alias("parent_type"))
    w = Window.partitionBy("doc_id", "root_kind", "parent_ord").orderBy("ord")
    joined = nodes.join(parent, ["doc_id", "root_kind", "parent_ord"], "left").withColumn("before", F.lag("ord").over(w)).withColumn("after", F.lead("ord").over(w))
    edge = F.col("parent_type").isin(*BLOCK_TYPES) & (F.col("type") == "text")
    value = F.when(edge & F.col("before").isNull(), F.ltrim("value")).otherwise(F.col("value"))
    trimmed = joined.withColumn("value", value).withColumn("value", F.when(edge & F.col("after").isNull(), F.rtrim("value")).otherwise(F.col("value")))
    return trimmed.where((F.col("type") != "text") | (F.col("value") != "")).select(nodes.columns)


def normalize(nodes: DataFrame) -> DataFrame:
    """A fixed point in one pass: clean, merge, then clean what merging joined, then trim."""
    return trim_edges(clean_text(merge_adjacent_text(clean_text(nodes))))


def absorb_spacing(blocks: DataFrame) -> DataFrame:
    """Empty paragraphs (doc_id, ord, text, bordered) go; each adds a line of space before the next block."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    empty = (F.trim("text") == "") & ~F.coalesce("bordered", F.lit(False))
    # Empty paragraphs so far, less those before the last block that stays.
    so_far = F.sum(empty.cast("int")).over(w)
    marked = blocks.withColumn("empty", empty).withColumn("so_far", so_far).where("not empty")
    before = F.col("so_far") - F.coalesce(F.lag("so_far").over(w), F.lit(0))
    return marked.withColumn("space_before_pt", before * F.lit(LINE_PT)).drop("empty", "so_far")
