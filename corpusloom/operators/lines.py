"""The line model of plain text: a document is a sequence of one-line paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, line_no, line of every line with content."""
    cut = docs.where("text is not null").select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut.where(F.trim("line") != "")


def text_content(c: Column) -> Column:
    """The text with its blocks joined by one space: document-local, no shuffle."""
    return F.trim(T.collapse(c, T.TREE_SPACE))


def occurrences(units: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """occurrence: how many equal units came before, from 0."""
    return units.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def nearest_preceding(rows: DataFrame, by: list[str], order: list[str], is_mark: Column, **values: Column) -> DataFrame:
    """The values of the last marked row before each row of a group, null before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *(F.last(F.when(is_mark, v), ignorenulls=True).over(w).alias(name) for name, v in values.items()))


def level_skips(rows: DataFrame, by: list[str], order: list[str], level: str) -> DataFrame:
    """Rows whose level exceeds the level before by more than one."""
    before = F.lag(level).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("before", before).where(F.col(level) > F.col("before") + 1)


def islands(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """island: number of the run of equal neighbouring values that a row is in, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    return rows.withColumn("changed", changed.cast("int")).withColumn("island", F.sum("changed").over(w)).drop("changed")
