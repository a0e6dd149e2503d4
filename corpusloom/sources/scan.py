"""Folders of documents: format by extension, bytes, text of the text formats, dispatch to readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import html, markdown, office
from .nodes import Node, read

FORMATS = {"md": "md", "markdown": "md", "html": "html", "htm": "html", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "pdf": "pdf"}
OUTPUTS = ("md", "html", "json", "docx", "typst")


def format_of(path: Column) -> Column:
    """Format by file extension; null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))[ending]


def is_output_format(c: Column) -> Column:
    return c.isin(*OUTPUTS)


def reviewed_on(text: Column) -> Column:
    """The date of "last reviewed: yyyy-mm-dd" in a text, null without one."""
    found = F.regexp_extract(F.lower(text), r"last reviewed:?\s+([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def read_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """doc_id and path (relative to the folder), format, bytes, byte_length, content_hash, source_text (of
    md and html), reviewed, authority; sorted by path. A folder without any file of a known format is
    an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = re.sub(r"^[a-z]+:/*(?=/)", "", folder).rstrip("/")
    path = F.regexp_extract("path", re.escape(root) + "/(.*)$", 1)
    path = F.when(path == "", F.col("path")).otherwise(path)
    rows = files.select(path.alias("path"), format_of(F.col("path")).alias("format"), F.col("content").alias("bytes"), F.col("length").alias("byte_length")).where("format is not null")
    if rows.select("path").isEmpty():
        raise FileNotFoundError(f"nothing in {folder} has a known format: {', '.join(sorted(FORMATS))}")
    text = F.when(F.col("format").isin("md", "html"), F.try_validate_utf8(F.col("bytes").cast("string")))
    said = rows.select(F.col("path").alias("doc_id"), "*", F.sha2("bytes", 256).alias("content_hash"), text.alias("source_text"))
    return said.withColumn("reviewed", reviewed_on(F.col("source_text"))).withColumn("authority", T.authority(F.col("reviewed"))).orderBy("path")


PARSERS = {
    "md": lambda b: markdown.parse(b.decode("utf-8", "replace")),
    "html": lambda b: html.parse(b.decode("utf-8", "replace")),
    "docx": office.parse_docx, "pptx": office.parse_pptx, "xlsx": office.parse_xlsx,
}


def parse_bytes(data: bytes, kind: str):
    """Roots of one document; a file that its reader cannot open gives one unknown node."""
    try:
        return PARSERS[kind](data)
    except Exception as e:  # noqa: BLE001  a broken file must not end the job: it is a row to report
        return Node("root", [Node("unknown", attrs={"construct": f"{kind}:unreadable", "message": type(e).__name__})])


def read_documents(files: DataFrame) -> DataFrame:
    """The node table of a folder's files; formats without a reader (pdf) are left out, their text
    runs come as a table (operators.layout)."""
    rows = files.where(F.col("format").isin(*PARSERS)).select("doc_id", F.struct("format", "bytes").alias("file"))
    return read(rows, lambda f: parse_bytes(f["bytes"], f["format"]) if f else Node("root"))


def unreadable(nodes: DataFrame) -> DataFrame:
    """Diagnostics for what readers could not take: doc_id, node_id, construct."""
    return nodes.where("type = 'unknown'").select("doc_id", "node_id", F.lit("CE-READ-0001").alias("code"), F.lit("warning").alias("severity"), F.lit(True).alias("lossy"), F.col("attrs")["construct"].alias("construct"))
