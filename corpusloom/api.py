"""What a command line would offer, as functions: convert, format, check, diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import fidelity, profiles
from .sinks import docx, html as html_sink, json as json_sink, markdown as md_sink, typst
from .sources import html, markdown, scan

READERS = {"md": markdown.read_markdown, "html": html.read_html}
WRITERS = {"md": md_sink.render, "html": html_sink.render, "json": json_sink.render, "docx": docx.render, "typst": typst.render}
METRICS = ["structural", "text", "table_f1", "span_f1"]


def read(docs: DataFrame, kind: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Node table of texts of one format; folders of mixed files: sources.scan."""
    if kind not in READERS:
        raise ValueError(f"no text reader for {kind}: one of {sorted(READERS)}")
    return READERS[kind](docs, id_column, column)


def convert(docs: DataFrame, source: str, target: str, **options) -> DataFrame:
    """doc_id and the rendered document (bytes for docx)."""
    if target not in WRITERS:
        raise ValueError(f"no writer for {target}: one of {sorted(WRITERS)}")
    return WRITERS[target](read(docs, source), **options)


def convert_files(files: DataFrame, target: str, **options) -> DataFrame:
    return WRITERS[target](scan.read_documents(files), **options)


def format_markdown(docs: DataFrame, flavor: str = "default") -> DataFrame:
    """doc_id, rendered, changed."""
    done = convert(docs, "md", "md", flavor=flavor)
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("before"))
    return done.join(own, "doc_id").select("doc_id", "rendered", (~F.col("rendered").eqNullSafe(F.col("before"))).alias("changed"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of node types that differ between two node tables, per document."""
    return fidelity.census_delta(fidelity.census(a, "doc_id"), fidelity.census(b, "doc_id"), ["doc_id"])


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id and the likeness of two node tables' trees, texts, tables and inline marks. A document
    without tables (or marks) on either side agrees in them."""
    from .functions.text import grapheme_similarity

    left, right = (fidelity.features(x) for x in (a, b))
    both = left.join(right.select("doc_id", *(F.col(c).alias(f"{c}_b") for c in right.columns[1:])), "doc_id")
    return both.select(
        "doc_id", fidelity.structural_similarity("labels", "parents", "labels_b", "parents_b").alias("structural"), grapheme_similarity("text", "text_b").alias("text"),
        fidelity.bag_f1("cells", "cells_b").alias("table_f1"), fidelity.bag_f1("spans", "spans_b").alias("span_f1"),
    )


def check(docs: DataFrame, source: str, through: str, baseline: DataFrame, tolerance: float = fidelity.TOLERANCE) -> DataFrame:
    """Regressions and improvements of a round trip through a text format against a baseline (doc_id, metrics)."""
    first = read(docs, source)
    again = READERS[through](WRITERS[through](first), "doc_id", "rendered")
    return fidelity.compare_to_baseline(compare(first, again), baseline, ["doc_id"], METRICS, tolerance)


def init(folder: str, name: str = "base") -> str:
    """Lay a first profile in a folder; its path."""
    return profiles.init(folder, name)
