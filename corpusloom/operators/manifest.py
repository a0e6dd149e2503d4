"""Incremental runs and the provenance manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def states(now: DataFrame, previous: DataFrame, key: str, digest: str) -> DataFrame:
    """now with state: 'new', 'changed' or 'unchanged' against the previous run."""
    old = previous.select(F.col(key), F.col(digest).alias("old"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "new").when(F.col("old").eqNullSafe(F.col(digest)), "unchanged").otherwise("changed")
    return now.join(old, key, "left").withColumn("state", state).drop("old", "known")


def to_process(now: DataFrame, previous: DataFrame, key: str, digest: str) -> DataFrame:
    """The rows that a run must extract anew."""
    return now.join(previous.select(key, digest), [key, digest], "left_anti")


def provenance(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """file, fragment_id, start, end, unit_id, path, content hash: what each emitted span rests on."""
    claims = fragments.select("file", "fragment_id", "start", "end", F.explode("unit_ids").alias("unit_id"))
    held = units.select("unit_id", "content_hash", F.explode("sources").alias("source"))
    return claims.join(held, "unit_id").select("file", "fragment_id", "start", "end", "unit_id", "source.path", "content_hash")


def units_per_path(units: DataFrame) -> DataFrame:
    return units.select("unit_id", F.explode("sources").alias("s")).groupBy(F.col("s.path").alias("path")).agg(F.count_distinct("unit_id").alias("n_units"))


def source_rows(docs: DataFrame, roles: DataFrame, units: DataFrame) -> DataFrame:
    """path, content_hash, role, n_units of every source (docs: doc_id, path, content_hash)."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "content_hash").join(roles.select("doc_id", "role"), "doc_id", "left")
    return own.join(units_per_path(units), "path", "left").select("path", "content_hash", "role", F.coalesce("n_units", F.lit(0)).alias("n_units"))


def file_rows(files: DataFrame, target: str) -> DataFrame:
    """file, target, content_hash, tokens."""
    return files.select("file", F.lit(target).alias("target"), F.sha2("text", 256).alias("content_hash"), "tokens")


def document(sources: DataFrame, units: DataFrame, files: DataFrame, spans: DataFrame, conflicts: DataFrame) -> str:
    """The manifest of one run as canonical JSON. It is as large as the emitted files and their units,
    which budgets bound, and is made for them alone; the tables stay tables."""
    from ..functions.hashing import canonical

    def rows(df: DataFrame, *order: str) -> list:
        return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]

    emitted = units.join(spans.select("unit_id").distinct(), "unit_id", "left_semi")
    used = sources.join(spans.select("path").distinct(), "path", "left_semi")
    return canonical({
        "version": 0, "sources": rows(used, "path"), "units": rows(emitted.select("unit_id", "category", "content_hash", "text", "rationale", "conflicts_with"), "unit_id"),
        "files": rows(files, "file"), "spans": rows(spans, "file", "start", "unit_id", "path"), "conflicts": rows(conflicts, *conflicts.columns),
    }) + "\n"
