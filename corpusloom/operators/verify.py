"""Does every emitted piece of text stand in the units it claims?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def offsets(pieces: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """start, end (exclusive) of each piece in the concatenation of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(text).cast("long")).over(w)
    return pieces.withColumn("end", end).withColumn("start", F.col("end") - F.length(text))


def check_fragments(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """status of each fragment (fragment_id, text, unit_ids): 'no-unit' if none of its units exists, 'contained'
    if its normalised text stands in theirs, else 'not-contained'."""
    claims = fragments.select("fragment_id", F.explode_outer("unit_ids").alias("unit_id"))
    held = claims.join(units.select("unit_id", F.col("text").alias("unit_text")), "unit_id", "left")
    joined = held.groupBy("fragment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "unit_text"))), lambda x: x["unit_text"]), " ").alias("all_text"), F.count("unit_text").alias("n"))
    norm = lambda c: T.normalize_unit(c, compose=False)
    status = F.when(F.col("n") == 0, "no-unit").when(F.contains(norm(F.col("all_text")), norm(F.col("text"))), "contained").otherwise("not-contained")
    return fragments.join(joined, "fragment_id").select("fragment_id", status.alias("status"))


def line_segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg, start, end of the runs between line feeds that are not empty."""
    parts = F.split("text", "\n")
    ends = F.transform(F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1))), lambda x: x)
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.arrays_zip(parts.alias("x"), F.slice(ends, 1, F.size(parts)).alias("start"))).alias("seg", "z"))
    return rows.where(F.length("z.x") > 0).select("doc_id", "seg", F.col("z.start").alias("start"), (F.col("z.start") + F.length("z.x")).alias("end"))


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of half-open intervals of a group that share a point. Both sides are cut into buckets of
    width and joined on group and bucket; a pair is kept in the first bucket it shares."""
    buckets = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    l, r = buckets(left.where("end > start")).alias("l"), buckets(right.where("end > start")).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "bucket"]]
    meet = (F.col("r.start") < F.col("l.end")) & (F.col("r.end") > F.col("l.start"))
    once = F.col("l.bucket") == F.floor(F.greatest("l.start", "r.start") / width)
    for cond in [*same, meet]:
        once = once & cond
    return l.join(r, once)


def traceability(checked: DataFrame) -> DataFrame:
    """supported, total, share; nothing emitted counts as fully traceable, and as covering nothing."""
    return checked.agg(F.coalesce(F.sum((F.col("status") == "contained").cast("long")), F.lit(0)).alias("supported"), F.count("*").alias("total")).withColumn("share", F.when(F.col("total") == 0, 1.0).otherwise(F.col("supported") / F.col("total")))


MARKERS = ("- ", "  - ", "1. ", "> ", ", ")


def scaffold_violations(fragments: DataFrame, profile: dict) -> DataFrame:
    """fragment_id, file, scaffold, text of the scaffold pieces that are not what their kind allows: a heading must be
    one that the profile declares, by enumeration, so that no sentence passes as one; markers, fences
    and blanks have closed vocabularies; front matter may use the profile's keys alone."""
    headings = [s.get("heading", "") for s in profile.get("sections", [])] + list(profile.get("titles", []))
    keys = list(profile.get("front_matter", []))
    text = F.col("text")
    bare = F.trim(F.regexp_replace(text, r"^#{1,6}\s*", ""))
    key = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9_-]*):", 1)
    allowed: dict[str, Column] = {
        "heading": bare.isin(*headings) if headings else F.lit(False),
        "marker": text.isin(*MARKERS) | (F.trim(text) == ""),
        "fence": text.rlike(r"^```[a-z]*\n$"),
        "blank": F.regexp_replace(text, r"\s+", "") == "",
        "frontMatter": text.isin("---\n", "---\n\n") | (key.isin(*keys) if keys else F.lit(False)),
        "link": text.rlike(r"\]\(|^@|^## "),
        "manifestKey": F.lit(profile.get("kind") == "manifest"),
    }
    fine = F.lit(False)
    for kind, rule in allowed.items():
        fine = fine | ((F.col("scaffold") == kind) & rule)
    return fragments.where(F.col("scaffold").isNotNull() & ~fine).select("fragment_id", "file", "scaffold", "text")


def coverage(fragments: DataFrame, checked: DataFrame, texts: DataFrame, width: int = 4096) -> DataFrame:
    """file, seg, state of every line of the emitted files (file, text): 'supported' if a unit's piece that passed
    stands in it, or scaffold alone; 'outside' if nothing does; else 'unsupported'."""
    segments = line_segments(texts.select(F.col("file").alias("doc_id"), "text"))
    bad = checked.where("status <> 'contained'").select("fragment_id", F.lit(True).alias("bad"))
    pieces = fragments.join(bad, "fragment_id", "left").select(F.col("file").alias("doc_id"), "start", "end", (F.col("scaffold").isNull() & F.col("bad").isNull()).alias("good"), F.col("scaffold").isNotNull().alias("frame"))
    met = overlaps(segments, pieces, ["doc_id"], width).groupBy("l.doc_id", "l.seg").agg(F.max("r.good").alias("good"), F.min("r.frame").alias("frame"))
    state = F.when(F.col("good").isNull(), "outside").when(F.col("good") | F.col("frame"), "supported").otherwise("unsupported")
    return segments.join(met, ["doc_id", "seg"], "left").select(F.col("doc_id").alias("file"), "seg", state.alias("state"))
