"""Placed units to files: fragments with offsets, each owned by units or by scaffold."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text as T
from .verify import offsets

SCAFFOLD = ("heading", "marker", "fence", "blank", "frontMatter", "link", "manifestKey")


def fragments(placed: DataFrame, profile: dict, file: Column | None = None, place: str = "primary") -> DataFrame:
    """file, frag_idx, text, unit_ids, scaffold, section, start, end of the units of one place. A list section is a
    heading and bullets; a code section one fence; prose paragraphs; empty sections are left out."""
    own = placed.where(F.col("place") == place).withColumn("file", file if file is not None else F.lit(f"{profile['id']}.md"))
    spec = profile["sections"]
    pick = lambda key, default: F.create_map(*(F.lit(x) for s in spec for x in (s["section"], str(s.get(key, default)))))[F.col("section")]
    level = pick("level", 2).cast("int")
    rows = own.withColumn("render", pick("render", "list")).withColumn("heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), pick("heading", "")))
    part = lambda step, text, owned, kind: F.struct(F.lit(step).alias("step"), text.alias("text"), F.lit(owned).alias("owned"), F.lit(kind).cast("string").alias("scaffold"))
    code, prose = F.col("render") == "code", F.col("render") == "prose"
    unit_parts = F.when(code, F.array(part(0, F.col("text"), True, None), part(1, F.lit("\n"), False, "blank"))).when(
        prose, F.array(part(0, F.col("text"), True, None), part(1, F.lit("\n\n"), False, "blank"))
    ).otherwise(
        F.concat(
            F.array(part(0, F.lit("- "), False, "marker"), part(1, F.col("text"), True, None), part(2, F.lit("\n"), False, "blank")),
            F.when(F.col("rationale").isNotNull(), F.array(part(3, F.lit("  - "), False, "marker"), part(4, F.col("rationale"), True, None), part(5, F.lit("\n"), False, "blank"))).otherwise(F.array().cast("array<struct<step:int,text:string,owned:boolean,scaffold:string>>")),
        )
    )
    units = rows.select("file", "section", "section_idx", F.lit(1).alias("zone"), "position", "unit_id", F.explode(unit_parts).alias("p"))
    head = rows.groupBy("file", "section", "section_idx", "render", "heading").agg(F.count("*").alias("n"))
    opening = F.array(part(0, F.col("heading"), False, "heading"), part(1, F.lit("\n\n"), False, "blank"), part(2, F.when(code, "```\n").otherwise(""), False, "fence"))
    closing = F.array(part(0, F.when(code, "```\n").otherwise(""), False, "fence"), part(1, F.lit("\n"), False, "blank"))
    frame = lambda zone, parts: head.select("file", "section", "section_idx", F.lit(zone).alias("zone"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("unit_id"), F.explode(parts).alias("p"))
    every = units.unionByName(frame(0, opening)).unionByName(frame(2, closing)).where("p.text <> ''")
    order = ["section_idx", "zone", "position", "p.step"]
    w = Window.partitionBy("file").orderBy(*order)
    listed = every.select("file", (F.row_number().over(w) - 1).alias("frag_idx"), F.col("p.text").alias("text"), F.when(F.col("p.owned"), F.array("unit_id")).otherwise(F.array().cast("array<string>")).alias("unit_ids"), F.col("p.scaffold").alias("scaffold"), "section")
    return offsets(listed, ["file"], ["frag_idx"], "text").withColumn("fragment_id", F.concat_ws("#", "file", "frag_idx"))


def partitioned(placed: DataFrame, profile: dict) -> DataFrame:
    """Skills and commands: one file per document role, named after it."""
    return fragments(placed, profile, file=F.concat(T.kebab(F.col("role")), F.lit("/"), F.lit(profile["id"]), F.lit(".md")))


def files(found: DataFrame) -> DataFrame:
    """file, text, tokens."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_idx", "text"))), lambda x: x["text"]), "")
    return found.groupBy("file").agg(text.alias("text")).withColumn("tokens", T.count_tokens(F.col("text")))


def cuts(files_: DataFrame, spans: DataFrame, width: int = 4096) -> DataFrame:
    """spans (file, start, end and others) with text: what stands there in the files (file, text). A file is cut into
    blocks, by two steps so that its head is not read again for each, and a span reads its own blocks alone."""

    def blocks(df: DataFrame, size: int) -> DataFrame:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")), lambda i: F.struct((F.col("at") + i * size).alias("at"), F.substring(F.col("text"), i * size + 1, F.lit(size)).alias("text")))
        return df.where("text <> ''").select("file", F.explode(parts).alias("p")).select("file", "p.*")

    large = blocks(files_.select("file", F.lit(0).cast("long").alias("at"), "text"), width * 1024).repartition("file", "at")
    small = blocks(large, width).select("file", F.expr(f"at div {width}").alias("block"), F.col("text").alias("own"))
    kept = spans.where("end > start").select("*", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("block"))
    first = F.greatest(F.col("start") - F.col("block") * width, F.lit(0))
    piece = F.substring("own", (first + 1).cast("int"), (F.least(F.col("end") - F.col("block") * width, F.lit(width)) - first).cast("int"))
    held = kept.join(small, ["file", "block"]).select(*spans.columns, F.struct("block", piece.alias("piece")).alias("p"))
    return held.groupBy(*spans.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), "").alias("text"))


def drop_unsupported(found: DataFrame, checked: DataFrame) -> DataFrame:
    """Fragments without the owned ones that failed verification, with offsets computed anew."""
    bad = checked.where("status <> 'contained'").select("fragment_id")
    return offsets(found.join(bad, "fragment_id", "left_anti").drop("start", "end"), ["file"], ["frag_idx"], "text")


def manifest_entries(units: DataFrame) -> DataFrame:
    """The environment settings of a manifest target, of each key the value of most authority."""
    keyed = units.where("category = 'environment' and entity_key is not null")
    best = Window.partitionBy("entity_key").orderBy(F.desc("authority"), F.desc("confidence"), "unit_id")
    return keyed.withColumn("n", F.row_number().over(best)).where("n = 1").select("unit_id", "entity_key", "entity_value")


def verify_manifest(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Entries are checked key and value against their unit, not as running text."""
    own = units.select("unit_id", F.col("entity_key").alias("k"), F.col("entity_value").alias("v"))
    same = F.col("entity_key").eqNullSafe(F.col("k")) & F.col("entity_value").eqNullSafe(F.col("v"))
    return entries.join(own, "unit_id", "left").select("unit_id", F.when(F.col("k").isNull(), "no-unit").when(same, "contained").otherwise("not-contained").alias("status"))


def manifest_json(entries: list[tuple[str, str]]) -> str:
    return hashing.canonical({"env": dict(sorted(entries))})


def category_phrases(units: DataFrame) -> DataFrame:
    """role and a phrase such as "2 commands, 1 constraint"."""
    counts = units.groupBy("role", "category").agg(F.count("*").alias("n"))
    phrase = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("category"), F.when(F.col("n") == 1, "").otherwise("s"))
    return counts.groupBy("role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", phrase.alias("p")))), lambda x: x["p"]), ", ").alias("phrase"))


def condition_met(condition: str, categories: Column) -> Column:
    """An output's condition: hasCategory(name) or nothing."""
    if not condition:
        return F.lit(True)
    import re

    m = re.fullmatch(r"hasCategory\((\w+)\)", condition)
    if not m:
        raise ValueError(f"unknown condition {condition}")
    return F.array_contains(categories, m.group(1))


def conflicts_json(report: list[dict]) -> str:
    return json.dumps(report, ensure_ascii=False, sort_keys=True, indent=2) + "\n"
