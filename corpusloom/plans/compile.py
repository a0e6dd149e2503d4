"""A corpus of documents compiled into a context file: classify, extract, merge, budget, assemble,
verify."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble, budget, classify, conflicts, dedup, extract, manifest, profiles, tree, verify
from ..sources.markdown import read_markdown
from .store import written


@dataclass
class Compiled:
    """What a run made, as tables. pairs: the shortlist with what became of each; violations: scaffold that
    its profile does not allow; traced: the emitted lines and whether each rests on units; manifest: sources, units,
    files and spans; extracted: what a later run takes as its previous units. What is emitted (placed and all
    after it) is made when it is first asked for."""

    docs: DataFrame
    profile: dict
    roles: DataFrame
    units: DataFrame
    conflicts: DataFrame
    conflict_sides: DataFrame
    conflict_report: DataFrame
    pairs: DataFrame | None
    extracted: DataFrame

    @cached_property
    def placed(self) -> DataFrame:
        profile, limits = self.profile, self.profile["budget"]
        routed = budget.unit_order(budget.route(self.units, profiles.sections(self.docs.sparkSession, profile)), ["section"], "path", "unit_order", "unit_id")
        priced = routed.withColumn("tokens", T.count_tokens(F.concat_ws(" ", "text", "rationale"), limits["chars_per_token"])).withColumn("target", F.lit(profile["id"])).withColumn(
            "value", budget.value_of(F.coalesce("weight", F.lit(1.0)), F.col("authority"), F.col("confidence"), F.size("sources"))
        )
        return written(budget.fill(priced, "target", [F.desc("value"), "section_idx", "position"], limits["primary"], limits["secondary"], limits["overflow"]), "placed")

    def _check(self, pieces: DataFrame) -> DataFrame:
        claim = self.units.select("unit_id", F.concat_ws(" ", "text", "rationale").alias("text"))
        return verify.check_fragments(pieces.where("size(unit_ids) > 0"), claim)

    @cached_property
    def fragments(self) -> DataFrame:
        several = self.profile["kind"] in ("skills", "commands")
        found = written((assemble.partitioned if several else assemble.fragments)(self.placed, self.profile), "fragments")
        return written(assemble.drop_unsupported(found, self._check(found)), "kept")

    @cached_property
    def checked(self) -> DataFrame:
        return self._check(self.fragments)  # once more, on what will be written

    @cached_property
    def files(self) -> DataFrame:
        return assemble.files(self.fragments)

    @cached_property
    def violations(self) -> DataFrame:
        return verify.scaffold_violations(self.fragments, self.profile)

    @cached_property
    def traced(self) -> DataFrame:
        return verify.coverage(self.fragments, self.checked, self.files)

    @cached_property
    def sources(self) -> DataFrame:
        return manifest.source_rows(self.docs, self.roles, self.units)

    @cached_property
    def spans(self) -> DataFrame:
        return manifest.provenance(self.fragments, self.units)

    @cached_property
    def manifest(self) -> dict[str, DataFrame]:
        return {"sources": self.sources, "units": self.units, "files": manifest.file_rows(self.files, self.profile["id"]), "spans": self.spans}

    def passed(self, required: float = 1.0) -> bool:
        """The gate: enough of the lines are traced, and no scaffold is out of place."""
        share = self.traced.agg(F.avg((F.col("state") == "supported").cast("double"))).first()[0]
        return (share is None or share >= required) and self.violations.isEmpty()

    def manifest_json(self) -> str:
        m = self.manifest
        return manifest.document(m["sources"], m["units"], m["files"], m["spans"], self.conflict_sides)


@dataclass
class Previous:
    """sources: path, content_hash; units: what that run extracted."""

    sources: DataFrame
    units: DataFrame


def features(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """What the signals read: path, headings, body and counts of structures."""
    per = blocks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "heading", F.struct("ord", "text")))).alias("h"),
        F.sum((F.col("type") == "code").cast("int")).alias("n_fences"),
        F.sum(((F.col("type") == "heading") & F.lower("text").rlike(r"^rule[ :-]*[0-9]+")).cast("int")).alias("n_rules"),
        F.sum(F.col("text").rlike(r"^\S[^—–]{0,59}?\s*[—–]\s+\S").cast("int")).alias("n_definitions"),
    )
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "path", F.col("text").alias("body")).join(per, "doc_id", "left").withColumn("headings", F.coalesce(F.transform("h", lambda x: x["text"]), F.array().cast("array<string>"))).drop("h")


def _extract(docs: DataFrame, roles: DataFrame, blocks: DataFrame) -> DataFrame:
    about = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "path", T.authority(F.col("reviewed")).alias("authority")).join(roles.select("doc_id", "role"), "doc_id")
    return extract.extract_units(blocks, roles).join(about, "doc_id")


def compile_corpus(
    docs: DataFrame, profile: dict = profiles.BASE, signals=classify.SIGNALS, extra_units: DataFrame | None = None, embeddings: DataFrame | None = None,
    answers: DataFrame | None = None, opinions: DataFrame | None = None, previous: Previous | None = None, threshold: float = 0.72, cap: int = dedup.PAIR_CAP,
) -> Compiled:
    """docs: doc_id, path, text, reviewed (date or null). What a model would say comes as tables: opinions
    (doc_id, opinion) on roles, embeddings (unit_id, embedding) and answers (a, b, same_fact,
    surviving_text) on pairs of units. Of sources that a previous run saw with the same content the
    units are taken over, not extracted anew. Each part's result is written (store), not kept in memory."""
    spark = docs.sparkSession
    docs = docs.withColumn("content_hash", F.sha2("text", 256))
    fresh = docs if previous is None else manifest.to_process(docs, previous.sources, "path", "content_hash")
    blocks = written(tree.blocks_in_order(read_markdown(docs)), "blocks")
    roles = classify.classify(features(blocks, docs), signals)
    roles = classify.apply_opinion(roles, opinions) if opinions is not None else roles.withColumn("decided_by", F.lit("rule"))
    roles = written(roles, "roles")
    units = _extract(fresh, roles, blocks if previous is None else blocks.join(fresh.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi"))
    if previous is not None:
        same = docs.join(previous.sources.select("path", "content_hash"), ["path", "content_hash"], "left_semi").select("path")
        units = units.unionByName(previous.units.join(same, "path", "left_semi"), allowMissingColumns=True)
    units = extracted = written(units, "units")
    if extra_units is not None:
        units = units.unionByName(extra_units, allowMissingColumns=True)
    keyed = units.withColumn("norm", T.normalize_unit(F.col("text"), compose=False)).withColumn("source", F.struct("path", "unit_order"))
    first = ["path", "unit_order"]
    merged = dedup.merge_restatements(keyed, ["category", "norm"], first)
    heads = keyed.groupBy("category", "norm").agg(F.min(F.struct("path", "unit_order", "unit_id", "role", "entity_key", "entity_value", "content_hash")).alias("f"))
    merged = merged.drop("path").join(heads, ["category", "norm"]).select("category", "text", "rationale", "authority", "confidence", "sources", "f.*")
    merged = written(merged, "merged")
    pairs = None
    if embeddings is not None:
        pairs = dedup.shortlist(merged.withColumn("first", F.struct(*first)), embeddings, threshold, cap)
        none = spark.createDataFrame([], "a string, b string, same_fact boolean, surviving_text string")
        pairs = written(dedup.decide(pairs, answers if answers is not None else none), "pairs")
        merged = dedup.resolve_merges(merged, dedup.absorb(pairs.where("state = 'merge'")))
    sided = merged.select("unit_id", "category", "entity_key", "entity_value", "authority", F.explode("sources").alias("s")).select("*", F.col("s.path").alias("path"))
    entity = ["category", "entity_key"]
    groups = conflicts.entity_groups(sided, entity, "entity_value", "path")
    against = conflicts.conflicts_with(sided.dropDuplicates(["unit_id"]), entity, "entity_value", "path")
    merged = written(merged.join(against, "unit_id", "left"), "resolved")
    report = conflicts.report(groups)
    return Compiled(docs, profile, roles, merged, groups, conflicts.sides(sided, entity, "entity_value", "path"), report, pairs, extracted)
