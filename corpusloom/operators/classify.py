"""Roles of documents, by weighted signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIE = 0.02
MARGIN = 0.15
UNCERTAIN = 0.1


@dataclass(frozen=True)
class Signal:
    """kind: 'filename', 'heading' (each matching heading counts, up to three), 'body' or
    'structure' (pattern is then the name of a boolean or count feature and least the threshold)."""

    role: str
    kind: str
    weight: int
    pattern: str
    least: int = 1

    def hits(self) -> Column:
        if self.kind == "filename":
            return F.lower("path").rlike(self.pattern).cast("int")
        if self.kind == "heading":
            return F.least(F.lit(3), F.size(F.filter("headings", lambda h: F.lower(h).rlike(self.pattern))))
        if self.kind == "body":
            return F.lower("body").rlike(self.pattern).cast("int")
        return (F.col(self.pattern) >= self.least).cast("int")


#: Our own signals for technical documents.
SIGNALS = (
    Signal("decisionRecord", "filename", 3, r"(^|/)(adr|decisions?)[-/0-9]"),
    Signal("decisionRecord", "heading", 3, r"^(context|decision|consequences)$"),
    Signal("decisionRecord", "body", 1, r"(superseded by|we decided)"),
    Signal("architecture", "filename", 2, r"architect|design"),
    Signal("architecture", "heading", 2, r"component|overview|data ?flow"),
    Signal("architecture", "body", 1, r"(service|module|layer)s? (that|which|talks)"),
    Signal("runbook", "filename", 2, r"runbook|deploy|playbook|operations"),
    Signal("runbook", "heading", 2, r"rollback|restart|on-?call|recovery|deploy"),
    Signal("runbook", "structure", 3, "n_fences", 2),
    Signal("codingConventions", "filename", 2, r"convention|style-?guide|contributing"),
    Signal("codingConventions", "heading", 1, r"naming|formatting|style"),
    Signal("codingConventions", "structure", 3, "n_rules", 3),
    Signal("domainGlossary", "filename", 2, r"glossary|terms"),
    Signal("domainGlossary", "structure", 3, "n_definitions", 3),
    Signal("testPolicy", "filename", 2, r"test"),
    Signal("testPolicy", "heading", 1, r"coverage|unit tests?|testing"),
    Signal("apiContract", "filename", 2, r"api|openapi|endpoint"),
    Signal("apiContract", "heading", 2, r"^(get|post|put|delete) /|endpoint"),
    Signal("productSpec", "heading", 2, r"requirement|user stor|acceptance"),
    Signal("meetingNotes", "filename", 2, r"meeting|minutes|weekly|standup"),
    Signal("meetingNotes", "heading", 1, r"attendees|action items|agenda"),
)


def classify(docs: DataFrame, signals: tuple[Signal, ...] = SIGNALS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """role, margin and distribution of each document: one projection, no join. Documents have
    path, headings (array), body and the structure features that the signals name."""
    roles = sorted({s.role for s in signals})
    score = lambda role: sum((F.lit(s.weight) * F.coalesce(s.hits(), F.lit(0)) for s in signals if s.role == role), F.lit(0))
    scored = docs.withColumn("scores", F.array(*(F.struct(score(r).cast("double").alias("score"), F.lit(r).alias("role")) for r in roles)))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x["score"])
    shares = F.array_sort(F.transform(F.filter("scores", lambda x: x["score"] > 0), lambda x: F.struct((-x["score"] / F.col("total")).alias("minus"), x["role"].alias("role"))))
    ranked = scored.withColumn("total", total).withColumn("ranked", F.when(F.col("total") > 0, shares).otherwise(F.array(F.struct(F.lit(-1.0).alias("minus"), F.lit("unknown").alias("role")))))
    first, second = F.element_at("ranked", 1), F.coalesce(-F.get(F.col("ranked"), F.lit(1))["minus"], F.lit(0.0))
    margin = -first["minus"] - second
    return ranked.withColumn("margin", margin).select(*keep, F.when(F.col("margin") < TIE, "unknown").otherwise(first["role"]).alias("role"), "margin", (F.col("margin") < UNCERTAIN).alias("uncertain"), F.transform("ranked", lambda x: F.struct(x["role"].alias("role"), (-x["minus"]).alias("share"))).alias("distribution"))


def apply_opinion(classified: DataFrame, opinions: DataFrame, margin: float = MARGIN) -> DataFrame:
    """A given opinion (doc_id, opinion; the least of several) replaces the role if the rules gave it a
    share and it is less than margin behind the first. decided_by: 'model' where it did, else 'rule'."""
    one = opinions.groupBy("doc_id").agg(F.min("opinion").alias("opinion"))
    joined = classified.join(one, "doc_id", "left")
    share = F.get(F.filter("distribution", lambda x: x["role"] == F.col("opinion")), F.lit(0))["share"]
    near = F.coalesce((F.element_at("distribution", 1)["share"] - share < margin) & (share > 0) & (F.col("opinion") != F.col("role")), F.lit(False))
    return joined.withColumn("decided_by", F.when(near, "model").otherwise("rule")).withColumn("role", F.when(near, F.col("opinion")).otherwise(F.col("role"))).drop("opinion")
