"""Documents to training data: each stage works on all documents that the one before it kept.

Toxic documents go; lines that an earlier line matches go, and with them documents of which nothing
is left; of near-duplicate documents one stays; documents with benchmark passages go; what remains is
encoded. Every stage but the last returns the columns of its input, n_chars brought up to date.

Defined results: rows with null doc_id pass every filter; null texts are kept, and encode to null;
empty texts are kept as long as no line was cut from them; repeated rows and rows that share a
doc_id are judged as each operator's docstring says (line dedup by row, near dedup by doc_id);
texts of any length are read whole; ties fall to the least doc_id; empty tables give empty results;
further columns of documents, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, line_dedup, near_dedup, sentencepiece_codec, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, shared.table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    n = done.columns[-1]
    done = done.where((F.col(n) == 0) | F.col("text").rlike("[^ \\t\\n\\r\\f\\u000b]"))
    changed = F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL expresses neither the trained classifier nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    held: list[str] = []
    for name, stage in STAGES[:-1]:
        before, held = held, []
        docs = shared.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", held)
        shared.discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
