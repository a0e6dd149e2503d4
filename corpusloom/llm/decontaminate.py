"""Operator 7: benchmark passages in documents, by one Aho-Corasick automaton.

Normalised text is the runs of word characters (\\w) in order, lower case, one space between. The
patterns are every run of WORDS words of a normalised benchmark item (its question and its answer
are one text here), or the whole item where it is shorter, with a space at either end so that
matches keep to word boundaries. Each document is scanned once. Matches of one item that overlap or
adjoin merge into one passage; its ends are mapped to character offsets of the original text.

The automaton is built in each Python worker from a broadcast list of patterns, whose size follows
the benchmark, not the corpus; a benchmark whose patterns exceed MAX_CHARS is split over several
automata and scans.

Defined results: doc_id and item_id are numbers; null or empty texts and documents with null doc_id
have no passages; null or word-less items are no patterns; items with equal texts are all reported;
passages of several items that end alike (ties) are each reported; repeated rows repeat their
passages, and rows that share a doc_id go together in drop_contaminated; texts of any length are
scanned whole; an empty table on either side gives an empty result; other columns, whatever their
names, are ignored, or pass through drop_contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, released

WORDS = 13
MAX_CHARS = 64_000_000
_SEPARATOR = re.compile(r"\W+")
_WORD = re.compile(r"\w+")
_BUILT: dict[int, object] = {}


def normalise(text: str) -> str:
    return " " + _SEPARATOR.sub(" ", text).strip(" ").lower() + " "


def patterns(items: list[tuple[int, str | None]], words: int = WORDS) -> dict[str, list[int]]:
    """Each pattern with the ids of the items that hold it."""
    out: dict[str, list[int]] = {}
    for item, text in items:
        own = normalise(text or "").split()
        for i in range(max(1, len(own) - words + 1)) if own else ():
            held = out.setdefault(f" {' '.join(own[i : i + words])} ", [])
            if item not in held:
                held.append(item)
    return out


def automaton(found: dict[str, list[int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, ids in found.items():
        a.add_word(p, (len(p), p.count(" ") - 1, ids))
    a.make_automaton()
    return a


def passages(text: str, machine) -> list[tuple[int, int, int]]:
    """item_id, start, end (characters of text, end exclusive) of each passage."""
    norm = normalise(text)
    hits = list(machine.iter(norm)) if len(machine) else []
    if not hits:
        return []
    spaces = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 32)
    spans: dict[int, list[list[int]]] = {}
    for end, (length, n, ids) in hits:
        first = int(np.searchsorted(spaces, end - length + 1))  # the word after that space
        for item in ids:
            runs = spans.setdefault(item, [])
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], first + n)
            else:
                runs.append([first, first + n])
    words = [m.span() for m in _WORD.finditer(text)]
    return [(item, words[a][0], words[b - 1][1]) for item, runs in spans.items() for a, b in runs]


def _scan(shared, name: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = automaton(shared.value)
        machine = _BUILT[name]
        for b in batches:
            out = [(doc, *p) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in passages(text, machine)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "start", "end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, item_id, start, end of every benchmark passage in docs."""
    if words < 1:
        raise ValueError("words must be positive")
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-size * words // max_chars) or 1
    scans = []
    for s in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).orderBy("item_id", "text").collect()  # at most max_chars of patterns
        shared = spark.sparkContext.broadcast(patterns([(r["item_id"], r["text"]) for r in rows], words))
        scans.append(text.mapInArrow(released(_scan(shared, shared._jbroadcast.id())), "doc_id long, item_id long, start long, end long"))
    return reduce(DataFrame.unionByName, scans)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark passage; rows with null doc_id stay."""
    name = fresh(docs, "gone")
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), grams AS (
  SELECT DISTINCT item_id, least(len(ws), {WORDS}) AS n, array_to_string(ws[p + 1 : p + least(len(ws), {WORDS})], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - {WORDS} + 1))) AS p FROM items WHERE len(ws) > 0)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), pieces AS (
  SELECT rid, piece, ord, sum(length(piece)) OVER (PARTITION BY rid ORDER BY ord) - length(piece) AS off
  FROM (SELECT rid, unnest(x) AS piece, unnest(range(len(x))) AS ord FROM (SELECT rid, regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_]+') AS x FROM docs))
), words AS (
  SELECT rid, off, off + length(piece) AS stop, row_number() OVER (PARTITION BY rid ORDER BY ord) - 1 AS w
  FROM pieces WHERE regexp_matches(piece, '^[\\pL\\pN_]')
), doc_grams AS (
  SELECT rid, p, n, array_to_string(ws[p + 1 : p + n], ' ') AS g
  FROM (SELECT rid, n, ws, unnest(range(len(ws) - n + 1)) AS p
        FROM (SELECT rid, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS ws FROM docs), (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n)
), hits AS (
  SELECT rid, item_id, p, p + d.n AS q FROM doc_grams d JOIN grams g ON d.g = g.g AND d.n = g.n
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid, item_id ORDER BY p) AS island
  FROM (SELECT *, CASE WHEN p <= lag(q) OVER (PARTITION BY rid, item_id ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM hits)
), spans AS (
  SELECT rid, item_id, min(p) AS p, max(q) AS q FROM islands GROUP BY rid, item_id, island
)
SELECT d.doc_id, s.item_id, CAST(a.off AS BIGINT) AS start, CAST(b.stop AS BIGINT) AS "end"
FROM spans s JOIN docs d ON d.rid = s.rid JOIN words a ON a.rid = s.rid AND a.w = s.p JOIN words b ON b.rid = s.rid AND b.w = s.q - 1
"""
