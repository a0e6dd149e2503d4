"""Operator 5: license texts in documents, by diagonal voting.

Words are runs of ASCII letters and digits and of non-ASCII characters, case folded. All rolling
word k-grams of all documents are hashed and joined, in Spark, to the positions that hold them in
the templates; a hit votes for the diagonal document position minus template position. Votes are
summed per diagonal; diagonals of a document and template that lie within SLACK of the next merge
(an inserted or dropped word moves the rest to a neighbouring diagonal). A merged span whose votes
reach MIN_VOTES of the template's k-grams is verified; where that finds nothing, so are spans that
follow each other in the order of the template and together are no longer than verification allows
(a page header within a license moves the rest to a far diagonal). To verify: its words, with some to either side, are
aligned with the template's, and the share of the template's words found in order must reach
COVERAGE; a template under SHORT words must be there word for word, and each place where it is counts. Of verified spans that overlap,
those with the most words found are reported, of equal ones those with the highest share.

Plan: one scan explodes the k-grams into the join, whose template side is broadcast after a check
of its size (it depends on the templates alone); what remains is a few rows for the documents with
votes, which alone are shuffled for verification, after a second scan by a bitmap of their ids.

Defined results: doc_id is a number; null, empty and word-less texts and documents with null doc_id have
no licenses; rows that share a doc_id but not a text are told apart by the text's hash, repeated rows are
each reported; of templates with equal claims to a span (ties) all are reported; texts of any length are
read whole; an empty table gives no licenses; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import namedtuple
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dense
from . import textvec as tv
from .license_templates import TEMPLATES
from .shared import materialize, released

K = 3
SLACK = 6
MIN_VOTES = 0.3
COVERAGE = 0.85
SHORT = 12
BROADCAST_ROWS = 2_000_000
Block = namedtuple("Block", "b size")


def _grams(t: tv.Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    return tv.window_hashes(t.hashes, t.bounds, k)


def text_keys(t: tv.Tokens) -> np.ndarray:
    """A hash of each row's words in order."""
    return tv.run_hashes(t.hashes, t.bounds[:-1], t.bounds[1:])


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for t in tv.tokenize(b.column(1), tv.WORD_TOKENS):
                h, bounds = _grams(t, k)
                n = np.diff(bounds)
                pos = tv.ragged_range(np.zeros(len(n), dtype=np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[t.first : t.last], n)), pa.array(tv.signed(np.repeat(text_keys(t), n))), pa.array(pos.astype(np.int32)), pa.array(tv.signed(h))], names=["doc_id", "text_key", "pos", "gram"])

    return run


def _words(text: str) -> list[bytes]:
    t = next(tv.tokenize(pa.array([text]), tv.WORD_TOKENS), None)
    return [] if t is None else [t.data[a:b].tobytes().lower() for a, b in zip(t.starts.tolist(), t.ends.tolist())]


def read_templates(folder: str) -> list[tuple[str, str, str]]:
    """Whole license texts of a folder, one file each, as templates named after their files, to be
    added to TEMPLATES where bodies of the longest licenses are wanted too."""
    import os

    return [(f"{name}-file", name, open(os.path.join(folder, name), encoding="utf-8", errors="replace").read()) for name in sorted(os.listdir(folder)) if os.path.isfile(os.path.join(folder, name))]


def template_rows(templates, k: int) -> list[tuple[int, int, int]]:
    """gram, template number, position."""
    out = []
    for i, (_, _, text) in enumerate(templates):
        for t in tv.tokenize(pa.array([text]), tv.WORD_TOKENS):
            h, _ = _grams(t, k)
            out += [(int(x), i, p) for p, x in enumerate(tv.signed(h))]
    return out


def _verify(templates, k: int):
    names = ["doc_id", "template", "license", "start", "end", "coverage"]
    words = [_words(text) for _, _, text in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = next(tv.tokenize(pa.array([text]), tv.WORD_TOKENS))
                key = int(tv.signed(text_keys(t))[0])
                own = []
                for i, group in groupby((s for s in spans if s["text_key"] == key), key=lambda s: s["template"]):
                    own += [(i, x) for x in verified(t, words[i], list(group), k)]
                out += [(doc, *templates[i][:2], *x[:3]) for i, x in foremost(own)]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], x) for i, x in enumerate(kinds)], names=names)

    return run


def foremost(found: list[tuple[int, tuple]]) -> list[tuple[int, tuple]]:
    """Without those that overlap one with more words found, or as many and more of its template, each once."""
    kept: list[tuple[int, tuple]] = []
    taken: list[tuple[int, int]] = []  # disjoint spans, in order, of those with a better claim
    for _, same in groupby(sorted(set(found), key=lambda f: (-f[1][3], -f[1][2], f[1][0], f[0])), key=lambda f: (f[1][3], f[1][2])):
        starts = [s for s, _ in taken]
        free = [f for f in same if not (n := bisect_left(starts, f[1][1])) or taken[n - 1][1] <= f[1][0]]
        kept += free
        spans, taken = sorted(taken + [f[1][:2] for f in free]), []
        for s, e in spans:
            if taken and s <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
    return kept


def longest(template_words: int) -> float:
    """Words that a text with so many words of a template may have."""
    return 1.5 * template_words + SLACK


def verified(t: tv.Tokens, template: list[bytes], spans: list, k: int) -> list[tuple[int, int, float, int]]:
    """What is found in spans of one template, by itself or, if it has SHORT words, joined."""
    least = MIN_VOTES * (len(template) - k + 1)
    found, taken = [], []
    for s in spans:
        if s["votes"] >= least and (own := matches(t, template, s["lo"], s["hi"])):
            found += own
            taken.append((s["lo"], s["hi"]))
    if len(template) < SHORT:
        return found
    for _, lo, hi in sorted(chains(spans, least, longest(len(template)), k), key=lambda c: (-c[0], c[1])):
        if all(hi <= a or z <= lo for a, z in taken) and (x := align(t, template, lo, hi)):
            found.append(x)
            taken.append((lo, hi))
    return found


def chains(spans: list, least: float, most: float, k: int) -> set[tuple[int, int, int]]:
    """votes, lo, hi: for each first span, the spans that follow in the order of text and template
    (words that by chance continue a part may make them overlap by less than k), within ``most``
    words, with the most votes, if there are two or more and they have the least votes."""
    spans = sorted(spans, key=lambda s: (s["lo"], s["hi"]))
    lo, hi, tlo, thi, votes = (np.array([s[c] for s in spans], dtype=np.int64) for c in ("lo", "hi", "tlo", "thi", "votes"))
    out = set()
    for i, end in enumerate(np.searchsorted(lo, lo + most, side="right").tolist()):
        if end - i < 2 or votes[i:end].sum() < least:
            continue
        best = np.zeros(end - i, dtype=np.int64)  # votes of the best chain from i to each span; 0 if none
        best[0] = votes[i]
        for j in range(i + 1, end):
            if hi[j] - lo[i] > most:
                continue
            before = best[: j - i] * ((hi[i:j] - k < lo[j]) & (thi[i:j] - k < tlo[j]))
            if before.any():
                best[j - i] = before.max() + votes[j]
        last = int(best[1:].argmax()) + 1
        if best[last] >= least:
            out.add((int(best[last]), int(lo[i]), int(hi[i + last])))
    return out


def matches(t: tv.Tokens, template: list[bytes], lo: int, hi: int) -> list[tuple[int, int, float, int]]:
    """As align, but of a template under SHORT words every place where it is."""
    if len(template) >= SHORT:
        x = align(t, template, lo, hi)
        return [x] if x else []
    a, words = _around(t, lo, hi)
    n = len(template)
    at = [a + i for i in range(len(words) - n + 1) if words[i : i + n] == template]
    chars = np.append(0, np.cumsum((t.data & 0xC0) != 0x80))  # code points before each byte
    return [(int(chars[t.starts[i]]), int(chars[t.ends[i + n - 1]]), 1.0, n) for i in at]


def _around(t: tv.Tokens, lo: int, hi: int) -> tuple[int, list[bytes]]:
    """Number of the first of words lo to hi and some to either side, and the words."""
    a, z = max(0, lo - SLACK - 1), min(len(t.starts), hi + SLACK + 1)
    return a, [t.data[s:e].tobytes().lower() for s, e in zip(t.starts[a:z].tolist(), t.ends[a:z].tolist())]


def align(t: tv.Tokens, template: list[bytes], lo: int, hi: int) -> tuple[int, int, float, int] | None:
    """start, end (characters), coverage and number of words found of the template in words lo to
    hi of the one text of t, if it reaches what verification asks."""
    a, words = _around(t, lo, hi)
    blocks = [Block(x.b, x.size) for x in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if x.size]
    found = sum(x.size for x in blocks)
    share = found / len(template)
    if len(template) < SHORT:
        at = next((i for i in range(len(words) - len(template) + 1) if words[i : i + len(template)] == template), None)
        blocks = [] if at is None else [Block(at, len(template))]
        found, share = len(template), 1.0
    if not blocks or share < COVERAGE:
        return None
    first, last = a + blocks[0].b, a + blocks[-1].b + blocks[-1].size - 1
    if last - first + 1 > longest(len(template)):
        return None
    chars = lambda n: len(t.data[:n].tobytes().decode())
    return chars(t.starts[first]), chars(t.ends[last]), round(share, 4), found


def licenses(docs: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, template, license, start, end, coverage of every license text found."""
    spark = docs.sparkSession
    for name, _, text in templates:
        if len(_words(text)) < k:
            raise ValueError(f"template {name} has fewer than {k} words")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = template_rows(templates, k)
    places = spark.createDataFrame(rows, "gram long, template int, tpos int")
    grams = text.mapInArrow(released(_scan(k)), "doc_id long, text_key long, pos int, gram long")
    hits = grams.join(F.broadcast(places) if len(rows) <= BROADCAST_ROWS else places, "gram")
    by = ["doc_id", "text_key", "template"]
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*by, "diagonal").agg(F.count_distinct("pos").alias("votes"), F.min("pos").alias("lo"), (F.max("pos") + k).alias("hi"))
    order = Window.partitionBy(*by).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True)).cast("int")
    merged = (
        votes.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(order))
        .groupBy(*by, "island")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("lo") - F.col("diagonal")).alias("tlo"), F.max(F.col("hi") - F.col("diagonal")).alias("thi"))
    )
    sizes = [len(_words(own)) for _, _, own in templates]
    of = lambda values: F.create_map(*(F.lit(x) for pair in enumerate(values) for x in pair))[F.col("template")]
    least = F.lit(MIN_VOTES) * of([n - k + 1 for n in sizes])
    # Spans that could be joined start less than a text's longest length apart: 1000 of these parts.
    part = F.floor(F.col("lo") * 1000 / of([longest(n) for n in sizes])).cast("long")
    near = F.sum("votes").over(Window.partitionBy(*by).orderBy("part").rangeBetween(-1001, 1001))
    joinable = of([n >= SHORT for n in sizes]) & (F.col("near") >= least)
    spans = merged.withColumn("part", part).withColumn("near", near).where((F.col("votes") >= least) | joinable)
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("text_key", "template", "lo", "hi", "tlo", "thi", "votes"))).alias("spans"))
    per_doc = materialize(per_doc, "license-spans")
    own = dense.having(text, per_doc, per_doc.count())
    return own.join(per_doc, "doc_id").select("doc_id", "text", "spans").mapInArrow(_verify(templates, k), "doc_id long, template string, license string, start long, end long, coverage double")


def query(spark, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
