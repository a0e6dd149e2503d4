"""Operator 3: near-duplicate documents, by SetSketch registers.

A document's set is its distinct word 3-grams (of a shorter document its whole word sequence).
Register i is floor(1 - log_b h) for the least h of Exp(a) values of the set, truncated to 16 bits;
registers of a union are the maxima of the parts' registers, and equal registers are about as
likely as the sets' Jaccard similarity is high. Documents are in one group if they are connected
by pairs of Jaccard similarity of at least ``threshold``; all but the least doc_id of a group go.

The default threshold: of a text in which one word in k is replaced, (1 - 1/k) ** 3 of the 3-grams stay, s,
and the Jaccard similarity is s / (2 - s). At 0.45 that is one word in seven; 80 bands of 4
registers find such a pair with probability 0.97, a pair at 0.55 with 0.9995. A group is connected, so
that its ends may share less; that is how copies of copies are one group.

Plan: (1) one scan makes sketch and set hash; (2) equal sets collapse by hash; (3) 80 bands of 4
registers are shuffled once; each bucket links its members to its least one; (4) links are
estimated by joint likelihood from both sketches and cardinalities, each document's best link is
verified on the texts, and the verified links connect; (5) buckets whose members are still in
several components are cut into a grid of cells of at most CELL members a side, and
the members' sketches are sent to their cells once: there unconnected pairs of fitting sizes are
estimated, block by block, and only the likely ones leave and are verified. A pair inside a component cannot
change it, so that what is skipped loses nothing; a bucket of thousands of copies costs thousands of
links, one of thousands of different texts thousands of sketches a cell.

Defined results: doc_id is a number; null or word-less texts are in no group and stay; rows with null
doc_id stay; rows that share a doc_id are one document, near another if any of their texts is, and stay or
go together; of equals the least doc_id stays (no other ties arise); texts of any length are read
whole; an empty table gives no groups; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dense
from . import textvec as tv
from .components import components
from .shared import discard, fresh, materialize, released

K = 3
THRESHOLD = 0.45
BANDS, ROWS = 80, 4
M = BANDS * ROWS
B, A, Q = 1.001, 20.0, 65534
MARGIN = 0.09  # three standard errors of the estimate
CELL = 2048
_PAIRS = 1 << 14
_SLICE = 1 << 18
_FACTORS = tv.mix64(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(t: tv.Tokens, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word k-grams, and their offsets."""
    counts = np.diff(t.bounds)
    grams = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    size = np.minimum(counts, k)
    starts = tv.ragged_range(t.bounds[:-1], grams)
    h = tv.run_hashes(t.hashes, starts, starts + np.repeat(size, grams)) if len(starts) else np.empty(0, dtype=np.uint64)
    return h, np.concatenate(([0], np.cumsum(grams)))


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x M, uint16) of each non-empty run."""
    least = np.empty((M, len(bounds) - 1), dtype=np.uint64)
    buf = np.empty_like(h)
    for i in range(M):
        np.multiply(h, _FACTORS[i], out=buf)
        np.minimum.reduceat(buf, bounds[:-1], out=least[i])
    exp = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(np.maximum(exp, 1e-300)) / math.log(B)), 0, Q + 1).astype(np.uint16)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in tv.tokenize(b.column(1), tv.WORD_TOKENS, _SLICE):
            h, bounds = shingles(t)
            has = np.flatnonzero(np.diff(bounds) > 0)
            ids = b.column(0).slice(t.first, t.last - t.first).take(pa.array(has))
            d, cut = tv.distinct_in_runs(h, np.append(bounds[has], len(h)))
            s1, s2 = tv.sum_runs(tv.mix64(d), cut), tv.sum_runs(tv.mix64(d ^ np.uint64(0x5BD1E995)), cut)
            regs = registers(tv.mix64(d), cut) if len(has) else np.empty((0, M), dtype=np.uint16)
            yield pa.RecordBatch.from_arrays([ids, pa.array(tv.signed(s1)), pa.array(tv.signed(s2)), pa.array(np.diff(cut).astype(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "s1", "s2", "n", "regs"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        packed = regs[..., 0] | regs[..., 1] << np.uint64(16) | regs[..., 2] << np.uint64(32) | regs[..., 3] << np.uint64(48)
        band = tv.mix64(tv.mix64(packed) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_FACTORS[0]))
        yield pa.RecordBatch.from_arrays([pa.array(tv.signed(band.reshape(-1))), pa.array(np.repeat(ids, BANDS))], names=["band", "doc_id"])


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of Jaccard similarity from pairs of sketches."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = M - more - less
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B), 1e-12)
    def gain(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        c, d = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = gain(c) < gain(d)
        lo, hi = np.where(up, c, lo), np.where(up, hi, d)
    return (lo + hi) / 2


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            read = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, M)
            n = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            j = estimate(read("ra"), read("rb"), *n)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(j)], names=["a", "b", "j"])


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """a, b, j of the pairs whose estimate does not rule the threshold out."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("regs").alias("r" + x))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    return sized.mapInArrow(_estimated, "a long, b long, j double").where(F.col("j") >= threshold - MARGIN)


def _in_cells(threshold: float):
    """a, b of the likely pairs of rows (band, p, q, at, doc_id, root, n, regs) sorted by cell: of members
    of block p with members of block q, or of p with each other if both are one. A cell that reaches
    over batches is put together."""
    names = ["band", "p", "q", "at", "doc_id", "root", "n"]

    def likely(cols: dict[str, np.ndarray], regs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = np.cumsum(np.append(0, (cols["band"][1:] != cols["band"][:-1]) | (cols["p"][1:] != cols["p"][:-1]) | (cols["q"][1:] != cols["q"][:-1])))
        i, step, held, size = np.arange(len(cell)), 0, [], 0

        def estimated():
            x, y = (np.concatenate(z) for z in zip(*held))
            for at in range(0, len(x), _PAIRS):
                k, m = x[at : at + _PAIRS], y[at : at + _PAIRS]
                near = estimate(regs[k], regs[m], cols["n"][k].astype(float), cols["n"][m].astype(float)) >= threshold - MARGIN
                yield cols["doc_id"][k[near]], cols["doc_id"][m[near]]

        while len(i):
            step += 1
            i = i[i + step < len(cell)]
            i = i[cell[i] == cell[i + step]]
            j = i + step
            n, m = cols["n"][i], cols["n"][j]
            ok = (cols["root"][i] != cols["root"][j]) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
            ok &= (cols["p"][i] == cols["q"][i]) | (cols["at"][i] != cols["at"][j])
            held.append((i[ok], j[ok]))
            size += int(ok.sum())
            if size >= _PAIRS:
                yield from estimated()
                held, size = [], 0
        if size:
            yield from estimated()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[dict[str, np.ndarray], np.ndarray] | None = None

        def pairs(cols, regs) -> Iterator[pa.RecordBatch]:
            for a, b in likely(cols, regs):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, M)
            if rest is not None:
                cols, regs = {c: np.concatenate([rest[0][c], cols[c]]) for c in names}, np.concatenate([rest[1], regs])
            last = (cols["band"] == cols["band"][-1]) & (cols["p"] == cols["p"][-1]) & (cols["q"] == cols["q"][-1])
            cut = len(last) - int(last.sum())
            if cut:
                yield from pairs({c: x[:cut] for c, x in cols.items()}, regs[:cut])
            rest = {c: x[cut:] for c, x in cols.items()}, regs[cut:]
        if rest is not None:
            yield from pairs(*rest)

    return run


def _jaccard(threshold: float):
    def sets(col):
        for t in tv.tokenize(col, tv.WORD_TOKENS, _SLICE):
            h, bounds = tv.distinct_in_runs(*shingles(t))
            yield from (h[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(sets(b.column("ta")), sets(b.column("tb"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return run


def _verified(pairs: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """u, v of the pairs (a table) whose Jaccard similarity is at least threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    own = dense.having(text, wanted, 2 * pairs.count())
    left, right = own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_jaccard(threshold), "u long, v long")


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kept_doc_id: every document that goes, with the one of its group that stays."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    scratch: list[str] = []
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketched = materialize(text.mapInArrow(released(sketch), "doc_id long, s1 long, s2 long, n long, regs binary"), "sketches", scratch)
    same = sketched.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("v"))
    copies = sketched.select("doc_id", "s1", "s2", "n").join(same, ["s1", "s2", "n"]).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v", "s1", "s2")
    copies = materialize(copies, "copies", scratch)
    alone = sketched.join(copies.select(F.col("u").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_anti")

    rows = alone.select("doc_id", "regs").mapInArrow(_bands, "band long, doc_id long").repartition("band")
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last")
    members = materialize(rows.join(shared.select("band", "lead"), "band"), "buckets", scratch)
    stars = members.where("doc_id > lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = materialize(_likely(stars, sketched, threshold), "links", scratch)
    best = Window.partitionBy("b").orderBy(F.desc("j"), "a")
    first = materialize(links.withColumn("r", F.row_number().over(best)).where("r = 1").select("a", "b"), "best", scratch)
    edges = materialize(_verified(first, text, threshold), "verified", scratch)
    root = components(edges)

    known = members.join(root, members["doc_id"] == root["node"], "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    open_ = known.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / CELL).cast("int").alias("side")).where("x < y").select("band", "side")
    placed = known.join(open_, "band").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.col("side")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other")).select("band", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"), "at", "doc_id", "root")
    rows = cells.join(sketched.select("doc_id", "n", "regs"), "doc_id").select("band", "p", "q", "at", "doc_id", "root", "n", "regs")
    sorted_ = rows.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "doc_id")
    pairs = sorted_.mapInArrow(released(_in_cells(threshold)), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    more = materialize(pairs, "rest", scratch)
    every = copies.select("u", "v").unionByName(edges).unionByName(_verified(more, text, threshold))
    groups = components(every)
    discard(docs.sparkSession, scratch)
    return groups.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    name = fresh(docs, "gone")
    gone = duplicates(docs, threshold).select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
