"""Operator 1: near-duplicate lines, by an exact set-similarity join.

A line is the text between two newlines; its set is its distinct white-space separated tokens.
Lines are ordered by (doc_id, row, line_no), where row is a hash of the row's whole text, so that
rows that share a doc_id are told apart. A line is removed if an earlier line of the corpus has
Jaccard similarity of at least ``threshold`` with it, whether that line itself stays or not.

Plan: (1) one scan hashes each line's set, counts tokens and sums what will be shuffled; (2) lines
with equal sets collapse by hash; (3) a second scan orders each set's tokens by rarity and emits
only its prefix, with set size, position and 128 parity bits, dealt by token as packed arrays to
as many groups as keep each near GROUP_BYTES; a token in more than HOT lines is dealt to a
grid of groups, of which every two of its lines share one; (4) each group joins its postings on
the token under the length, positional and bitmap filters, all lossless, and returns pairs in
batches; (5) the remaining pairs are verified on their tokens; (6) keys that lose lines join the
lines, and removed line numbers join the documents once.

Rarity is a class of the token's count in a table of ``cells`` counts (dense.py; a byte each is
broadcast), then the hash: any fixed total order keeps the join exact, sharing a cell only weakens
it. A token counted once in the whole corpus cannot be shared and is not emitted.

Defined results: doc_id is a number; null text stays null; a line without tokens, the empty text's
included, stays; documents with null doc_id are left alone and match nothing; rows with the same
doc_id and different texts are different documents; rows with equal doc_id and text are one
document that stands repeatedly: they lose the same lines and don't match each other; of equal
lines the first stays (ties cannot occur, the order is total); texts and lines of any length are
treated whole; an empty table gives an empty table; other columns, whatever their names, pass
through. Removing every line of a text leaves ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dense
from . import textvec as tv
from .shared import discard, fresh, materialize, parts, released

THRESHOLD = 0.8
CELLS = 1 << 24
GROUP_BYTES = 32 << 20
HOT = 1 << 17
GRID = 32
_SEEN = 1 << 20
_HELD = 1 << 21


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(49 - cells.bit_length())).astype(np.int64)


def _lines(t: tv.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the slice, number in the row, and byte offset of each line."""
    newline = np.flatnonzero(t.data == 10)
    count = np.diff(np.searchsorted(newline, t.rows)) + 1
    row = np.repeat(np.arange(len(count)), count)
    number = tv.ragged_range(np.zeros(len(count), dtype=np.int64), count)
    start = np.empty(len(row) + 1, dtype=np.int64)
    start[:-1][number == 0] = t.rows[:-1]
    start[:-1][number > 0] = newline + 1
    start[-1] = len(t.data)
    return row, number, start


def _sets(text: pa.Array) -> Iterator[tuple]:
    """Of each slice: the tokens' slice, its lines, their distinct hashes, offsets and set keys."""
    for t in tv.tokenize(text, tv.SPACE_TOKENS):
        row, number, start = _lines(t)
        h, bounds = tv.distinct_in_runs(t.hashes, np.searchsorted(t.starts, start))
        n = np.diff(bounds)
        key = tv.mix64(tv.sum_runs(tv.mix64(h + np.uint64(1)), bounds) + n.astype(np.uint64))
        yield t, row, number, start, h, bounds, n, key


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a set's n rarest tokens a similar set must share one of."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _count(counts: np.ndarray, seen: list) -> None:
    """Add the cells seen to the counts, in ascending order, which spares the memory's caches; empties seen."""
    x = np.sort(np.concatenate(seen)) if seen else np.empty(0, dtype=np.int32)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    counts[x[first]] += np.diff(np.append(first, len(x))).astype(np.uint32)
    seen.clear()


def _scan(threshold: float, cells: int):
    names = ["doc_id", "row", "line_no", "key", "load", "block", "cells", "counts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, load, seen, held = np.zeros(cells, dtype=np.uint32), 0, [], 0
        for b in batches:
            ids, rows = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for t, row, number, _, h, _, n, key in _sets(b.column(2)):
                seen.append(_cell(h, cells).astype(np.int32))
                held += len(h)
                if held > _HELD:
                    _count(counts, seen)
                    held = 0
                has = n > 0
                m = int(has.sum())
                load += int(_prefix(n[has], threshold).sum()) * POSTING.itemsize
                own = [ids[t.first : t.last][row[has]], rows[t.first : t.last][row[has]], number[has].astype(np.int32), tv.signed(key[has])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, own), *(pa.nulls(m, k) for k in types[4:])], names=names)
        _count(counts, seen)
        found = list(dense.blocks(counts))
        m = len(found)
        sums = pa.array([load] + [None] * (m - 1), pa.int64()) if m else pa.nulls(0, pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, k) for k in types[:4]), sums, *(pa.array([r[i] for r in found], k) for i, k in enumerate(types[5:]))], names=names)

    return run


POSTING = np.dtype([("token", "<u8"), ("key", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("b1", "<u8"), ("b2", "<u8")])


def _grid(level: np.ndarray, hot: int) -> np.ndarray:
    """Into how many blocks each token's lines are cut, by the class of its count."""
    most = 2.0 ** ((level.astype(np.float64) - 1) / 4)
    return np.clip(np.ceil(most / hot), 1, GRID).astype(np.int64)


def _postings(rarity, threshold: float, cells: int, n_parts: int, hot: int):
    def of_slice(classes, seen: set, h, bounds, n, key) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.zeros(len(n), dtype=bool)
        for i, k in enumerate(key.tolist()):  # equal lines of a task are emitted once
            if n[i] and k not in seen:
                seen.add(k)
                fresh[i] = True
        if len(seen) > _SEEN:  # what is emitted again is dropped by the join
            seen.clear()
        b1, b2 = tv.parity_bitmaps(h, bounds)
        run_of = np.repeat(np.arange(len(n)), n)
        level = classes[_cell(h, cells)]
        # By class, then hash, within a line: of no line are there more than 2 ** 31 tokens.
        order = np.argsort((run_of << 8) | level, kind="stable")
        pos = tv.ragged_range(np.zeros(len(n), dtype=np.int64), n)
        take = fresh[run_of] & (pos < _prefix(n, threshold)[run_of]) & (level[order] > 1)
        line, out = run_of[take], np.empty(int(take.sum()), dtype=POSTING)
        out["token"], out["key"], out["n"], out["pos"], out["b1"], out["b2"] = h[order[take]], key[line], n[line], pos[take], b1[line], b2[line]
        return out, _grid(level[order[take]], hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = rarity.value, set()
        for b in batches:
            found = [of_slice(classes, seen, h, bounds, n, key) for _, _, _, _, h, bounds, n, key in _sets(b.column(0))]
            rows = np.concatenate([r for r, _ in found]) if found else np.empty(0, dtype=POSTING)
            side = np.concatenate([g for _, g in found]) if found else np.empty(0, dtype=np.int64)
            # Of a token in a grid of side blocks, a line of block x goes to every cell (x, y) or (y, x).
            copy, other = np.repeat(np.arange(len(rows)), side), tv.ragged_range(np.zeros(len(rows), dtype=np.int64), side)
            rows, side = rows[copy], side[copy].astype(np.uint64)
            own, other = rows["key"] % side, other.astype(np.uint64)
            cell = np.minimum(own, other) * np.uint64(GRID) + np.maximum(own, other)
            part = (np.where(side > 1, tv.mix64(rows["token"] + cell * np.uint64(0x9E3779B97F4A7C15)), rows["token"]) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if n_parts < 1 << 16 else part, kind="stable")
            rows, cut = rows[order], np.searchsorted(part[order], np.arange(n_parts + 1))
            filled = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([rows[cut[p] : cut[p + 1]].tobytes() for p in filled], pa.binary())], names=["part", "rows"])

    return run


def _joined(threshold: float):
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), dtype=POSTING) for b in batches for x in b.column("rows")])
        token = rows["token"]
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        shared = np.append(same, False) | np.append(False, same)
        order, token = order[shared[: len(order)]], token[shared[: len(order)]]
        group = np.cumsum(np.append(False, token[1:] != token[:-1])[: len(token)], dtype=np.uint64)
        # Of a line that several tasks emit one stays; then each token's lines are put in order of size.
        key = rows["key"][order]
        again = np.argsort(tv.mix64(key + token * np.uint64(0x9E3779B97F4A7C15)))
        token, key = token[again], key[again]
        fresh = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))[: len(order)]
        again = again[fresh]
        again = again[np.argsort((group[again] << np.uint64(32)) | rows["n"][order[again]])]
        order, token = order[again], group[again]
        key = rows["key"][order]
        n, b1, b2 = rows["n"][order].astype(np.int64), rows["b1"][order], rows["b2"][order]
        left = n - rows["pos"][order]
        i, step, found, held = np.arange(len(order)), 0, [], 0

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)] & (pairs[:, 0] != pairs[:, 1])]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left", "right"])

        while len(i):  # sets of a token ascend in size: the length filter ends each one's run
            step += 1
            i = i[i + step < len(order)]
            j = i + step
            i = i[(token[i] == token[j]) & (n[i] >= threshold * n[j] - 1e-9)]
            j = i + step
            total = n[i] + n[j]
            least = np.ceil(share * total - 1e-9).astype(np.int64)
            ok = np.minimum(left[i], left[j]) >= least
            a, b = i[ok], j[ok]
            differ = np.bitwise_count(b1[a] ^ b1[b]).astype(np.int64) + np.bitwise_count(b2[a] ^ b2[b])
            ok = differ <= (total - 2 * least)[ok]
            x, y = tv.signed(key[a[ok]]), tv.signed(key[b[ok]])
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            held += len(x)
            if held > 1 << 18:
                yield flush()
                found, held = [], 0
        yield flush()

    return run


def _texts(bits, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bits.value, set()
        for b in batches:
            ids, rows = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for t, row, number, start, _, _, n, key in _sets(b.column(2)):
                take = np.flatnonzero((n > 0) & dense.has_bit(wanted, width, key))
                data = t.data.tobytes() if len(take) else b""
                first = [not (k in seen or seen.add(k)) for k in key[take].tolist()]
                if len(seen) > _SEEN:
                    seen.clear()
                lines = [data[start[i] : start[i + 1]].rstrip(b"\n") if new else None for i, new in zip(take.tolist(), first)]
                at = [ids[t.first : t.last][row[take]], rows[t.first : t.last][row[take]], number[take].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(tv.signed(key[take])), *map(pa.array, at), pa.array(lines, pa.binary()).cast(pa.string())], names=["key", "doc_id", "row", "line_no", "line"])

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sides, sizes = [], []
                for c in ("x", "y"):
                    t = next(tv.tokenize(b.column(c), tv.SPACE_TOKENS, 1 << 40))
                    h, bounds = tv.distinct_in_runs(t.hashes, t.bounds)
                    sizes.append(np.diff(bounds))
                    sides.append((np.repeat(np.arange(b.num_rows, dtype=np.uint64), sizes[-1]) << np.uint64(48)) | h)
                shared = np.intersect1d(*sides, assume_unique=True) >> np.uint64(48)
                both = np.bincount(shared.astype(np.int64), minlength=b.num_rows)
                near = both >= threshold * (sizes[0] + sizes[1] - both) - 1e-9
                yield pa.RecordBatch.from_arrays([b.column("key")], names=["key"]).filter(pa.array(near))

    return run


def later_sets(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """key of the later set of every pair whose Jaccard similarity is at least threshold."""
    side = lambda name, line, at: sets.select(F.col("key").alias(name), F.col("line").alias(line), F.col("first").alias(at))
    later = F.when(F.col("f") < F.col("g"), F.col("right")).otherwise(F.col("left"))
    joined = pairs.join(side("left", "x", "f"), "left").join(side("right", "y", "g"), "right").select(later.alias("key"), "x", "y")
    return joined.mapInArrow(_similar(threshold), "key long").distinct()


def row_key(text: str) -> Column:
    """What tells rows that share a doc_id apart: sixty bits of their text's MD5 sum."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, cells: int = CELLS, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, row, line_no of every line that an earlier line matches."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if cells < dense.BLOCK or cells & (cells - 1):
        raise ValueError(f"cells must be a power of two and at least {dense.BLOCK}")
    spark, scratch = docs.sparkSession, []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    text = own.select("doc_id", row_key("text").alias("row"), "text")
    scan = materialize(text.mapInArrow(released(_scan(threshold, cells)), f"doc_id long, row long, line_no int, key long, load long, {dense.SCHEMA}"), "line-scan", scratch)
    lines = scan.where("key is not null").select("doc_id", "row", "line_no", "key")
    load = scan.where("load is not null").agg(F.sum("load")).first()[0] or 0
    n_parts = max(parts(spark), -(-load // group_bytes))
    rarity = spark.sparkContext.broadcast(dense.merge(scan.where("block is not null").select("block", "cells", "counts"), cells, "class"))
    postings = own.select("text").mapInArrow(released(_postings(rarity, threshold, cells, n_parts, hot)), "part int, rows binary").repartitionById(n_parts, "part")
    pairs = postings.groupBy("part").applyInArrow(_joined(threshold), "left long, right long").distinct()
    pairs = materialize(pairs, "line-pairs", scratch)
    wanted = pairs.select(F.explode(F.array("left", "right")).alias("key"))
    bits, width = dense.key_bits(wanted, "key", 2 * pairs.count())
    found = text.mapInArrow(released(_texts(spark.sparkContext.broadcast(bits), width)), "key long, doc_id long, row long, line_no int, line string")
    at = F.struct("doc_id", "row", "line_no")
    sets = found.groupBy("key").agg(F.min(at).alias("first"), F.max("line").alias("line"))
    later = later_sets(pairs, sets, threshold).withColumn("later", F.lit(True))
    firsts = lines.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n")).join(later, "key", "left").where("later or n > 1")
    # Of rows with equal doc_id and text the first occurrence is the same: none of them loses it.
    gone = materialize(lines.join(firsts, "key").where(F.col("later") | (at != F.col("first"))).select("doc_id", "row", "line_no"), "line-removed")
    discard(spark, scratch)
    return gone


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, n_removed: str = "n_removed") -> DataFrame:
    """docs with the later matches cut from text, and their number in a new last column n_removed
    (lengthened by underscores where docs has a column of that name)."""
    by, row, cut, n_removed = fresh(docs, "by_doc"), fresh(docs, "by_row"), fresh(docs, "cut_lines"), fresh(docs, n_removed)
    gone = removed_lines(docs, threshold).groupBy(F.col("doc_id").alias(by), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(cut))
    # The lines are cut once, and those left found by a hash set, whatever the number of either.
    left = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(cut))
    kept = F.element_at(F.transform(F.array(F.split("text", "\n")), lambda own: F.array_join(F.transform(left(own), lambda i: F.get(own, i)), "\n")), 1)
    return (
        docs.join(gone, (docs["doc_id"].cast("long") == gone[by]) & (row_key(docs["text"].cast("string")) == gone[row]), "left")
        .withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept))
        .withColumn(n_removed, F.coalesce(F.size(cut), F.lit(0)).cast("long"))
        .drop(by, row, cut)
    )


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "text", "n_removed")


SQL = f"""
WITH docs AS (
  SELECT doc_id, text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS rid FROM documents
), lines AS (
  SELECT doc_id, rid, line_no, list_distinct([w for w in regexp_split_to_array(line, '[ \\t\\r\\f\\v]+') if w <> '']) AS ws, line
  FROM (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM (SELECT DISTINCT doc_id, rid, text FROM docs WHERE doc_id IS NOT NULL AND text IS NOT NULL))
), sets AS (
  SELECT row_number() OVER (ORDER BY doc_id, rid, line_no) AS id, doc_id, rid, line_no, list_sort(ws) AS ws FROM lines WHERE len(ws) > 0
), firsts AS (
  SELECT min(id) AS id, ws, len(ws) AS n FROM sets GROUP BY ws
), tokens AS (
  SELECT id, n, unnest(ws) AS w FROM firsts
), rare AS (
  SELECT w, count(*) AS c FROM tokens GROUP BY w
), ranked AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS p FROM tokens JOIN rare USING (w)
), prefixes AS (
  SELECT * FROM ranked WHERE p <= n - CAST(ceil({THRESHOLD} * n - 1e-9) AS BIGINT) + 1
), pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefixes a JOIN prefixes b ON a.w = b.w AND a.id < b.id
  WHERE least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
), near AS (
  SELECT DISTINCT y FROM pairs JOIN firsts f ON f.id = x JOIN firsts g ON g.id = y
  WHERE len(list_intersect(f.ws, g.ws)) >= {THRESHOLD} * (f.n + g.n - len(list_intersect(f.ws, g.ws))) - 1e-9
), gone AS (
  SELECT s.doc_id, s.rid, s.line_no FROM sets s JOIN firsts f ON s.ws = f.ws WHERE s.id <> f.id OR f.id IN (SELECT y FROM near)
), left_over AS (
  SELECT l.doc_id, l.rid, string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.doc_id IS NULL) AS text, count(g.doc_id) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.rid = g.rid AND l.line_no = g.line_no GROUP BY l.doc_id, l.rid
)
SELECT d.doc_id, CASE WHEN d.doc_id IS NULL THEN d.text WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM docs d LEFT JOIN left_over l ON d.doc_id = l.doc_id AND d.rid = l.rid
"""
