"""Operator 4: passages that occur more than once, by hashes of all windows of WINDOW tokens.

Tokens are white-space separated. A window is repeated if the corpus holds the same token sequence
at another place, in the same document or another. Overlapping or adjoining repeated windows of a
document merge into one maximal interval; every occurrence is reported, the first included.

Plan: one scan takes the Rabin-Karp hashes of all windows, in numpy, chunk by chunk of CHUNK_BYTES of
text. Windows that a chunk itself repeats are settled there, and only one hash of each is sent
to tell the others, so that a passage in a third of all documents costs a hash per chunk; the
other hashes are dealt with their places to groups of about GROUP_BYTES, whose number follows from
the text's size. Each group counts its hashes with one sort and returns, per chunk, which windows
are repeated; the chunks' answers are put together and merged into intervals. Two shuffles, of 9
bytes a window and of the repeated windows only; no row per window ever exists, no pairs are made.

Defined results: doc_id is a number; documents with null doc_id, null text or fewer than WINDOW tokens
have no windows; repeated rows count as occurrences each, and rows that share a doc_id each report
their own intervals; no ties can occur; texts of any length are read whole; an empty table gives no
intervals; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import parts, released

WINDOW = 50
CHUNK_BYTES = 32 << 20
GROUP_BYTES = 32 << 20
_META = -1
_CHUNK = "part int, chunk string, dealt int, hashes binary, gaps binary, docs binary, counts binary"


def _gaps(at: np.ndarray) -> bytes:
    """Ascending positions as two byte planes of their gaps, or four where they need it."""
    gap = np.diff(at, prepend=0).astype("<u4")
    planes = 2 if not len(gap) or gap.max() < 1 << 16 else 4
    return bytes([planes]) + gap.view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes()


def _positions(packed: bytes) -> np.ndarray:
    planes = packed[0]
    cells = np.frombuffer(packed, np.uint8, offset=1).reshape(planes, -1)
    gap = np.zeros((cells.shape[1], 4), dtype=np.uint8)
    gap[:, :planes] = cells.T
    return np.cumsum(gap.view("<u4").reshape(-1), dtype=np.int64)


def _deal(window: int, n_parts: int, chunk_bytes: int):
    names = ["part", "chunk", "dealt", "hashes", "gaps", "docs", "counts"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def dealt(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of hashes by group, and the groups' offsets."""
        part = (h >> np.uint64(32)).astype(np.int64) * n_parts >> 32
        order = np.argsort(part.astype(np.uint16) if n_parts <= 1 << 16 else part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(n_parts + 1))

    def rows(chunk: str, ids: list, counts: list, hashes: list) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        first = np.append(True, ~same)[: len(h)]  # of each hash
        told = h[order[first & again[order]]]
        out = []
        once = np.flatnonzero(~again)
        for own, places in ((h[once], once), (told, None)):
            order, cut = dealt(own)
            for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                at = order[cut[p] : cut[p + 1]]
                out.append((p, chunk, p, own[at].tobytes(), None if places is None else _gaps(places[at]), None, None))
        out.append((hash_part(chunk, n_parts), chunk, _META, None, _gaps(np.flatnonzero(again)), np.concatenate(ids).tobytes(), np.concatenate(counts).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, ids, counts, hashes, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for t in tv.tokenize(b.column(1), tv.SPACE_TOKENS):
                h, bounds = tv.window_hashes(t.hashes, t.bounds, window)
                n = np.diff(bounds)
                if len(h):
                    ids.append(doc[t.first : t.last][n > 0].astype("<i8"))
                    counts.append(n[n > 0].astype("<i8"))
                    hashes.append(h)
                    size += len(t.data)
                if size >= chunk_bytes:
                    yield rows(f"{task}.{number}", ids, counts, hashes)
                    number, ids, counts, hashes, size = number + 1, [], [], [], 0
        if hashes:
            yield rows(f"{task}.{number}", ids, counts, hashes)

    return run


def hash_part(chunk: str, n_parts: int) -> int:
    return sum(map(int, chunk.split("."))) % n_parts


def _count(group):
    """A partition's windows: the positions of the repeated ones, per chunk."""
    kind = pa.schema([("chunk", pa.string()), ("gaps", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
    meta = group.filter(pc.equal(group["dealt"], _META)).select(kind.names)
    own = group.filter(pc.not_equal(group["dealt"], _META))
    parts_of = [np.frombuffer(x.as_buffer(), "<u8") for x in own["hashes"]]
    if not parts_of:
        return meta.cast(kind)
    h = np.concatenate(parts_of)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(h), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    out, at = [], 0
    for chunk, gaps, x in zip(own["chunk"].to_pylist(), own["gaps"], parts_of):
        mine, at = again[at : at + len(x)], at + len(x)
        if gaps.is_valid and mine.any():
            out.append((chunk, _gaps(_positions(gaps.as_py())[mine])))
    found = pa.table([pa.array([c for c, _ in out], pa.string()), pa.array([g for _, g in out], pa.binary()), pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.binary())], schema=kind)
    return pa.concat_tables([meta.cast(kind), found])


def _merge(window: int):
    def run(group: pa.Table) -> pa.Table:
        meta = group.filter(pc.is_valid(group["docs"]))
        docs = np.frombuffer(meta["docs"][0].as_py(), "<i8")
        counts = np.frombuffer(meta["counts"][0].as_py(), "<i8")
        hits = [_positions(x) for x in group["gaps"].drop_null().to_pylist()]
        at = np.sort(np.concatenate(hits)) if hits else np.empty(0, dtype=np.int64)
        cut = np.concatenate(([0], np.cumsum(counts)))
        row = np.searchsorted(cut, at, side="right") - 1
        pos = at - cut[row]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + window)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        start, end = pos[first], pos[last] + window if len(first) else pos[first]
        return pa.table({"doc_id": docs[row[first]], "start_token": start, "end_token": end})

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, n_parts: int | None = None, group_bytes: int = GROUP_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, start_token, end_token (exclusive) of the maximal repeated intervals. n_parts: the
    number of groups, by default one for group_bytes of what is shuffled, and no fewer than
    spark.sql.shuffle.partitions."""
    if window < 1:
        raise ValueError("window must be positive")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    if n_parts is None:
        size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a token and its space are seldom less than five bytes
        n_parts = max(parts(docs.sparkSession), -(-2 * size // group_bytes))
    dealt = text.mapInArrow(released(_deal(window, n_parts, chunk_bytes)), _CHUNK).repartitionById(n_parts, "part")
    counted = dealt.groupBy("part").applyInArrow(_count, "chunk string, gaps binary, docs binary, counts binary")
    return counted.groupBy("chunk").applyInArrow(_merge(window), "doc_id long, start_token long, end_token long")


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH tokens AS (
  SELECT rid, doc_id, [w for w in regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+') if w <> ''] AS ws
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), windows AS (
  SELECT rid, doc_id, p, md5(array_to_string(ws[p + 1 : p + {WINDOW}], ' ')) AS h
  FROM (SELECT rid, doc_id, ws, unnest(range(len(ws) - {WINDOW} + 1)) AS p FROM tokens WHERE len(ws) >= {WINDOW})
), hits AS (
  SELECT rid, doc_id, p FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), islands AS (
  SELECT rid, doc_id, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS island
  FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hits)
)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_token, CAST(max(p) + {WINDOW} AS BIGINT) AS end_token FROM islands GROUP BY rid, doc_id, island
"""
