"""Word n-grams as 64-bit hashes, a batch at a time.

A word is a run of ASCII letters and digits of the lower-cased text (functions.text.words). Each
word is hashed from its bytes, each n-gram from its words' hashes, in numpy, so that no string is
made for any of them and what is shuffled is eight bytes a gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SLICE = 1 << 20
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """An invertible scrambling of 64-bit words (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the bytes, and how many words each row (offsets) has."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    begin, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    joint = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(data))]
    begin[joint], end[joint] = inside[joint + 1], inside[joint]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    h, left, at = (ends - starts).astype(np.uint64), np.arange(len(starts)), 0
    while len(left):  # a byte of every word that is long enough, per step
        h[left] = _mixed(h[left] * np.uint64(257) + data[starts[left] + at])
        at += 1
        left = left[ends[left] - starts[left] > at]
    return h, np.diff(np.searchsorted(starts, rows))


def row_grams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row's words: row and hash."""
    if len(h) < n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    g = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        g = _mixed(g * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    row = np.repeat(np.arange(len(counts)), counts)
    within = row[: len(g)] == row[n - 1 :]
    row, g = row[: len(g)][within], g[within]
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1]))[: len(g)]
    return row[new], g[new]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, to
        at = to


def gram_rows(df: DataFrame, key: str, text: str, n: int, stop: tuple[str, ...] = (), wanted: Callable[[], np.ndarray] | None = None) -> DataFrame:
    """key, gram of the distinct word n-grams of each row of df; with wanted, a function that gives a sorted
    array of hashes, of those in it alone. Rows without text have none."""
    skipped = np.array([], dtype=np.uint64)
    if stop:
        raw = "\n".join(stop).lower().encode()
        skipped = np.unique(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted()
        for b in batches:
            column = b.column(1)
            _, off, buf = column.buffers()
            offsets = np.frombuffer(off, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + b.num_rows + 1].astype(np.int64)
            data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
            for a, z in _slices(offsets):
                h, counts = word_hashes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                if len(skipped):
                    keep = ~np.isin(h, skipped)
                    counts = np.diff(np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(counts))])
                    h = h[keep]
                row, g = row_grams(h, counts, n)
                if known is not None:
                    at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
                    hit = known[at] == g if len(known) else np.zeros(len(g), dtype=bool)
                    row, g = row[hit], g[hit]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + a)), pa.array(g.view(np.int64))], names=["key", "gram"])

    schema = StructType([StructField("key", df.schema[key].dataType), StructField("gram", LongType())])
    return df.select(F.col(key).alias("key"), F.lower(text).alias("text")).where("text is not null").mapInArrow(run, schema).withColumnRenamed("key", key)
