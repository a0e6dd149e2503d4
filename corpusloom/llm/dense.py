"""Dense arrays of a fixed width, counted over a whole DataFrame and handed to every task.

Each task counts into its own array and emits its non-zero cells in blocks of 65,536; Spark merges
the blocks. What is broadcast has a bounded size, whatever the input; a cell may be shared by
several keys, so callers may use it only where an over-count is harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released

BLOCK = 1 << 16
SCHEMA = "block int, cells binary, counts binary"


def blocks(counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    cells = np.flatnonzero(counts)
    cut = np.searchsorted(cells, np.arange(0, len(counts) + BLOCK, BLOCK))
    for i in range(len(cut) - 1):
        own = cells[cut[i] : cut[i + 1]]
        if len(own):
            yield i, (own & (BLOCK - 1)).astype("<u2").tobytes(), counts[own].astype("<u4").tobytes()


def _merged(cells: list, counts: list) -> np.ndarray:
    total = np.zeros(BLOCK, dtype=np.int64)
    for a, b in zip(cells, counts):
        np.add.at(total, np.frombuffer(a, "<u2"), np.frombuffer(b, "<u4"))
    return total


def merge(df: DataFrame, width: int, kind: str) -> np.ndarray:
    """The array of the summed blocks. kind "class": a byte per cell, 0 and 1 exact, then four
    steps to each doubling. kind "bits": whether a cell was counted, packed eight to a byte."""

    def one(key, group):
        total = _merged(group["cells"].to_pylist(), group["counts"].to_pylist())
        if kind == "bits":
            out = np.packbits(total > 0, bitorder="little")
        else:
            out = np.where(total > 1, 1 + np.ceil(4 * np.log2(np.maximum(total, 1))), total).astype(np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([out.tobytes()], pa.binary())})

    rows = df.groupBy("block").applyInArrow(one, "block int, cells binary").collect()  # bounded by the width
    size = BLOCK // 8 if kind == "bits" else BLOCK
    whole = np.zeros((width // BLOCK, size), dtype=np.uint8)
    for r in rows:
        whole[r.block] = np.frombuffer(r.cells, dtype=np.uint8)
    return whole.reshape(-1)


def key_bits(df: DataFrame, column: str, n_keys: int, most: int = 1 << 28) -> tuple[np.ndarray, int]:
    """A bitmap over the low bits of a 64-bit key column (already a good hash), sixteen bits or
    more to a key up to a limit of 32 MB; beyond that it merely lets more rows pass."""
    width = BLOCK
    while width < 16 * n_keys and width < most:
        width *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, dtype=bool)
        for b in batches:
            seen[b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(width - 1)] = True
        rows = list(blocks(seen.astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "cells", "counts"])

    return merge(df.select(column).mapInArrow(mark, SCHEMA), width, "bits"), width


def has_bit(bits: np.ndarray, width: int, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(width - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def having(text: DataFrame, wanted: DataFrame, n_keys: int) -> DataFrame:
    """The rows of text (doc_id, text) whose doc_id is in wanted (doc_id, about n_keys rows), and a few others:
    all texts are looked at where they are, and only these need be shuffled."""
    bits, width = key_bits(wanted.select(F.xxhash64("doc_id").alias("key")), "key", n_keys)
    shared = text.sparkSession.sparkContext.broadcast(bits)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = has_bit(shared.value, width, b.column("key").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text")], names=["doc_id", "text"]).filter(pa.array(keep))

    return text.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(released(needed), "doc_id long, text string")
