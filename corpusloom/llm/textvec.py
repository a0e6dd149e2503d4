"""Arrow strings to token arrays, without a Python loop over tokens.

A token is a maximal run of "word" bytes of the UTF-8 text; its 64-bit hash is mixed from its
bytes eight at a time, for every token at once. Texts are processed whole,
in slices of whole rows that keep the temporaries small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U = np.uint64
_P = 0x9E3779B97F4A7C15
_POW = np.ones(1, dtype=U)
_INV = np.ones(1, dtype=U)


def _class_table(word: set[int], fold: bool) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for b in word:
        t[b] = b
        if fold and 65 <= b <= 90:
            t[b] = b + 32
    return t


#: Everything but ASCII white space is part of a token; case counts.
SPACE_TOKENS = _class_table(set(range(1, 256)) - {9, 10, 11, 12, 13, 32}, fold=False)
#: ASCII letters (case folded), digits and all non-ASCII bytes; ASCII punctuation separates.
WORD_TOKENS = _class_table({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}, fold=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 1 << 16)
        with np.errstate(over="ignore"):
            step = np.full(size, U(_P))
            step[0] = 1
            _POW = np.cumprod(step, dtype=U)
            step[1:] = U(pow(_P, -1, 1 << 64))
            _INV = np.cumprod(step, dtype=U)
    return _POW, _INV


_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes data[start:end] for each pair."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix64((words[starts] & _MASKS[np.minimum(length, 8)]) + length.astype(U) * U(0xC2B2AE3D27D4EB4F))
    left = np.flatnonzero(length > 8)
    at = 8
    while len(left):
        rest = length[left] - at
        h[left] = mix64(h[left] * U(_P) + (words[starts[left] + at] & _MASKS[np.minimum(rest, 8)]))
        at += 8
        left = left[rest > 8]
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, equal for equal runs wherever they lie."""
    n = len(values)
    pw, inv = _powers(n + 1)
    pre = np.empty(n + 1, dtype=U)
    pre[0] = 0
    np.cumsum(values.astype(U) * pw[:n], dtype=U, out=pre[1:])
    return mix64((pre[ends] - pre[starts]) * inv[starts])


def window_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k items of h that lie within one run of bounds (offsets, as in
    Arrow), and the offsets of each run's windows."""
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    starts = ragged_range(bounds[:-1], counts)
    return (run_hashes(h, starts, starts + k) if len(starts) else np.empty(0, dtype=U)), out


def ragged_range(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... counts[0] of them, then those of first[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - counts), counts)


@dataclass
class Tokens:
    """first, last: rows of the batch that the slice covers; data: their bytes; rows: offsets of
    each row's bytes; starts, ends, hashes: of each token; bounds: offsets of each row's tokens."""

    first: int
    last: int
    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n, kind = len(col), np.int64 if pa.types.is_large_string(col.type) else np.int32
    if n == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, buf = col.buffers()
    offsets = np.frombuffer(off, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def tokenize(col: pa.Array, table: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Tokens]:
    data, offsets = string_buffers(col)
    for a, b in slices(offsets, limit):
        rows = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        yield _tokens(a, b, part, rows, table)


def _tokens(a: int, b: int, data: np.ndarray, rows: np.ndarray, table: np.ndarray) -> Tokens:
    folded = table[data]
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = folded != 0
    begins = word[1:] & ~word[:-1]  # of len(data)+1: at each byte, and after the last
    stops = word[:-1] & ~word[1:]
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner + 1]  # a row's end also ends a token
    stops[inner] = word[inner]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    hashes = byte_hashes(folded, starts, ends) if len(starts) else np.empty(0, dtype=U)
    return Tokens(a, b, data, rows, starts, ends, hashes, np.searchsorted(starts, rows))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def parity_bitmaps(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each run's items: the bits in which two sets differ are at most as many
    as the items in which they differ."""
    one = U(1)
    bit = one << (h & U(63))
    high = (h & U(64)) != 0
    return xor_runs(np.where(high, U(0), bit), bounds), xor_runs(np.where(high, bit, U(0)), bounds)


def xor_runs(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    pre = np.zeros(len(x) + 1, dtype=U)
    np.bitwise_xor.accumulate(x, out=pre[1:])
    return pre[bounds[1:]] ^ pre[bounds[:-1]]


def sum_runs(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    pre = np.zeros(len(x) + 1, dtype=x.dtype)
    np.cumsum(x, out=pre[1:])
    return pre[bounds[1:]] - pre[bounds[:-1]]


def distinct_in_runs(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items of each run, as the upper 48 bits of their hashes, in ascending order,
    and their offsets."""
    low = U((1 << 48) - 1)
    if not len(h):
        return h, np.zeros(len(bounds), dtype=np.int64)
    runs = len(bounds) - 1
    if runs <= 1 << 16:
        both = np.sort((np.repeat(np.arange(runs, dtype=U), np.diff(bounds)) << U(48)) | (h >> U(16)))
        both = both[np.append(True, both[1:] != both[:-1])]
        return both & low, np.append(np.searchsorted(both, np.arange(runs, dtype=U) << U(48)), len(both))
    half = [distinct_in_runs(h[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in ((0, runs // 2), (runs // 2, runs))]
    return np.concatenate([half[0][0], half[1][0]]), np.concatenate([half[0][1], half[1][1][1:] + len(half[0][0])])
