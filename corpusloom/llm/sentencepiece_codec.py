"""Operator 2: SentencePiece encoding and decoding.

Encoding takes the best-scored segmentation (unigram Viterbi) over the pieces of a model file, held
in a double-array trie; what no piece covers falls back to byte pieces. A space is the marker
U+2581, and one stands before the text; a U+2581 of the text itself is encoded as bytes, so that
decoding restores every text exactly. Special pieces are never produced from text and decode to
nothing.

Log scores: a unigram model's own; a BPE model stores minus the merge rank instead, and then a
piece of rank r scores -ln(r + 2), Zipf's law over the ranks. A byte scores BYTE_COST less than
the worst piece, so that bytes are used only where they must be. Of segmentations with equal
scores the one whose last piece is the longest is taken, and so on from the end.

No piece reaches over the start of a word's marker or into a line feed (where the model says so,
which is checked), so that the best segmentation of a text is that of its words; each batch's
distinct words are segmented together, one numpy step for all of them at a time.

Defined results: doc_id is a number; null text gives null ids and null decoded text; '' gives no
ids; rows with null doc_id and repeated rows are encoded like any other; texts and words of any
length are encoded whole (words over 512 bytes one by one, with the same result); an empty table
gives an empty result; invalid or special ids decode to nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_COST = 10.0
_MARK = 0xFF  # never a byte of UTF-8; stands for the white-space marker
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
_SLICE = 2 << 20
_LONG = 512


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, buf[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[tuple[bytes, float, int]], bool]:
    """Pieces (UTF-8, score, type) of a .model file, and whether it is a BPE model."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, bpe = [], False
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
    return pieces, bpe


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: state s goes with byte c to base[s] + c + 1 if check of that is s;
    value is -1 where no key ends. State 0 is the root."""
    tree: list[dict[int, int]] = [{}]
    ends = [-1]
    for k, v in zip(keys, values):
        node = 0
        for c in k:
            nxt = tree[node].get(c)
            if nxt is None:
                nxt = tree[node][c] = len(tree)
                tree.append({})
                ends.append(-1)
            node = nxt
        ends[node] = v
    size = 2 * len(tree) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, dtype=bool)
    free[0] = False
    low, todo = 1, [(0, 0)]
    for node, state in todo:  # breadth first; todo grows
        value[state] = ends[node]
        codes = sorted(tree[node])
        if not codes:
            base[state] = size - 300  # leads only to empty places
            continue
        need = np.array(codes) + 1
        at = low
        while True:
            spots = at + np.flatnonzero(free[at : at + 4096])
            b = spots - need[0]
            b = b[(b >= 0) & (b + need[-1] < size - 300)]
            ok = b[free[b[:, None] + need].all(axis=1)] if len(b) else b
            if len(ok):
                break
            at += 4096
            if at >= size - 300:
                grow = size
                base, check, value, free = (np.concatenate([x[: size - 300], np.full(grow + 300, f, x.dtype)]) for x, f in ((base, 0), (check, -1), (value, -1), (free, True)))
                base[base == size - 300] = 2 * size - 300
                size *= 2
        base[state] = ok[0]
        for c in codes:
            child = ok[0] + c + 1
            free[child], check[child] = False, state
            todo.append((tree[node][c], child))
        while low < size and not free[low]:
            low += 1
    return base, check, value


@dataclass
class Codec:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray  # by piece id
    byte_id: np.ndarray  # by byte
    byte_score: float
    split_words: bool
    split_lines: bool
    flat: np.ndarray  # decoded bytes of all pieces
    offsets: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        pieces, bpe = read_model(path)
        mark = "▁".encode()
        score = np.array([s for _, s, _ in pieces])
        if bpe:
            score = -np.log(np.maximum(0, -score) + 2)
        byte_id = np.full(256, -1, dtype=np.int32)
        keys, values, decoded = [], [], []
        for i, (p, _, kind) in enumerate(pieces):
            own = p.replace(mark, bytes([_MARK]))
            if kind == _BYTE:
                byte_id[int(p[3:5], 16)] = i
                decoded.append(bytes([int(p[3:5], 16)]))
            elif kind in (_NORMAL, _USER):
                keys.append(own)
                values.append(i)
                decoded.append(p.replace(mark, b" "))
            else:
                decoded.append(b"")
        if (byte_id < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        base, check, value = double_array(keys, values)
        crosses = any(_MARK in k.lstrip(bytes([_MARK])) for k in keys)
        return cls(base, check, value, score, byte_id, float(min(score[values])) - BYTE_COST, not crosses, not any(10 in k for k in keys), np.frombuffer(b"".join(decoded), np.uint8), np.cumsum([0] + [len(d) for d in decoded]))

    def _one(self, word: bytes) -> list[int]:
        """Viterbi of one word, without numpy: for words of any length."""
        n = len(word)
        best, back = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        base, check, value, score, byte_id = self._lists()
        for i in range(n):
            own, state, j = best[i], 0, i
            while j < n:
                nxt = base[state] + word[j] + 1
                if check[nxt] != state:
                    break
                state, j = nxt, j + 1
                v = value[state]
                if v >= 0 and own + score[v] > best[j]:
                    best[j], back[j] = own + score[v], (i, v)
            if own + self.byte_score > best[i + 1]:
                best[i + 1], back[i + 1] = own + self.byte_score, (i, byte_id[32 if word[i] == _MARK else word[i]])
        ids = []
        while n:
            n, v = back[n]
            ids.append(v)
        return ids[::-1]

    def _lists(self):
        if not hasattr(self, "_plain"):
            self._plain = tuple(x.tolist() for x in (self.base, self.check, self.value, self.score, self.byte_id))
        return self._plain

    def _many(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi of all words at once: their ids, one word after the other, and their counts."""
        n, longest = len(starts), int(length.max())
        cells = np.zeros((longest, n), dtype=np.uint8)
        for j in range(longest):
            on = length > j
            cells[j, on] = data[starts[on] + j]
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((longest + 1, n), dtype=np.int32)
        step = np.zeros((longest + 1, n), dtype=np.int16)
        for i in range(longest):
            who = np.flatnonzero(length > i)
            own, state = best[i, who], np.zeros(len(who), dtype=np.int64)
            single = own + self.byte_score
            active, from_score = who, own
            for j in range(i, longest):
                nxt = self.base[state] + cells[j, active] + 1
                ok = (self.check[nxt] == state) & (length[active] > j)
                active, state, from_score = active[ok], nxt[ok], from_score[ok]
                if not len(active):
                    break
                v = self.value[state]
                has = v >= 0
                a, v = active[has], v[has]
                s = from_score[has] + self.score[v]
                better = s > best[j + 1, a]
                a = a[better]
                best[j + 1, a], back[j + 1, a], step[j + 1, a] = s[better], v[better], j + 1 - i
            better = single > best[i + 1, who]
            a = who[better]
            c = cells[i, a]
            best[i + 1, a], back[i + 1, a], step[i + 1, a] = single[better], self.byte_id[np.where(c == _MARK, 32, c)], 1
        out = np.empty((longest, n), dtype=np.int32)
        count, at, who = np.zeros(n, dtype=np.int64), length.copy(), np.arange(n)
        while len(who):
            out[count[who], who] = back[at[who], who]
            count[who] += 1
            at[who] -= step[at[who], who]
            who = who[at[who] > 0]
        row = np.repeat(count - 1, count) - tv.ragged_range(np.zeros(n, dtype=np.int64), count)
        return out[row, np.repeat(np.arange(n), count)], count

    def words(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of words (by ascending length) and their counts."""
        ids, counts, at = [], [], 0
        while at < len(starts):
            most = int(length[at])
            if most > _LONG:
                own = self._one(data[starts[at] : starts[at] + most].tobytes())
                ids.append(np.array(own, dtype=np.int32))
                counts.append(np.array([len(own)]))
                at += 1
                continue
            to = min(np.searchsorted(length, most + max(1, most // 4), side="right"), at + max(64, (1 << 18) // most), np.searchsorted(length, _LONG, side="right"))
            i, c = self._many(data, starts[at:to], length[at:to])
            ids.append(i)
            counts.append(c)
            at = to
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.int32), np.empty(0, np.int64))

    def encode(self, text: pa.Array) -> pa.Array:
        """Lists of piece ids."""
        data, offsets = tv.string_buffers(text)
        out, counts = [], []
        for a, b in tv.slices(offsets, _SLICE):
            i, c = self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out.append(i)
            counts.append(c)
        ids = np.concatenate(out) if out else np.empty(0, np.int32)
        n = np.concatenate(counts) if counts else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids, pa.int32()), mask=text.is_null() if text.null_count else None)

    def _encode(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(rows)
        full = size > 0
        data = np.empty(len(raw) + int(full.sum()), dtype=np.uint8)
        shift = np.cumsum(full)
        first = rows[:-1][full] + shift[full] - 1  # where the prefixed marks go
        body = np.ones(len(data), dtype=bool)
        body[first] = False
        data[body] = np.where(raw == 32, _MARK, raw)
        data[first] = _MARK
        begins = np.zeros(len(data), dtype=bool)
        begins[first] = True
        if self.split_words:
            mark = data == _MARK
            begins[1:] |= mark[1:] & ~mark[:-1]
        if self.split_lines:
            feed = data == 10
            begins |= feed
            begins[1:] |= feed[:-1]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, where, inverse = np.unique(tv.byte_hashes(data, starts, ends), return_index=True, return_inverse=True) if len(starts) else (starts, starts, starts)
        length = ends[where] - starts[where]
        order = np.argsort(length, kind="stable")
        ids, counts = self.words(data, starts[where][order], length[order])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        word = place[inverse]
        begin = np.cumsum(counts) - counts
        per_word = counts[word]
        total = np.append(0, np.cumsum(per_word))
        bounds = np.append(np.searchsorted(starts, first), len(starts))
        n = np.zeros(len(size), dtype=np.int64)
        n[full] = np.diff(total[bounds])
        return ids[tv.ragged_range(begin[word], per_word)], n

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of piece ids."""
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False)
        out = []
        for a, b in tv.slices(offsets, 1 << 20):
            own = flat[offsets[a] : offsets[b]].astype(np.int64)
            own = np.where((own >= 0) & (own < len(self.score)), own, -1)
            size = np.where(own >= 0, np.diff(self.offsets)[own], 0)
            data = self.flat[tv.ragged_range(self.offsets[own], size)].tobytes()
            cut = np.append(0, np.cumsum(size))[offsets[a : b + 1] - offsets[a]].tolist()
            for i in range(b - a):
                own_bytes = data[cut[i] : cut[i + 1]]
                out.append(own_bytes[1:] if own_bytes[:1] == b" " else own_bytes)
        if ids.null_count:
            out = [x if ok else None for x, ok in zip(out, ids.is_valid().to_pylist())]
        try:
            return pa.array(out, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that don't spell UTF-8
            return pa.array([x if x is None else x.decode(errors="replace") for x in out], pa.string())


def encode_documents(docs: DataFrame, model: str = MODEL, codec: Codec | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, decoded (from the ids) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(codec or Codec.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = codec.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pc.list_value_length(ids).cast(pa.int64()), codec.decode(ids)], names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, ids array<int>, n_tokens long, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
