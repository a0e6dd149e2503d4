"""Operator 10: toxic documents, by a subsequence string kernel, Nyström landmarks and a linear SVM.

A sentence's terms are its white-space separated words, case, accents and look-alike digits folded
and inner punctuation dropped; a run of three or more single letters joins into one term. The
kernel of two terms sums, over the subsequences of three characters that both hold (word edges are
characters) within a span of five, DECAY to the power of both gaps, each term scaled by a norm that
depends on its length. A skipped character costs weight, not the match: "id-iot", "i d i o t" and
"idxiot" stay close to "idiot".

Training, in one task, over a bounded sample of labelled documents (``max_toxic``,
``max_clean``, least hashes of doc_id first): sentences of clean documents are clean; of a toxic
document's sentences at least one has a toxic term, which terms do is settled by rounds of
multiple-instance training. Terms are mapped to their kernels with ``landmarks`` terms, whitened; the
SVM (squared hinge) is solved by Newton steps. What a round trains on is bounded by parameters too:
``negatives`` of the commonest clean terms and as many spread evenly over the others at first,
``hard`` of the highest scored clean terms and as many of the highest scored clean pairs of adjoining
words more with each of ``rounds``, and ``variants`` spoilt spellings of each toxic term.

Scores are given to every word and to every two adjoining words written as one, so that "worth less"
scores as "worthless" does. A document's three highest word scores, how many are above 0, their
share and its highest pair score are pooled by a second linear SVM, fitted on all labelled
documents of the sample; those on which the terms were trained count less than the third kept apart.

Scoring is exact for that SVM: a landmark combination is one weight per character triple, so that
a term costs six table look-ups a character, whatever the number of landmarks. A document is
toxic if its pooled score is above 0. Whole texts are scored, whatever their length.

Defined results: doc_id is a number; null or empty texts and texts of white space are clean;
documents with null doc_id are neither reported nor dropped; a score of 0 (a tie) is clean; repeated rows are
each scored, rows that share a doc_id by their own texts; without a toxic or without a clean label
nothing is rejected; an empty table gives an empty result; labels without a document, null labels and repeated
labels (any toxic one counts) do no harm; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, released

MAX_TOXIC, MAX_CLEAN = 3000, 6000
DECAY = 0.5
LANDMARKS = 256
ROUNDS = 4
NEGATIVES, HARD, VARIANTS = 8000, 4000, 6
TRAINED_WEIGHT = 0.05
CLASSES = 42
_EDGE, _NONE, _DROP = 0, 41, 255
_GAPS = ((1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1))
_LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_TABLED = 0x3000


def _class_of(ch: str) -> int:
    if ch.isspace() or ch == "\0":
        return _EDGE
    base = unicodedata.normalize("NFKD", _LOOKALIKE.get(ch, ch)).lower()[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    if base.isdigit():
        return 40
    return 27 + ord(base) % 13 if base.isalpha() else _DROP


_TABLE = np.array([_class_of(chr(c)) for c in range(_TABLED)], dtype=np.uint8)


def _classes(points: np.ndarray) -> np.ndarray:
    out = _TABLE[np.minimum(points, _TABLED - 1)]
    far = np.flatnonzero(points >= _TABLED)
    for i in far if len(far) < 64 else []:
        out[i] = _class_of(chr(points[i]))
    if len(far) >= 64:
        values, where = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_class_of(chr(v)) for v in values], dtype=np.uint8)[where]
    return out


@dataclass
class Terms:
    """cls: character classes with edges between the terms; starts, ends: of each term in cls;
    doc: the text it is of; at: its first character's place in the joined texts."""

    cls: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def terms(texts: list[str]) -> Terms:
    points = np.frombuffer("\n\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    begins = np.cumsum([2] + [len(x) + 2 for x in texts])
    cls = _classes(points)
    kept = np.flatnonzero(cls != _DROP)
    cls = cls[kept]
    starts, ends = _spans(cls)
    single = (ends - starts) == 1
    near = np.zeros(len(starts) + 1, dtype=bool)  # near[i]: term i joins term i - 1
    near[1:-1] = single[1:] & single[:-1] & (starts[1:] == ends[:-1] + 1)
    if near.any():
        pair = near[:-1] & near[1:]  # the middle of three
        join = near.copy()
        join[:-1] &= pair | np.append(False, pair[:-1])
        join[1:-1] |= near[1:-1] & (pair[1:] | pair[:-1])
        gaps = starts[join[:-1]] - 1
        if len(gaps):
            keep = np.ones(len(cls), dtype=bool)
            keep[gaps] = False
            cls, kept = cls[keep], kept[keep]
            starts, ends = _spans(cls)
    at = kept[starts] if len(starts) else starts
    return Terms(cls, starts, ends, np.searchsorted(begins, at, side="right") - 1, at)


def pairs(t: Terms) -> Iterator[Terms]:
    """Every two adjoining words of a text written as one: those that begin at an even place among
    the words, then those at an odd one."""
    follows = t.doc[1:] == t.doc[:-1]
    for odd in (0, 1):
        first = np.flatnonzero(follows & (np.arange(len(follows)) % 2 == odd))
        gap = np.zeros(len(t.cls) + 1, dtype=np.int8)
        gap[t.ends[first]] = 1
        gap[t.starts[first + 1]] = -1
        keep = np.cumsum(gap[:-1], dtype=np.int8) == 0
        at = np.concatenate(([0], np.cumsum(keep)))
        yield Terms(t.cls[keep], at[t.starts[first]], at[t.ends[first + 1]], t.doc[first], t.at[first])


def _spans(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.concatenate(([False], cls != _EDGE, [False]))
    return np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])


def _neighbours(cls: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The class one, two and three places to the left and right of each, _NONE beyond an edge."""
    pad = np.full(3, _EDGE, dtype=np.uint8)
    x = np.concatenate((pad, cls, pad))
    n, none = len(cls), np.uint8(_NONE)
    left, right = [x[2 : 2 + n]], [x[4 : 4 + n]]
    for d in (2, 3):
        for side, own in ((left, x[3 - d : 3 - d + n]), (right, x[3 + d : 3 + d + n])):
            before = side[-1]
            side.append(np.where((before == _EDGE) | (before == none), none, own))
    return left, right


def _triples(cls: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    left, right = _neighbours(cls)
    middle = cls.astype(np.int32) * CLASSES
    for a, b in _GAPS:
        yield left[a - 1].astype(np.int32) * (CLASSES * CLASSES) + middle + right[b - 1], DECAY ** (a + b - 2)


def _norms(length: np.ndarray) -> np.ndarray:
    return np.sqrt(sum(DECAY ** (2 * (a + b - 2)) * np.maximum(length + 2 - a - b, 0) for a, b in _GAPS))


def term_scores(t: Terms, weights: np.ndarray) -> np.ndarray:
    """The kernel of each term with a combination of landmarks given as weights per triple."""
    if not len(t.starts):
        return np.empty(0, dtype=np.float32)
    total = np.zeros(len(t.cls), dtype=np.float32)
    for index, w in _triples(t.cls):
        total += weights[index] * np.float32(w)
    return _term_sums(total, t) / _norms(t.ends - t.starts).astype(np.float32)


def _term_sums(x: np.ndarray, t: Terms) -> np.ndarray:
    cut = np.empty(2 * len(t.starts), dtype=np.int64)
    cut[0::2], cut[1::2] = t.starts, t.ends
    return np.add.reduceat(np.append(x, np.float32(0)), cut)[0::2]


def _profile(term: bytes) -> np.ndarray:
    """The explicit kernel features of one term, as weights per triple."""
    t = _joined([term])
    out = np.zeros(CLASSES**3)
    for index, w in _triples(t.cls):
        own = index[t.starts[0] : t.ends[-1]]
        np.add.at(out, own, w)
    return _valid(out) / _norms(np.array([t.ends[-1] - t.starts[0]]))[0]


def _valid(w: np.ndarray) -> np.ndarray:
    cube = w.reshape(CLASSES, CLASSES, CLASSES)
    cube[_NONE], cube[:, _NONE], cube[:, _EDGE], cube[:, :, _NONE] = 0, 0, 0, 0
    return w


@dataclass
class Model:
    weights: np.ndarray  # per character triple
    cut: float  # of a term
    pool: np.ndarray  # of document_features, and the intercept


def _strings(t: Terms) -> list[bytes]:
    raw = t.cls.tobytes()
    return [raw[a:b] for a, b in zip(t.starts.tolist(), t.ends.tolist())]


def _joined(strings: list[bytes]) -> Terms:
    length = np.array([len(x) for x in strings], dtype=np.int64)
    starts = np.cumsum(np.concatenate(([1], length[:-1] + 1)))
    cls = np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", dtype=np.uint8)
    return Terms(cls, starts, starts + length, np.arange(len(strings)), starts)


def _with_insertions(term: bytes, variants: int) -> list[bytes]:
    """The term with one letter put in, at inner places from the second letter on, spread evenly."""
    places = range(2, len(term))
    places = sorted({places[i * len(places) // variants] for i in range(min(variants, len(places)))}) if places else []
    return [term[:i] + bytes([(7 * i + term[0]) % 26 + 1]) + term[i:] for i in places]


class Landmarks:
    """Terms as features: their kernels with the marks, whitened. Only the character triples that
    some mark holds have a row in the table."""

    def __init__(self, marks: list[bytes]) -> None:
        own = [_profile(m) for m in marks]
        cols = np.unique(np.concatenate([np.flatnonzero(x) for x in own]))
        self.table = np.zeros((len(cols) + 1, len(marks)), dtype=np.float32)
        for i, x in enumerate(own):
            self.table[:-1, i] = x[cols]
        self.row = np.full(CLASSES**3, len(cols), dtype=np.int32)
        self.row[cols] = np.arange(len(cols))
        self.cols = cols
        value, vector = np.linalg.eigh((self.table.T @ self.table).astype(np.float64))
        good = value > 1e-6 * value.max()
        self.whiten = vector[:, good] / np.sqrt(value[good])

    def features(self, terms_: list[bytes]) -> np.ndarray:
        out = np.ones((len(terms_), self.whiten.shape[1] + 1), dtype=np.float32)
        for at in range(0, len(terms_), 1024):
            t = _joined(terms_[at : at + 1024])
            total = np.zeros((len(t.cls) + 1, self.table.shape[1]), dtype=np.float32)
            for index, w in _triples(t.cls):
                total[:-1] += self.table[self.row[index]] * np.float32(w)
            cut = np.empty(2 * len(t.starts), dtype=np.int64)
            cut[0::2], cut[1::2] = t.starts, t.ends
            k = np.add.reduceat(total, cut, axis=0)[0::2] / _norms(t.ends - t.starts)[:, None]
            out[at : at + 1024, :-1] = k @ self.whiten
        return out

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Per character triple, of a combination of the features."""
        out = np.zeros(CLASSES**3)
        out[self.cols] = self.table[:-1] @ (self.whiten @ w)
        return _valid(out.astype(np.float32))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM with a free intercept (last column of x), by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-6
    scores = lambda w: np.concatenate([x[at : at + 4096] @ w for at in range(0, len(x), 4096)])
    loss = lambda w: (ridge * w * w).sum() + (cost * np.maximum(0, 1 - y * scores(w)) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        grad, curve = ridge * w, np.diag(ridge)
        for at in range(0, len(x), 4096):  # no copy of the whole
            part, own = x[at : at + 4096].astype(np.float64), y[at : at + 4096]
            on = own * (part @ w) < 1
            part, own = part[on], own[on]
            weighted = part * cost[at : at + 4096][on, None]
            grad = grad - weighted.T @ (own - part @ w)
            curve = curve + weighted.T @ part
        move = np.linalg.solve(curve, grad)
        step = 1.0
        while (then := loss(w - step * move)) > now and step > 1e-4:
            step /= 2
        if now - then < 1e-7 * now:
            break
        w, now = w - step * move, then
    return w


def _hard_pairs(texts: list[str], model: Model, most: int) -> list[bytes]:
    """The highest scored pairs of adjoining words of clean texts."""
    found: dict[bytes, float] = {}
    for at, to in _chunks(texts):
        for t in pairs(terms(texts[at:to])):
            value = term_scores(t, model.weights) - np.float32(model.cut)
            near = np.flatnonzero(value > FLOOR)
            for i, v in zip(near.tolist(), value[near].tolist()):
                found[t.cls[t.starts[i] : t.ends[i]].tobytes()] = v
        if len(found) > 4 * most:
            found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])
    return [x for x, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]]


def train(texts: list[str], toxic: list[bool], landmarks: int = LANDMARKS, rounds: int = ROUNDS, n_negatives: int = NEGATIVES, n_hard: int = HARD, variants: int = VARIANTS) -> Model | None:
    if not any(toxic) or all(toxic):
        return None
    texts, label = [x or "" for x in texts], np.array(toxic)
    held = np.zeros(len(texts), dtype=bool)
    for side in (True, False):
        held[np.flatnonzero(label == side)[2::3]] = True  # every third is kept apart for the pooling
    bag: dict[bytes, int] = {}
    docs: list[np.ndarray] = []
    for i in range(0, len(texts), 100):
        t = terms(texts[i : i + 100])
        ids = np.array([bag.setdefault(s, len(bag)) for s in _strings(t)], dtype=np.int64)
        cut = np.searchsorted(t.doc, np.arange(len(texts[i : i + 100]) + 1))
        docs += [np.unique(ids[a:b]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
    strings = list(bag)
    del bag
    n_toxic, n_clean = np.zeros(len(strings)), np.zeros(len(strings))
    for i, own in enumerate(docs):
        if not held[i]:
            (n_toxic if label[i] else n_clean)[own] += 1
    seen_toxic, seen_clean = max(1, (label & ~held).sum()), max(1, (~label & ~held).sum())
    odds = (n_toxic + 0.05) / (seen_toxic + 1) / ((n_clean + 0.5) / (seen_clean + 1))
    odds[n_toxic == 0] = 0
    clean = np.flatnonzero(n_clean > 0)
    if not len(clean) or not n_toxic.any():
        return None
    # Landmarks: terms that tell toxic documents, the commonest clean ones and an even spread.
    telling = np.argsort(-odds * np.sqrt(n_toxic), kind="stable")[: landmarks // 2]
    telling = telling[odds[telling] > 2]
    common = clean[np.argsort(-n_clean[clean], kind="stable")]
    spread = common[:: max(1, len(common) // (landmarks // 4))][: landmarks // 4]
    marks = Landmarks([strings[i] for i in dict.fromkeys([*telling.tolist(), *common[: landmarks // 4].tolist(), *spread.tolist()])])

    positives = np.zeros(len(strings), dtype=bool)
    for i, own in enumerate(docs):
        if label[i] and not held[i] and len(own):
            best = own[np.argmax(odds[own] * np.sqrt(n_toxic[own]))]
            positives[best] = odds[best] > 2
    positives |= (odds > 20) & (n_toxic >= 3)
    if not positives.any():
        return None
    rest = common[n_negatives:]
    negatives = np.union1d(common[:n_negatives], rest[:: max(1, len(rest) // max(1, n_negatives))])
    hard_pairs: list[bytes] = []
    clean_texts = [x for x, bad, out in zip(texts, label, held) if not bad and not out]
    every = _joined(strings)
    model = None
    for _ in range(rounds):
        pos = np.flatnonzero(positives)
        neg = np.setdiff1d(negatives, pos)
        spoilt = [v for i in pos for v in _with_insertions(strings[i], variants)]
        toxic_terms = {strings[i] for i in pos}
        against = [strings[i] for i in neg] + [x for x in hard_pairs if x not in toxic_terms]
        x = marks.features([strings[i] for i in pos] + spoilt + against)
        n_pos = len(x) - len(against)
        y = np.where(np.arange(len(x)) < n_pos, 1.0, -1.0)
        cost = np.where(y > 0, 2.0 * max(1.0, len(against) / n_pos / 4), 8.0)
        cost[len(pos) : n_pos] /= 4
        w = _svm(x, y, cost)
        del x
        model = Model(marks.weights(w[:-1]), -w[-1], np.zeros(7))
        scores = term_scores(every, model.weights) + w[-1]
        hard = clean[scores[clean] > FLOOR]
        negatives = np.union1d(neg, hard[np.argsort(-scores[hard], kind="stable")[:n_hard]])
        hard_pairs = list(dict.fromkeys(hard_pairs + _hard_pairs(clean_texts, model, n_hard)))
        positives = (scores > 0) & (n_toxic > 0) & (odds > 5)
        for i, own in enumerate(docs):  # at least one term of each toxic document tells
            if label[i] and not held[i] and len(own) and not positives[own].any():
                best = own[np.argmax(scores[own])]
                positives[best] = odds[best] > 5
        if not positives.any():
            return None
    pooled = document_features(texts, model)
    y = np.where(label, 1.0, -1.0)
    model.pool = _svm(np.hstack([pooled, np.ones((len(texts), 1))]), y, np.where(y > 0, 4.0, 12.0) * np.where(held, 1, TRAINED_WEIGHT))
    return model


FLOOR = -0.5


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a quarter of a million characters, or of one text."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= 1 << 18 or i == len(texts) - 1:
            yield at, i + 1
            at, size = i + 1, 0


def document_features(texts: list[str], model: Model) -> np.ndarray:
    """Of each text: its three highest word scores, clipped, the logarithm of one plus the number
    of words above 0, their share, and the highest score of two adjoining words written as one."""
    out = np.zeros((len(texts), 6))
    out[:, :3] = out[:, 5] = FLOOR
    for at, to in _chunks(texts):
        t = terms(texts[at:to])
        if not len(t.starts):
            continue
        value = np.minimum(term_scores(t, model.weights) - np.float32(model.cut), 1.5)
        near = np.flatnonzero(value > FLOOR)
        if len(near):
            doc, v = t.doc[near] + at, value[near]
            order = np.lexsort((-v, doc))
            doc, v = doc[order], v[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            top = rank < 3
            out[doc[top], rank[top]] = v[top]
            hits = np.bincount(doc[v > 0] - at, minlength=to - at)
            out[at:to, 3] = np.log1p(hits)
            out[at:to, 4] = np.minimum(1, 20 * hits / np.maximum(1, np.bincount(t.doc, minlength=to - at)))
        for both in pairs(t):
            value = np.minimum(term_scores(both, model.weights) - np.float32(model.cut), 1.5)
            near = np.flatnonzero(value > FLOOR)
            np.maximum.at(out[:, 5], both.doc[near] + at, value[near])
    return out


def document_scores(texts: list[str], model: Model) -> np.ndarray:
    """The decision of each text, above 0 for a toxic one."""
    return (document_features(texts, model) @ model.pool[:-1] + model.pool[-1]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, **bounds: int) -> Model | None:
    """bounds: landmarks, rounds, n_negatives, n_hard and variants of train."""
    per_doc = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.max("toxic") > 0).alias("__toxic"))
    chosen = None
    for side, most in ((True, max_toxic), (False, max_clean)):
        own = per_doc.where(F.col("__toxic") == side).orderBy(F.xxhash64("__id"), "__id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    sample = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text")).join(F.broadcast(chosen), "__id")
    ordered = sample.select("__id", F.coalesce("__text", F.lit("")).alias("__text"), "__toxic").repartition(1).sortWithinPartitions("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column(1).to_pylist()
            toxic += b.column(2).to_pylist()
        model = train(texts, toxic, **bounds)
        del texts[:], toxic[:]
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.cut]), pa.array([model.pool.astype("<f8").tobytes()], pa.binary())], names=["weights", "cut", "pool"])

    row = ordered.mapInArrow(released(run), "weights binary, cut double, pool binary").first()
    return row and Model(np.frombuffer(row["weights"], "<f4"), row["cut"], np.frombuffer(row["pool"], "<f8"))


def score(docs: DataFrame, model: Model | None, column: str = "toxic_score") -> DataFrame:
    """docs with a new last column toxic_score (lengthened by underscores where docs has one),
    above 0 for toxic documents."""
    column = fresh(docs, column)
    if model is None:
        return docs.withColumn(column, F.lit(float("-inf")).cast("float"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(document_scores(x.fillna("").tolist(), shared.value))

    @F.pandas_udf("float")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(scores)(batches)

    return docs.withColumn(column, run(F.col("text").cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    column = scored.columns[-1]
    return scored.where((F.col(column) <= 0) | F.col("doc_id").isNull()).drop(column)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.where("doc_id is not null").select("doc_id", "text"), model).where("toxic_score > 0")
    return found.select("doc_id", F.round(F.col("toxic_score").cast("double"), 4).alias("score"), F.lit(1).alias("toxic"))
