"""Line dedup, near dedup, repeated passages and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import decontaminate, line_dedup, near_dedup, substring_dedup, textvec


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def space_words(text):
    return [w for w in re.split("[ \t\n\r\f\v]+", text) if w]


def ascii_words(text):
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return [w for w in re.split(rb"[^a-z0-9\x80-\xff]+", folded) if w]


def test_tokens_are_those_of_a_split():
    texts = ["a b  a", "", None, "b", "x\ny b a", "éa b", " ", "long" * 30 + " z", "b" * 8, "b" * 16 + " " + "b" * 17]
    seen = {}
    got = []
    for t in textvec.tokenize(pa.array(texts), textvec.SPACE_TOKENS, 7):
        for i in range(t.first, t.last):
            a, b = t.bounds[i - t.first], t.bounds[i - t.first + 1]
            own = [t.data[s:e].tobytes().decode() for s, e in zip(t.starts[a:b], t.ends[a:b])]
            got.append(own)
            for w, h in zip(own, t.hashes[a:b].tolist()):
                assert seen.setdefault(w, h) == h
    assert got == [(x or "").split() for x in texts]
    assert len(set(seen.values())) == len(seen)


def test_windows_and_distinct():
    t = next(textvec.tokenize(pa.array(["a b c a b c", "a b", "", "c a b"]), textvec.SPACE_TOKENS))
    h, bounds = textvec.window_hashes(t.hashes, t.bounds, 3)
    assert bounds.tolist() == [0, 4, 4, 4, 5]
    assert h[0] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 3
    d, cut = textvec.distinct_in_runs(t.hashes, t.bounds)
    assert np.diff(cut).tolist() == [3, 2, 0, 3]
    many = np.arange(1 << 17, dtype=np.uint64) << np.uint64(20)
    d, cut = textvec.distinct_in_runs(many, np.arange(len(many) + 1))
    assert np.diff(cut).tolist() == [1] * len(many)


def row_key(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute_lines(docs, threshold):
    """(doc_id, text, line_no) of every line that goes."""
    own = {(d, t) for d, t in docs if d is not None and t is not None}
    at = sorted((d, row_key(t), n, t, frozenset(space_words(x))) for d, t in own for n, x in enumerate(t.split("\n")))
    gone = set()
    for i, (d, _, n, t, x) in enumerate(at):
        if x and any(y and len(x & y) >= threshold * len(x | y) - 1e-9 for *_, y in at[:i]):
            gone.add((d, t, n))
    return gone


def cut_lines(docs, gone):
    return [(d, t if t is None or d is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, t, n) not in gone)) for d, t in docs]


@pytest.mark.parametrize("threshold,cells,group_bytes,hot", [(0.8, 1 << 24, 1 << 26, 1 << 17), (0.5, 1 << 16, 2000, 2), (1.0, 1 << 16, 1 << 26, 1)])
def test_line_dedup(frame, corpus, threshold, cells, group_bytes, hot):
    r = random.Random(1)
    docs = list(corpus)
    for i, t in corpus[:30]:  # lines changed by a word
        lines = [" ".join(w if r.random() > 0.08 else "new" for w in x.split(" ")) for x in t.split("\n")]
        docs.append((1000 + i, "\n".join(lines)))
    docs += [(2000, corpus[1][1]), (2000, "quite another text\n" + corpus[2][1]), (2000, "a third"), (2000, "a third"), (5, "same id as another")]
    df = frame(docs)
    gone = brute_lines(docs, threshold)
    found = line_dedup.removed_lines(df, threshold, cells, group_bytes, hot).distinct().collect()
    assert gone and {tuple(x) for x in found} == {(d, row_key(t), n) for d, t, n in gone}
    if threshold == 0.8:
        done = line_dedup.dedup_lines(df, threshold)  # df has a column n_removed
        assert done.columns == [*df.columns, "n_removed_"] and done.where("n_removed <> 7").isEmpty()
        assert rows(done, "doc_id", "text") == sorted(cut_lines(docs, gone), key=repr)


def test_rows_that_share_a_doc_id_keep_what_is_theirs(frame):
    docs = [(1, "alpha beta gamma"), (2, "alpha beta gamma\nx1"), (2, "unique words here\ny1"), (3, None), (None, "alpha beta gamma")]
    done = line_dedup.dedup_lines(frame(docs))
    assert rows(done, "doc_id", "text", "n_removed_") == sorted([(1, docs[0][1], 0), (2, "x1", 1), (2, docs[2][1], 0), (3, None, 0), (None, docs[4][1], 0)], key=repr)


def test_line_dedup_of_long_texts(frame):
    long = "\n".join(f"line {i} of {i * 7919 % 5003} words" for i in range(5000))
    docs = [(1, long), (2, long + "\nnew at the end"), (3, "w " * 30000)]
    done = {r["doc_id"]: (r["text"], r["n_removed_"]) for r in line_dedup.dedup_lines(frame(docs)).collect()}
    assert done[1][0].startswith("line 0 of 0 words") and done[2] == ("new at the end", 5000) and done[3] == (docs[2][1], 0)


def test_line_dedup_of_nothing(frame):
    assert line_dedup.dedup_lines(frame([])).count() == 0
    only = [(1, None), (2, ""), (3, " \n "), (None, "a")]
    assert rows(line_dedup.dedup_lines(frame(only)), "doc_id", "text", "n_removed_") == sorted(((d, t, 0) for d, t in only), key=repr)
    with pytest.raises(ValueError):
        line_dedup.removed_lines(frame([]), 0)
    with pytest.raises(ValueError):
        line_dedup.removed_lines(frame([]), cells=1000)


def brute_groups(docs, threshold):
    sets = defaultdict(list)
    for d, t in docs:
        w = ascii_words(t or "")
        if d is not None and w:
            sets[d].append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) >= threshold * len(x | y) - 1e-9 for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(d, find(d)) for d in sets if find(d) != d}


def test_near_dedup(frame, corpus):
    docs = corpus + [(2000 + i, corpus[1][1] + f" tail{i % 7}") for i in range(60)]
    df = frame(docs)
    found = brute_groups(docs, near_dedup.THRESHOLD)
    assert len(found) > 60 and {tuple(r) for r in near_dedup.duplicates(df).collect()} == found
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    gone = {d for d, _ in found}
    assert rows(kept, "doc_id", "text") == sorted(((d, t) for d, t in docs if d not in gone), key=repr)


def test_a_bucket_of_many_different_texts(spark, monkeypatch):
    """A passage that all share puts them in common buckets; few are near each other."""
    monkeypatch.setattr(near_dedup, "CELL", 150)  # several cells a bucket
    r = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    common = " ".join(r.choice(words) for _ in range(60))
    docs = [(i, common + " " + " ".join(r.choice(words) for _ in range(90))) for i in range(2000)]
    docs += [(3000 + i, docs[7 * i][1] + " more") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {tuple(x) for x in near_dedup.duplicates(df).collect()}
    assert got == {(3000 + i, 7 * i) for i in range(100)}


def test_cells_find_the_pairs_of_their_blocks():
    r = np.random.default_rng(4)
    sets = [sketched([f"t{k}" for k in range(3 * i, 3 * i + 50 + i % 7)]) for i in range(60)]
    rows_, want = [], set()
    for band in range(3):
        own = sorted(r.choice(60, 25, replace=False).tolist())
        root = {d: d if d % 3 else 0 for d in own}
        side = {d: d % 2 for d in own}
        for p, q in ((0, 0), (0, 1), (1, 1)):
            rows_ += [(band, p, q, side[d], d, root[d], sets[d][1], sets[d][0].tobytes()) for d in own if side[d] in (p, q)]
        for a in own:
            for b in own:
                fits = min(sets[a][1], sets[b][1]) >= 0.3 * max(sets[a][1], sets[b][1])
                if a < b and root[a] != root[b] and fits and near_dedup.estimate(sets[a][0][None], sets[b][0][None], np.array([float(sets[a][1])]), np.array([float(sets[b][1])]))[0] >= 0.3 - near_dedup.MARGIN:
                    want.add((a, b))
    names = ["band", "p", "q", "at", "doc_id", "root", "n", "regs"]
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows_[k : k + size]]) for k in range(0, len(rows_), size)]
        got = {(a, b) for out in near_dedup._in_cells(0.3)(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
        assert got == want and want


def test_near_dedup_of_nothing(frame):
    assert near_dedup.duplicates(frame([])).count() == 0
    assert near_dedup.drop_near_duplicates(frame([(1, None), (2, ""), (3, "."), (4, None)])).count() == 4


def sketched(words):
    t = next(textvec.tokenize(pa.array([" ".join(words)]), textvec.WORD_TOKENS))
    h, bounds = near_dedup.shingles(t)
    return near_dedup.registers(h, bounds)[0], len(set(h.tolist()))


def test_sketches_merge_and_estimate():
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    a, b = words[:2000], words[1000:]
    x, nx = sketched(a)
    y, ny = sketched(b)
    union, _ = sketched(words)
    assert (np.maximum(x, y) == union).all()
    true = 998 / (nx + ny - 998)
    got = near_dedup.estimate(x[None], y[None], np.array([float(nx)]), np.array([float(ny)]))[0]
    assert abs(got - true) < 4 * (true * (1 - true) / near_dedup.M) ** 0.5
    assert near_dedup.estimate(x[None], x[None], np.array([nx + 0.0]), np.array([nx + 0.0]))[0] > 0.999


def brute_passages(docs, window):
    seen = Counter()
    tokens = [(d, space_words(t)) for d, t in docs if d is not None and t is not None]
    for _, w in tokens:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, w in tokens:
        runs = []
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + window
                else:
                    runs.append([i, i + window])
        out += [(d, a, b) for a, b in runs]
    return sorted(out)


@pytest.mark.parametrize("window,n_parts,chunk_bytes", [(5, 1, 1 << 25), (5, 7, 3000), (1, 3, 1 << 25), (50, None, 500)])
def test_repeated_passages(frame, corpus, window, n_parts, chunk_bytes):
    got = substring_dedup.repeated_passages(frame(corpus), window, n_parts, 5000, chunk_bytes)
    want = brute_passages(corpus, window)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_positions_pack_in_two_or_four_planes():
    for at in ([], [0], [3, 4, 70_000], [5, 70_000, 200_000, 1 << 28]):
        at = np.array(at, dtype=np.int64)
        packed = substring_dedup._gaps(at)
        assert substring_dedup._positions(packed).tolist() == at.tolist() and (not len(at) or packed[0] == (4 if np.diff(at, prepend=0).max() >= 1 << 16 else 2))


def test_repeated_passages_of_nothing(frame):
    assert substring_dedup.repeated_passages(frame([])).count() == 0
    assert substring_dedup.repeated_passages(frame([(1, "a b"), (2, None), (None, "a b")]), 2).count() == 0


def brute_leaks(docs, items, words):
    out = []
    for d, t in docs:
        if d is None or t is None:
            continue
        own = [(m.group().lower(), m.span()) for m in re.finditer(r"\w+", t)]
        for item, text in items:
            w = [x.lower() for x in re.findall(r"\w+", text or "")]
            n = min(words, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            runs = []
            for i in range(len(own) - n + 1) if n else ():
                if tuple(x for x, _ in own[i : i + n]) in grams:
                    if runs and i <= runs[-1][1]:
                        runs[-1][1] = i + n
                    else:
                        runs.append([i, i + n])
            out += [(d, item, own[a][1][0], own[b - 1][1][1]) for a, b in runs]
    return sorted(out)


def test_decontamination(spark, frame, corpus):
    items = [(1, "What is THE answer,   to it? Forty-two, of course."), (2, corpus[5][1]), (3, None), (4, "..."), (5, corpus[5][1]), (6, "Kurz, ÉTÉ!"), (7, "b a n a n a")]
    docs = corpus + [
        (500, "so: what is the answer to it?\n\nforty two — of course! And so on"),
        (501, "voilà... kurz   été, kurz (été)"),
        (502, "xkurz été; b a n a n a n a; banana"),
        (503, "pre " + corpus[5][1].upper()),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words, most in ((13, 10**6), (4, 10**6), (13, 200)):
        got = decontaminate.contaminated(frame(docs), bench, words, most)
        want = brute_leaks(docs, items, words)
        assert len(want) > 5 and sorted(tuple(r) for r in got.collect()) == want
    kept = decontaminate.drop_contaminated(frame(docs), bench)
    bad = {d for d, *_ in brute_leaks(docs, items, 13)}
    assert rows(kept, "doc_id", "text") == sorted(((d, t) for d, t in docs if d not in bad), key=repr)
    assert decontaminate.contaminated(frame([]), bench).count() == 0
    assert decontaminate.contaminated(frame(docs), bench.limit(0)).count() == 0
