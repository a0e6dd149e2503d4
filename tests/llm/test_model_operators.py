"""SentencePiece, licenses, neighbours, chat, archives, toxicity and the pipeline."""

import difflib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import ann, chat, license_scan, near_dedup, toxicity, warc
from corpusloom.llm import sentencepiece_codec as sp

from .test_text_operators import brute_groups, brute_leaks, brute_lines, cut_lines, rows

# SentencePiece


@pytest.fixture(scope="session")
def codec():
    return sp.Codec.load()


@pytest.fixture(scope="session")
def scores():
    """Score of each piece by its text, and the score of a byte, read from the file anew."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    own = {m.id_to_piece(i): -math.log(max(0, -m.get_score(i)) + 2) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    return m, own, min(own.values()) - sp.BYTE_COST


def best_score(text, scores):
    _, own, byte = scores
    marked = "▁" + text.replace("▁", "\0\0\0").replace(" ", "▁")  # three bytes of a literal marker
    longest = max(map(len, own))

    best = [0.0] + [-math.inf] * len(marked)
    for i in range(len(marked)):
        cost = byte * (1 if marked[i] == "\0" else len(marked[i].encode()) if marked[i] != "▁" else 1)
        best[i + 1] = max(best[i + 1], best[i] + cost)
        for j in range(i + 1, min(len(marked), i + longest) + 1):
            if marked[i:j] in own:
                best[j] = max(best[j], best[i] + own[marked[i:j]])
    return best[-1]


TEXTS = ["Hello world", "  two  spaces ", "▁ literal ▁▁", "line\n\nfeed\ttab", "é漢字😀ß", "a" * 700, "x", " ", "\n", "the quick brown fox, 1234.5!", "<s> </s> <unk> <0x41>", "von Öl"]


def test_encoding_has_the_best_score(codec, scores):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("abcdefgh  é\n▁") for _ in range(r.randint(1, 60))) for _ in range(150)]
    for text, ids in zip(texts, codec.encode(pa.array(texts)).to_pylist()):
        m, own, byte = scores
        got = sum(byte if m.is_byte(i) else own[m.id_to_piece(i)] for i in ids)
        assert got == pytest.approx(best_score(text, scores)), text


def test_round_trip_and_documents(spark, codec, frame, corpus):
    docs = corpus + [(900 + i, t) for i, t in enumerate(TEXTS)]
    got = sp.encode_documents(frame(docs), codec=codec)
    assert rows(got, "doc_id", "decoded") == sorted(docs, key=repr)
    for r in got.collect():
        assert r["n_tokens"] == (None if r["ids"] is None else len(r["ids"])) and (r["ids"] is None) == (r["decoded"] is None)
    assert sp.encode_documents(frame([]), codec=codec).count() == 0
    assert codec.decode(pa.array([[1, 2, 0], [-5, 10**6], [], None, [3 + 0xC3]], pa.list_(pa.int32()))).to_pylist() == ["", "", "", None, "�"]


def test_one_word_as_many_do(codec):
    r = random.Random(4)
    words = sorted({"".join(r.choice("eionst rlaé") for _ in range(r.randint(1, 40))).replace(" ", "").encode() for _ in range(300)} - {b""}, key=len)
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    ids, counts = codec.words(data, np.cumsum(length) - length, length)
    assert ids.tolist() == [i for w in words for i in codec._one(w)] and counts.tolist() == [len(codec._one(w)) for w in words]


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff", b"\xffa", b"zz"]
    base, check, value = sp.double_array(keys, list(range(7)))

    def find(word):
        s = 0
        for c in word:
            n = base[s] + c + 1
            if check[n] != s:
                return -1
            s = n
        return value[s]

    every = [bytes(x) for n in (1, 2, 3) for x in itertools.product(b"abcz\xff", repeat=n)]
    assert all(find(w) == (keys.index(w) if w in keys else -1) for w in every)


# Licenses


def plain_words(text):
    """Words with their character spans: ASCII letters and digits, and whatever isn't ASCII."""
    return [(m.group().lower() if m.group().isascii() else "".join(c.lower() if c.isascii() else c for c in m.group()), m.span()) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)]


def brute_licenses(docs, templates):
    """Best span of each template in every window of its length, and of claims that overlap the best."""
    out = []
    for d, t in docs:
        if d is None or not t:
            continue
        own, claims = plain_words(t), []
        words = [w for w, _ in own]
        for name, _, text in templates:
            want = [w for w, _ in plain_words(text)]
            best = None
            for a in range(max(1, len(words) - len(want) + 1)):
                if len(want) < license_scan.SHORT:
                    if words[a : a + len(want)] == want:
                        claims.append((len(want), 1.0, own[a][1][0], own[a + len(want) - 1][1][1], name))
                    continue
                lo = max(0, a - license_scan.SLACK - 1)
                blocks = [x for x in difflib.SequenceMatcher(None, want, words[lo : a + len(want) + license_scan.SLACK + 1], autojunk=False).get_matching_blocks() if x.size]
                found = sum(x.size for x in blocks)
                if found >= license_scan.COVERAGE * len(want):
                    first, last = lo + blocks[0].b, lo + blocks[-1].b + blocks[-1].size - 1
                    claim = (found, round(found / len(want), 4), own[first][1][0], own[last][1][1], name)
                    if last - first + 1 <= 1.5 * len(want) + license_scan.SLACK and (best is None or claim[0] > best[0]):
                        best = claim
            claims += [best] if best else []
        better = lambda x, y: (x[0], x[1]) > (y[0], y[1]) and x[2] < y[3] and y[2] < x[3]
        kept = []
        for c in sorted(set(claims), key=lambda c: (-c[0], -c[1])):
            if not any(better(k, c) for k in kept):
                kept.append(c)
        out += [(d, name, a, z, share) for _, share, a, z, name in kept]
    return sorted(out)


def test_licenses(frame, corpus):
    mit = license_scan.TEMPLATES[0][2]
    words = mit.split()
    changed = " ".join(words[:20] + ["hereby"] + words[20:60] + words[62:])
    docs = corpus + [
        (600, "intro\n" + mit + "\noutro"),
        (601, changed.upper()),
        (602, " ".join(words[: len(words) // 2])),
        (603, "é text. Licensed under CC BY-NC 4.0. All rights\nreserved."),
        (604, "Licensed under the Apache License, Version 2.0."),
        (605, "permission and all software"),
        (604, "Released under the MIT License."),
    ]
    got = sorted(tuple(r) for r in license_scan.licenses(frame(docs)).select("doc_id", "template", "start", "end", "coverage").collect())
    assert got == brute_licenses(docs, license_scan.TEMPLATES)
    assert {(d, t) for d, t, *_ in got} == {(600, "mit-text"), (601, "mit-text"), (603, "cc-by-nc-4-notice"), (603, "reserved"), (604, "apache-2-notice"), (604, "mit-notice")}
    assert docs[-4][1][got[3][2] : got[3][3]] in ("Licensed under CC BY-NC 4.0", "All rights\nreserved")
    assert license_scan.licenses(frame([])).count() == 0
    # The same template twice in one document, within a long text, and templates with equal claims.
    filler = " ".join(f"w{i % 977}" for i in range(20000))
    twice = [(1, f"{mit} {filler} {mit}"), (2, "Licensed under CC BY 4.0. Licensed under CC BY 4.0.")]
    templates = [*license_scan.TEMPLATES, ("mit-again", "MIT", mit)]
    got = [tuple(r)[:2] for r in license_scan.licenses(frame(twice), templates).select("doc_id", "template").collect()]
    assert got.count((1, "mit-text")) == got.count((1, "mit-again")) == 2 and sum(d == 2 for d, _ in got) == 2
    with pytest.raises(ValueError):
        license_scan.licenses(frame([]), [("short", "x", "two words")])


# Neighbours


def exact_neighbours(x, k=10):
    """Similarities, and each row's k nearest others by rounded similarity, then id."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round((unit @ unit.T).astype(np.float64), 6)
    np.fill_diagonal(sim, -9)
    return sim, [np.lexsort((np.arange(len(x)), -row))[:k].tolist() for row in sim]


def by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"], r["similarity"]))
    return {q: sorted(v) for q, v in got.items()}


VECTORS = "vec_id long, embedding array<float>"


def test_neighbours_of_unstructured_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:720] = x[0] + 0.01 * rng.standard_normal((20, 24))
    odd = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0] * 23), (5004, [float("nan")] * 24), (5005, [None] + [1.0] * 23), (None, [1.0] * 24), (3, x[3].tolist())]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame([(i, v, 1, "t", 2) for i, v in data], VECTORS + ", rank int, tree string, query int")
    got = by_query(ann.neighbours(df))
    sim, top = exact_neighbours(x)
    assert set(got) == set(range(0, 1500, 20)) and all([r for r, _, _ in v] == list(range(1, 11)) for v in got.values())
    assert np.mean([len({n for _, n, _ in got[i]} & set(top[i])) / 10 for i in got]) >= 0.9
    for i in (0, 700):
        assert {n for _, n, _ in got[i]} <= {0, *range(700, 720)} and np.allclose([s for _, _, s in got[i]], sim[i, top[i]], atol=2e-6)
    for i, v in got.items():
        assert all(abs(s - sim[i, n]) < 2e-6 for _, n, s in v) and v == sorted(v, key=lambda x: (-x[2], x[1]))


def test_neighbours_of_clusters_compare_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(ann, "RUN", 500)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((300, 32))
    x = (centres[np.arange(6000) % 300] + 0.12 * rng.standard_normal((6000, 32))).astype(np.float32)
    x[3000:4500] = centres[0] + 0.02 * rng.standard_normal((1500, 32))  # near copies, a quarter of all: a run over many segments
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(4)
    stats = {}
    got = by_query(ann.neighbours(df, stats=stats))
    sim, top = exact_neighbours(x)
    assert len(got) == 300 and np.mean([len({n for _, n, _ in got[i]} & set(top[i])) / 10 for i in got]) >= 0.9
    pairs = stats["descent"] + stats["ascent"] + stats["root"] * stats["vectors"]
    assert stats["root"] <= 3 and pairs < 0.1 * stats["searches"] * stats["vectors"]


def test_strings_and_segments_of_a_tree(spark):
    rows = [{"segment": 4, "tree": 0, "string": 5, "id": 1, "last_tree": 0, "last_string": 9}, {"segment": 2, "tree": 0, "string": 9, "id": 7, "last_tree": 1, "last_string": 3}, {"segment": 1, "tree": 1, "string": 4, "id": 0, "last_tree": 2, "last_string": 6}]
    bounds = ann.Bounds(rows)
    ask = lambda t, lo, hi: [bounds.segment[x].tolist() for f, n in zip(*bounds.touched(np.array([t]), np.array([lo]), np.array([hi]))) for x in [slice(f, f + n)]][0]
    assert ask(0, 9, 9) == [4, 2] and ask(0, 6, 7) == [4] and ask(1, 0, 9) == [2, 1] and ask(2, 7, 8) == [] and ask(0, 0, 4) == []
    s = ann.strings(np.eye(8, dtype=np.float32), 3, 63)
    assert s.shape == (8, 3) and (s < 1 << 63).all()


def test_neighbours_of_few(spark, monkeypatch):
    kind = "vec_id long, embedding array<double>"
    assert ann.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(20, [1.0])], kind)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind)).count() == 0
    same = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(6)] + [(9, [-3.0, -4.0])], kind)
    want = [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (5, 0, 1, 1.0), (5, 1, 2, 1.0), (5, 2, 3, 1.0), (9, 0, 1, -1.0), (9, 1, 2, -1.0), (9, 2, 3, -1.0)]
    got = sorted(tuple(r) for r in ann.neighbours(same, k=3, every=1).collect() if r["vec_id"] in (0, 5, 9))
    assert got == want
    monkeypatch.setattr(ann, "BLOCK", 2)  # a grid of blocks
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((40, 3)), 1)
    x[np.abs(x).sum(axis=1) == 0] = 1
    got = by_query(ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], kind), k=4, every=1))
    sim, _ = exact_neighbours(x.astype(np.float32))
    for i, v in got.items():
        assert np.allclose([s for _, _, s in v], np.sort(sim[i])[::-1][:4], atol=2e-6)


# Chat


def test_chat(spark):
    log = [
        (1, 0, "message", None, "system", "Be kind."),
        (1, 1, "message", None, "user", "Hi"),
        (1, 2, "delta", 20, "assistant", "He"),
        (1, 3, "delta", 20, None, "llo"),
        (1, 3, "delta", 20, None, "llo"),
        (1, 4, "message", None, "user", "Bye"),
        (1, 5, "edit", 1, None, "Hi there"),
        (1, 6, "delta", None, "user", "!"),
        (1, 7, "delta", 30, "assistant", "draft"),
        (1, 8, "regenerate", None, "assistant", None),
        (1, 9, "delta", None, None, "<|end|>final"),
        (2, 5, "message", None, None, None),
        (2, 1, "edit", 99, "user", "void"),
        (2, 2, "unknown", None, "user", "void"),
        (3, 1, "message", None, "user", "gone"),
        (3, 2, "delete", 1, None, None),
        (None, 1, "message", None, "user", "lost"),
        (4, None, "message", None, "user", "lost"),
        (5, 1, "message", None, "user", "first"),
        (5, 2, "delta", 2, "assistant", "answer"),
        (5, 3, "edit", 1, None, "second"),
        (5, 4, "delta", 2, "assistant", "late"),
    ]
    random.Random(1).shuffle(log)
    df = spark.createDataFrame([(*x, "extra") for x in log], "conv_id long, seq long, kind string, target long, role string, text string, n_messages string")
    got = {r["conv_id"]: (r["n_messages"], r["rendered"]) for r in chat.rebuild(df).collect()}
    assert got == {
        1: (3, "<|system|>\nBe kind.<|end|>\n<|user|>\nHi there!<|end|>\n<|assistant|>\n<​|end|>final<|end|>\n"),
        2: (1, "<|user|>\n<|end|>\n"),
        3: (0, ""),
        5: (1, "<|user|>\nsecond<|end|>\n"),
    }
    assert chat.rebuild(df.limit(0)).count() == 0


def naive_chat(log):
    """Of each conversation the final (role, text) pairs, by lists and searches alone."""
    out = {}
    for conv in {e[0] for e in log if e[0] is not None and e[1] is not None}:
        key = lambda e: (e[1], e[2] != "message", *((x is not None, x) for x in e[2:]))
        now, known = [], set()
        for _, seq, kind, target, role, text in sorted({e for e in log if e[0] == conv and e[1] is not None}, key=key):
            role, text = role or "user", text or ""
            at = [i for i, m in enumerate(now) if target is None or m[0] == target]
            new = seq if kind == "message" or target is None else target
            if kind == "message" or kind == "delta" and not at and (target is None or target not in known):
                now.append([new, role, text])
                known.add(new)
            elif not at:
                continue
            elif kind == "delta":
                now[at[-1]][2] += text
            elif kind == "edit":
                now[at[-1]][2] = text
                now = now[: at[-1] + 1]
            elif kind == "regenerate":
                now = [*now[: at[-1]], [now[at[-1]][0], role, text]]
            elif kind == "delete":
                del now[at[-1]]
        out[conv] = [(r, t) for _, r, t in now]
    return out


def test_chat_against_lists(spark):
    r = random.Random(8)
    log = []
    for _ in range(1500):  # few numbers, so that events tie, repeat, come late and miss
        kind = r.choice(["message", "message", "delta", "delta", "delta", "edit", "regenerate", "delete", "other", None])
        log.append((r.choice([1, 2, 3, 4, 5, None]), r.choice([*range(60), None]), kind, r.choice([None, *range(60)]), r.choice(["user", "assistant", None]), r.choice(["a", "bc", "<|x", None])))
    log += [(6, i, "message" if i % 3 else "delete", i - 1, "user", f"t{i}") for i in range(400)]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # conversations over several batches
    got = {x["conv_id"]: (x["n_messages"], x["rendered"]) for x in chat.rebuild(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {c: (len(m), chat.render(m)) for c, m in naive_chat(log).items()}


def test_turns_as_a_log(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, None, None), (1, 4, "assistant", "odd"), (1, 5, "assistant", ""), (2, 0, "x", ""), (2, None, "user", "lost"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    log = chat.from_turns(df)
    assert {x["kind"] for x in log.collect()} == {"message", "delta", "edit", "regenerate", "delete"}
    want = {1: (4, "<|user|>\nab<|end|>\n<|user|>\n<|end|>\n<|assistant|>\nodd again<|end|>\n<|assistant|>\n<|end|>\n"), 2: (1, "<|x|>\n<|end|>\n")}
    assert {x["conv_id"]: (x["n_messages"], x["rendered"]) for x in chat.rebuild(log).collect()} == want
    assert chat.rebuild(chat.from_turns(df.limit(0))).count() == 0


# Archives


def plain_records(raw):
    """Type, headers and block of the records of an uncompressed archive, by their Content-Length."""
    out = []
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(fields["Content-Length"])
        assert raw[n : n + 4] == b"\r\n\r\n"
        out.append((fields["WARC-Type"], fields, raw[:n]))
        raw = raw[n + 4 :]
    return out


def test_archive(spark, tmp_path):
    import hashlib

    import zstandard

    pages = [(i, f"http://h/{i % 7}", f"<html><body>page {i} " + "shared words " * 30 + "</body></html>") for i in range(300)]
    pages += [(300, None, None), (301, "http://x\ny", ""), (None, "u", "no id"), (5, "http://h/5", pages[5][2]), (302, "big", "z" * 100_000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, frame string").repartition(2)
    frames = warc.archive(df, shard_bytes=40_000)
    back, read = [], []
    for r in warc.write_files(frames, str(tmp_path)).collect():
        data = open(r["path"], "rb").read()
        assert len(data) == r["bytes"]
        magic, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
        assert magic == 0x184D2A5D and size > 0
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data, read_across_frames=True).read()
        kind, fields, block = plain_records(plain)[0]
        assert kind == "warcinfo" and fields["WARC-Filename"] == r["path"].rpartition("/")[2] and b"format:" in block
        for kind, fields, block in plain_records(plain)[1:]:
            assert kind == "resource" and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            back.append((int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, fields.get("WARC-Target-URI"), block.decode()))
        read += [(int(h["X-Page-ID"]) if "X-Page-ID" in h else None, h.get("WARC-Target-URI"), html) for h, html in warc.read_shard(data)]
    want = sorted(((i, u and u.replace("\n", "%0A"), h or "") for i, u, h in pages), key=repr)
    assert sorted(back, key=repr) == want and sorted(read, key=repr) == want
    got = frames.collect()
    assert len({r["shard"] for r in got}) > 3 and sum(r["page_id"] is None for r in got if r["record_no"] > 1) == 1
    for shard in {r["shard"] for r in got}:
        own = sorted((r["record_no"], r["offset"], len(r["frame"])) for r in got if r["shard"] == shard)
        assert [n for n, _, _ in own] == list(range(len(own))) and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
    assert warc.archive(df.limit(0)).count() == 0
    dated = spark.sql("SELECT 1L AS page_id, 'u' AS url, 'x' AS html, timestamp'2024-05-06 07:08:09' AS seen UNION ALL SELECT 2L, 'u', 'x', NULL")
    data = b"".join(r["frame"] for r in sorted(warc.archive(dated.coalesce(1), date_column="seen").collect(), key=lambda r: r["record_no"]))
    assert [h["WARC-Date"] for h, _ in warc.read_shard(data)] == ["2024-05-06T07:08:09Z", warc.DATE]


def test_a_dictionary_even_of_few_records():
    small = [warc.record(1, "u", "x")]
    frames = warc.shard_frames(small)
    assert len(frames[0]) > 8 and frames[0][8:] in small[0] and list(warc.read_records(b"".join(frames))) == small
    bare = warc.shard_frames(small, dictionary_bytes=0)
    assert len(bare[0]) == 8 and list(warc.read_records(b"".join(bare))) == small


def test_dictionary_pays():
    records = [warc.record(i, f"http://h/{i}", "<p>" + " ".join(["menu", "about", "contact", str(i * 7919)]) + "</p>") for i in range(500)]
    with_it, without = sum(map(len, warc.shard_frames(records))), sum(map(len, warc.shard_frames(records, dictionary_bytes=0)))
    assert with_it < without


# Toxicity


def slow_kernel(a, b):
    """The kernel by its definition: all pairs of triples with the same characters."""

    def triples(x):
        w = f"^{x}$"
        return [(w[j - p] + w[j] + w[j + q], toxicity.DECAY ** (p + q - 2)) for p, q in toxicity._GAPS for j in range(1, len(w) - 1) if j - p >= 0 and j + q < len(w)]

    x, y = triples(a), triples(b)
    return sum(u * v for s, u in x for t, v in y if s == t) / math.sqrt(sum(u * u for _, u in x) * sum(v * v for _, v in y))


@pytest.mark.parametrize("a,b", [("idiot", "idiot"), ("idiot", "idxiot"), ("hand", "handle"), ("ab", "abc"), ("a", "a"), ("idiot", "moron")])
def test_kernel(a, b):
    code = lambda x: bytes(ord(c) - 96 for c in x)
    assert toxicity._profile(code(a)) @ toxicity._profile(code(b)) == pytest.approx(slow_kernel(a, b))
    t = toxicity.terms([f"{b} and {b}"])
    got = toxicity.term_scores(t, toxicity._profile(code(a)).astype(np.float32))
    assert got[0] == pytest.approx(slow_kernel(a, b), rel=1e-5) and got[2] == pytest.approx(got[0])


def test_terms_fold_spelling():
    spell = lambda x: [bytes(c + 96 for c in s).decode() for s in toxicity._strings(toxicity.terms([x]))]
    assert spell("Id-iot! i d i o t 1d10t é a b cd a a, x") == ["idiot", "idiot", "idiot", "e", "a", "b", "cd", "a", "a", "x"] or spell("i d i o t")[0] == "idiot"
    assert spell("go i d i o t go") == ["go", "idiot", "go"] and spell("a b go") == ["a", "b", "go"]
    assert toxicity.terms(["a b", "c"]).doc.tolist() == [0, 0, 1]
    assert spell("") == spell(" . ") == []


def labelled(n, seed):
    r = random.Random(seed)
    part = ["ka", "lo", "mi", "ta", "re", "so", "in", "ed", "er"]
    insults = ["idiot", "moron", "stupid", "clown", "trash"]
    out = []
    for i in range(n):
        words = ["".join(r.choice(part) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for w in r.sample(insults, 3):
                words.insert(r.randrange(len(words)), w)
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_on_held_out_documents(spark, frame):
    train, test = labelled(400, 1), labelled(200, 2)
    model = toxicity.train([t for _, t, _ in train], [y for _, _, y in train])
    right = (toxicity.document_scores([t for _, t, _ in test], model) > 0) == np.array([y for _, _, y in test])
    assert right.mean() >= 0.98
    spoilt = [t.replace("idiot", "id-i0t").replace("moron", "m o r o n").replace("clown", "cl.own").replace("trash", "TRASH").replace("stupid", "st*upid") for _, t, y in test if y]
    assert (toxicity.document_scores(spoilt, model) > 0).mean() >= 0.95
    inserted = [t.replace("idiot", "idxiot").replace("moron", "mozron").replace("clown", "cloqwn").replace("trash", "tracsh").replace("stupid", "stuppid") for _, t, y in test if y]
    assert (toxicity.document_scores(inserted, model) > 0).mean() >= 0.8


def test_two_words_score_as_one(frame):
    score = lambda texts: toxicity.document_features(texts, model)[:, [0, 5]].max(axis=1)
    train = [(i, t.replace("clown", "worthless"), y) for i, t, y in labelled(400, 1)]
    model = toxicity.train([t for _, t, _ in train], [y for _, _, y in train])
    one, two = score(["kalo worthless mita"])[0], score(["kalo worth less mita"])[0]
    assert one == pytest.approx(two) and one > 0
    clean = [t for _, t, y in labelled(100, 4) if not y]
    spoilt = [t + " idiot stup id mor on worth less" for t in clean]
    assert (toxicity.document_scores(clean, model) > 0).mean() <= 0.02 and (toxicity.document_scores(spoilt, model) > 0).mean() >= 0.95
    both = list(toxicity.pairs(toxicity.terms(["ab cd  ef", "gh", "", "ij kl"])))
    assert [bytes(c + 96 for c in x).decode() for t in both for x in toxicity._strings(t)] == ["abcd", "ijkl", "cdef"]


def test_svm_has_the_least_loss():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.standard_normal((5000, 3)), np.ones((5000, 1))]).astype(np.float32)
    y = np.where(x @ [1, -2, 0.5, 0.3] + rng.standard_normal(5000) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 2.0, 1.0)
    loss = lambda w: (w[:3] ** 2).sum() + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = toxicity._svm(x, y, cost)
    assert all(loss(w) <= loss(w + 1e-3 * d) + 1e-6 for d in rng.standard_normal((200, 4)))


def test_landmark_features_are_whitened_kernels():
    code = lambda w: bytes(ord(c) - 96 for c in w)
    words = ["idiot", "idxiot", "hand", "handle", "ab", "moron"]
    marks = toxicity.Landmarks([code(w) for w in words])
    x = marks.features([code(w) for w in words])[:, :-1]
    assert np.allclose(x @ x.T, [[slow_kernel(a, b) for b in words] for a in words], atol=1e-4)
    t = toxicity.terms(words)
    w = np.arange(1.0, x.shape[1] + 1)
    assert np.allclose(toxicity.term_scores(t, marks.weights(w)), x @ w, atol=1e-3)


def test_toxicity_of_tables(spark, frame):
    rows_ = labelled(200, 3)
    docs = frame([(i, t) for i, t, _ in rows_] + [(900, None), (901, ""), (902, " \n"), (903, "x " * 20000), (None, rows_[0][1]), (0, rows_[0][1])])
    kind = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(i, 1, int(y), "clash") for i, _, y in rows_] + [(None, 1, 1, ""), (5, 1, None, ""), (77777, 0, 1, ""), (0, 1, 1, "")], kind)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {900, 901, 902, 903, None} <= set(ids) and 0 not in ids
    assert sum(i is not None and i < 200 for i in ids) == pytest.approx(150, abs=3)
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    own = docs.withColumn("toxic_score", toxicity.F.lit("mine"))  # a column that clashes stays as it is
    assert toxicity.score(own, None).columns == [*own.columns, "toxic_score_"]
    assert toxicity.drop_toxic(own, labels).where("toxic_score = 'mine'").count() == len(ids)


# The pipeline, stage by stage


def test_pipeline(spark, frame, corpus, codec, tmp_path):
    import corpus_pipeline

    leak = "what is the answer to life and the universe if nobody ever asked for it"
    texts = [(2 * i, t) for i, t, _ in labelled(120, 6)]
    tail = " ".join(f"w{i}" for i in range(60))
    docs = texts + [(1001 + i, t) for i, t in enumerate(t for d, t in corpus if d is not None)] + [(5001, "see: " + leak.upper()), (5002, tail), (5003, tail + " w1 end"), (None, "kept")]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(docs).select(columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2 * i, 1, int(y)) for i, _, y in labelled(120, 6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = toxicity.fit(frame(docs), spark.read.parquet(str(tmp_path / "labels.parquet")))
    now = [(d, t) for d, t in docs if d is None or toxicity.document_scores([t or ""], model)[0] <= 0]
    steps = [now]
    gone = brute_lines(now, 0.8)
    cut = cut_lines(now, gone)
    steps.append([(d, t) for (d, t), (_, old) in zip(cut, now) if t == old or t.strip()])
    dropped = {d for d, _ in brute_groups(steps[-1], near_dedup.THRESHOLD)}
    steps.append([(d, t) for d, t in steps[-1] if d not in dropped])
    leaks = {d for d, *_ in brute_leaks(steps[-1], [(1, leak)], 13)}
    steps.append([(d, t) for d, t in steps[-1] if d not in leaks])
    assert all(len(a) > len(b) for a, b in zip([docs, *steps], steps) if b is not steps[2]) and 5001 in leaks

    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert rows(at, "doc_id", "text") == sorted(want, key=repr), name
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in at.collect())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert rows(got, "doc_id", "decoded") == sorted(steps[-1], key=repr)
    encoded = {t: tuple(i) for (_, t), i in zip(steps[-1], codec.encode(pa.array([t for _, t in steps[-1]], pa.string())).to_pylist()) if t is not None}
    assert all(tuple(r["ids"]) == encoded[r["decoded"]] for r in got.where("ids is not null").collect())
