"""License texts that repeat or are interrupted."""

import random
import re

from corpusloom.llm import license_scan


def every_place(text, template):
    """start, end of each place where the template's words stand one after the other."""
    words = lambda x: [(m.group().lower(), *m.span()) for m in re.finditer("[A-Za-z0-9]+|[^\x00-\x7f]+", x)]
    own, asked = words(text), [w for w, _, _ in words(template)]
    n = len(asked)
    return [(own[i][1], own[i + n - 1][2]) for i in range(len(own) - n + 1) if [w for w, _, _ in own[i : i + n]] == asked]


def test_every_repeat_of_a_short_notice(frame):
    by_name = {name: text for name, _, text in license_scan.TEMPLATES}
    names = ["reserved", "mit-notice", "cc-by-4-notice"]
    docs = [(i, "é start\n" + "\n".join([by_name[n]] * 5) + "\nend") for i, n in enumerate(names)]
    docs += [(3, "\n".join(f"Copyright 20{i} X. All rights reserved." for i in range(10, 30)))]
    docs += [(4, "All rights reserved.\n" + "other words " * 40 + "\nALL RIGHTS RESERVED. All rights reserved")]
    expected = sorted((d, n, *x) for d, t in docs for n in names for x in every_place(t, by_name[n]))
    assert [sum(d == i for d, *_ in expected) for i in range(5)] == [5, 5, 5, 20, 3]
    assert sorted(tuple(r) for r in license_scan.licenses(frame(docs)).select("doc_id", "template", "start", "end").collect()) == expected


def test_foremost():
    r = random.Random(3)
    for _ in range(200):
        found = [(r.randrange(3), (s := r.randrange(60), s + r.randint(1, 9), 1.0, r.randint(1, 4))) for _ in range(25)]
        kept = []
        for i, x in sorted(set(found), key=lambda f: (-f[1][3], f[1][0], f[0])):
            if all(x[3] == y[3] or x[1] <= y[0] or y[1] <= x[0] for _, y in kept):
                kept.append((i, x))
        assert license_scan.foremost(found) == kept


def test_interrupted_license(frame):
    texts = {name: text for name, _, text in license_scan.TEMPLATES}
    mit, bsd = texts["mit-text"].split(), texts["bsd-2-text"].split()
    head = "page 17 of some long report about quite other matters entirely".split()
    docs = [
        (1, mit[:50] + head + mit[50:]),
        (2, mit[:30] + head + mit[30:70] + head + mit[70:]),
        (3, bsd[:45] + head + bsd[45:]),
        (4, mit[:50] + head * 12 + mit[50:]),  # longer than a text may be
        (5, mit[60:] + head + mit[:60]),  # not in order
        (6, mit[:50] + head + mit[50:] + head + mit),
        (7, mit + head + mit[:40]),
    ]
    docs = [(i, "intro é\n" + " ".join(ws) + "\noutro") for i, ws in docs]
    full = len(" ".join(mit))
    joined = lambda n=1: len(" ".join(mit)) + n * len(" " + " ".join(head))
    got = sorted(tuple(r) for r in license_scan.licenses(frame(docs)).select("doc_id", "template", "start", "end", "coverage").collect())
    second = 8 + joined(2) + 1
    assert got == [
        (1, "mit-text", 8, 8 + joined() - 1, 1.0),
        (2, "mit-text", 8, 8 + joined(2) - 1, 1.0),
        (3, "bsd-2-text", 8, 8 + len(" ".join(bsd)) + len(" " + " ".join(head)) - 1, 1.0),
        (6, "mit-text", 8, 8 + joined() - 1, 1.0),
        (6, "mit-text", second, second + full - 1, 1.0),
        (7, "mit-text", 8, 8 + full - 1, 1.0),
    ]


def test_whole_texts_end_with_their_last_words(frame):
    lasts = {"mit": "DEALINGS IN THE SOFTWARE", "isc": "PERFORMANCE OF THIS SOFTWARE", "bsd-2": "POSSIBILITY OF SUCH DAMAGE", "bsd-3": "POSSIBILITY OF SUCH DAMAGE", "zlib": "from any source distribution", "unlicense": "DEALINGS IN THE SOFTWARE"}
    texts = {name: text for name, _, text in license_scan.TEMPLATES}
    docs = [(i, f"intro\n{texts[n + '-full-text']}\noutro") for i, n in enumerate(lasts)] + [(9, texts["mit-text"])]
    got = {r["doc_id"]: r for r in license_scan.licenses(frame(docs)).collect()}
    assert len(got) == 7 and got[9]["template"] == "mit-text"
    for i, (n, last) in enumerate(lasts.items()):
        assert docs[i][1][got[i]["start"] : got[i]["end"]].endswith(last) and got[i]["template"] == n + "-full-text"
        assert got[i]["start"] == 6 and got[i]["coverage"] == 1.0
