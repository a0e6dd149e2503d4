"""Text functions, Column to Column. Lengths and offsets are in code points.

Word boundaries are spelled out as ASCII look-arounds: the regex engine's own are Unicode-aware.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

CHARS_PER_TOKEN = 3.8
#: White space as in scripts, no-break and ideographic spaces included.
ANY_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
#: White space that a document tree collapses; the no-break space is content.
TREE_SPACE = r"[ \t\r\n\f\u000b]+"
NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
SCOPE_WORDS = ("always", "never", "every", "any", "all", "none", "no", "not", "only", "must", "may", "should", "cannot", "except", "unless", "before", "after", "least", "most", "without")
UNITS = ("second", "minute", "hour", "day", "week", "month", "year", "byte", "percent", "kb", "mb", "gb", "ms", "request", "time")


def nfc(c: Column) -> Column:
    """Canonical composition, by the ICU library that ships with the engine."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)))


def collapse(c: Column, spaces: str = ANY_SPACE) -> Column:
    return F.regexp_replace(c, spaces, " ")


def claim_key(c: Column) -> Column:
    return F.trim(collapse(F.lower(c)))


def normalize_unit(c: Column, compose: bool = True) -> Column:
    """The form in which two wordings of a fact are the same: composed, lower case, single spaces,
    no closing punctuation."""
    c = collapse(F.lower(nfc(c) if compose else c))
    return F.trim(F.regexp_replace(F.trim(c), r"[.;:,]+$", ""))


def count_tokens(c: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    return F.ceil(F.length(c).cast("double") / F.lit(float(chars_per_token))).cast("long")


def strip_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("\u00ad"), F.lit(""))


def rejoin_hyphens(c: Column) -> Column:
    """Words that a line end divides."""
    return F.regexp_replace(c, r"([a-z])-\n(?=[a-z])", "$1")


def expand_ligatures(c: Column) -> Column:
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return c


def digit_mask(c: Column) -> Column:
    """Shape of a running header or footer: numbers alike, spacing and case aside."""
    return F.trim(collapse(F.lower(F.regexp_replace(c, r"[0-9]+", "#")), TREE_SPACE))


def kebab(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", "-")
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(kebab(c), F.lit("-"), F.lit(" ")))


def slug(c: Column) -> Column:
    """Heading anchor, ASCII: other characters fall away."""
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]+", "")
    c = F.regexp_replace(F.trim(c), r"[\s-]+", "-")
    return F.when(c == "", "section").otherwise(c)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def decode_entities(c: Column, entities: dict[str, str] | None = None) -> Column:
    """Named entities, the ampersand's last, so that nothing is decoded twice; unknown ones stay."""
    for name, char in (entities or {"lt": "<", "gt": ">", "quot": '"', "copy": "©", "nbsp": " "}).items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def bounded(words: str) -> str:
    """A pattern for the words, not inside ASCII words."""
    return rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


MODAL = bounded("must|shall|should|may not|need to|needs to|has to|have to|is required to|are required to")
PROHIBITION = bounded("never|must not|mustn't|do not|don't|shall not|should not|cannot|avoid|forbidden|prohibited")


def is_modal(c: Column) -> Column:
    return F.lower(c).rlike(MODAL)


def is_prohibition(c: Column) -> Column:
    return F.lower(c).rlike(PROHIBITION)


def asserts_rule(c: Column) -> Column:
    return is_modal(c) | is_prohibition(c)


def sentences(c: Column) -> Column:
    """Sentences by rule: a line feed ends one, and so does closing punctuation before white space
    and an upper-case letter or digit."""
    cut = F.regexp_replace(c, r"([.!?]+[\"')\]]*)[ \t]+(?=[\p{Lu}0-9])", "$1\n")
    return F.filter(F.transform(F.split(cut, r"\n"), lambda x: F.trim(x)), lambda x: x != "")


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def content_words(c: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(words(c), lambda w: ~w.isin(*stop)) if stop else words(c)


def ngrams(tokens: Column, n: int) -> Column:
    count = F.size(tokens) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def stem(c: Column) -> Column:
    for end, instead in ((r"ies$", "y"), (r"(ss|x|ch|sh)es$", "$1"), (r"([^s])s$", "$1"), (r"([a-z]{3})(ing|ed)$", "$1")):
        c = F.regexp_replace(c, end, instead)
    return c


def salient_tokens(c: Column) -> Column:
    """What two wordings must agree on to state one fact: identifiers and numbers, scope words, units."""
    raw = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9_.\- ]", " "), " +")
    worth = [*NUMBERS, *_stemming_to({*SCOPE_WORDS, *map(_stem_plain, SCOPE_WORDS), *UNITS})]
    telling = lambda w: w.rlike("[0-9_]") | w.isin(*worth)
    # Few words tell anything: only they are named and stemmed.
    bare = F.filter(F.transform(raw, lambda w: F.btrim(w, F.lit(".-"))), telling)
    table = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    named = F.transform(bare, lambda w: F.coalesce(table[w], F.when(w.rlike("^[0-9]+$"), F.regexp_replace(w, r"^0+(?=[0-9])", "")).otherwise(w)))
    kept = F.filter(named, lambda w: w.rlike("[0-9_]") | stem(w).isin(*SCOPE_WORDS, *(_stem_plain(x) for x in SCOPE_WORDS)) | stem(w).isin(*UNITS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.when(w.rlike("[0-9_]"), w).otherwise(stem(w)))))


def _stemming_to(stems: set[str]) -> list[str]:
    """All words whose stem is one of stems: each of stem's four steps undone, or not."""
    found = set()
    for s in stems:
        for plain in (s + c + b + a for c in ("", "ing", "ed") for b in ("", "s") for a in ("", "es")):
            found |= {plain, *([plain[:-1] + "ies"] if plain.endswith("y") else [])}
    return sorted(w for w in found if _stem_plain(w) in stems)


def _stem_plain(w: str) -> str:
    for end, instead in ((r"ies$", "y"), (r"(ss|x|ch|sh)es$", r"\1"), (r"([^s])s$", r"\1"), (r"([a-z]{3})(ing|ed)$", r"\1")):
        w = re.sub(end, instead, w)
    return w


def token_verdict(x: Column, y: Column) -> Column:
    """'block' if the salient tokens differ, 'abstain' if neither text has any, else 'allow'."""
    differ = F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    return F.when(differ > 0, "block").when(F.size(x) == 0, "abstain").otherwise("allow")


def merge_verdict(a: Column, b: Column) -> Column:
    """token_verdict of two texts."""
    return token_verdict(salient_tokens(a), salient_tokens(b))


def authority(reviewed: Column) -> Column:
    """Trust in a source by the date of its last review; half without one."""
    when = F.year(reviewed) + F.month(reviewed) / F.lit(12.0) - 2020
    return F.when(reviewed.isNull(), 0.5).otherwise(F.greatest(F.lit(0.25), F.least(F.lit(0.85), F.lit(0.3) + when * 0.05)))


def text_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length, of code points."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _graphemes(s: str) -> list[str]:
    import regex

    return regex.findall(r"\X", s)


def edit_distance(a: list, b: list) -> int:
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]  # a common start, then a common end
    same = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@F.pandas_udf(DoubleType())
def grapheme_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """text_similarity of grapheme clusters, which SQL cannot cut."""

    def one(x, y):
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        p, q = _graphemes(x), _graphemes(y)
        return 1 - edit_distance(p, q) / max(len(p), len(q)) if p or q else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length"))).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
