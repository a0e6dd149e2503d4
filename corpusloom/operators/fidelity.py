"""How alike are two documents: trees, text, tables, spans; and against a baseline."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.nodes import per_document
from .gates import bag_overlap

TOLERANCE = 0.005


def compare_to_baseline(now: DataFrame, baseline: DataFrame, key: list[str], metrics: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """key, metric, value, baseline, state: regression, improvement, same, missing (no longer
    measured) or added."""
    long = lambda df, name: df.unpivot(key, metrics, "metric", name)
    both = long(now, "value").join(long(baseline, "baseline"), [*key, "metric"], "full_outer")
    state = (
        F.when(F.col("baseline").isNull(), "added").when(F.col("value").isNull(), "missing")
        .when(F.col("value") < F.col("baseline") - tolerance, "regression").when(F.col("value") > F.col("baseline") + tolerance, "improvement").otherwise("same")
    )
    return both.withColumn("state", state)


def metric_means(rows: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Means of the values that were measured (0 or more), -1 without any."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.avg(F.when(F.col(m) >= 0, F.col(m))), F.lit(-1.0)).alias(m) for m in metrics))


def census(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by, "type").agg(F.count("*").alias("n"))


def census_delta(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Types whose counts differ between two censuses."""
    both = a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), [*key, "type"], "full_outer").na.fill(0, ["a", "b"])
    return both.withColumn("delta", F.col("b") - F.col("a")).where("delta <> 0")


def _forest(labels: list[str], parents: list[int], known: dict) -> tuple[list[list[int]], list[int], list[int], list[int]]:
    """Children of each node, the roots, a number for each node's subtree (equal subtrees have equal ones), sizes."""
    kids: list[list[int]] = [[] for _ in labels]
    roots, number, size = [], [0] * len(labels), [1] * len(labels)
    for i, p in enumerate(parents):
        (kids[p] if p >= 0 else roots).append(i)
        number[i] = known.setdefault((labels[i], tuple(number[c] for c in kids[i])), len(known))
        size[i] += sum(size[c] for c in kids[i])
    return kids, roots, number, size


def _within(labels_a: list[str], la: list[int], labels_b: list[str], lb: list[int], k: int) -> int:
    """The method of Zhang and Shasha, over nodes whose post-order numbers differ by at most k alone: no mapping of k
    edits or fewer needs others. A result above k is an upper bound."""
    far = len(la) + len(lb) + 1
    dist: list[list[int]] = [[far] * (2 * k + 1) for _ in la]
    roots = lambda left: sorted({x: i for i, x in enumerate(left)}.values())
    others = sorted((lb[j], j) for j in roots(lb))
    for i in roots(la):
        p = la[i]
        for q, j in sorted(others[bisect_left(others, (p - k, -1)) : bisect_left(others, (p + k + 1, -1))], key=lambda x: x[1]):
            starts, rows = [], []
            for x in range(p - 1, min(i, j + k) + 1):
                lo, hi = max(q - 1, x - k), min(j, x + k)
                row: list[int] = []
                for y in range(lo, hi + 1):
                    if x < p:
                        row.append(y - q + 1)
                        continue
                    up = rows[-1][y - starts[-1]] if y - starts[-1] < len(rows[-1]) else far
                    if y < q:
                        row.append(up + 1)
                        continue
                    c = min(up, row[-1] if row else far) + 1
                    whole = la[x] == p and lb[y] == q
                    r = (x - 1 if whole else la[x] - 1) - p + 1
                    at = (y - 1 if whole else lb[y] - 1) - starts[r]
                    if 0 <= at < len(rows[r]):
                        c = min(c, rows[r][at] + ((labels_a[x] != labels_b[y]) if whole else dist[x][y - x + k]))
                    if whole:
                        dist[x][y - x + k] = c
                    row.append(c)
                starts.append(lo)
                rows.append(row)
    return dist[-1][len(lb) - len(la) + k]


def tree_distance(labels_a: list[str], parents_a: list[int], labels_b: list[str], parents_b: list[int]) -> int:
    """Edit distance of ordered labelled trees in post-order, unit costs. Equal trees at either end of two forests, and
    equal roots of one tree each, cost nothing in some best mapping and are taken off; of the rest a band of
    the tables of Zhang and Shasha is filled, twice as wide until it holds the distance: work and memory
    grow with the nodes times the distance, for trees that are not alike with the square of the nodes."""
    known: dict = {}
    kids_a, a, number_a, size_a = _forest(labels_a, parents_a, known)
    kids_b, b, number_b, size_b = _forest(labels_b, parents_b, known)
    while True:
        ends = [0, 0]
        for side, step in enumerate((1, -1)):
            for x, y in zip(a[::step], b[::step]):
                if number_a[x] != number_b[y] or sum(ends) >= min(len(a), len(b)):
                    break
                ends[side] += 1
        a, b = a[ends[0] : len(a) - ends[1]], b[ends[0] : len(b) - ends[1]]
        if len(a) != 1 or len(b) != 1 or labels_a[a[0]] != labels_b[b[0]]:
            break
        a, b = kids_a[a[0]], kids_b[b[0]]
    n, m = sum(size_a[x] for x in a), sum(size_b[x] for x in b)
    if not n or not m:
        return n + m

    def under_one_root(roots: list[int], labels: list[str], kids: list[list[int]], size: list[int]) -> tuple[list[str], list[int]]:
        own, left = [], []
        for r in roots:
            for x in range(r - size[r] + 1, r + 1):
                left.append(len(left) - size[x] + 1)
                own.append(labels[x])
        return [*own, ""], [*left, 0]

    one, other = under_one_root(a, labels_a, kids_a, size_a), under_one_root(b, labels_b, kids_b, size_b)
    k = max(8, abs(n - m))
    while True:
        d = _within(*one, *other, k)
        if d <= k or k >= max(n, m):
            return d
        k *= 2


@F.pandas_udf(DoubleType())
def structural_similarity(labels_a: pd.Series, parents_a: pd.Series, labels_b: pd.Series, parents_b: pd.Series) -> pd.Series:
    """1 - distance / nodes, of trees of any size."""

    def one(a, p, b, q):
        if a is None or b is None:
            return None
        if list(a) == list(b) and list(p) == list(q):
            return 1.0
        return 1 - tree_distance(list(a), list(p), list(b), list(q)) / (len(a) + len(b))

    return pd.Series([one(*x) for x in zip(labels_a, parents_a, labels_b, parents_b)], dtype="float64")


def tree_of(rows: list[tuple]) -> tuple[list[str], list[int]]:
    """Labels and parents in post-order of a document's rows (root_kind, ord, last_ord, parent_ord, type, level, row_span,
    col_span): a node follows its subtree, of which it is the last by (last_ord, -ord). Further roots follow."""
    labels: list[str] = []
    parents: list[int] = []
    for _, own in groupby(rows, key=lambda r: r[0]):
        order = sorted(own, key=lambda r: (r[2], -r[1]))
        post = {r[1]: len(labels) + i for i, r in enumerate(order)}
        parents += [post.get(r[3], -1) for r in order]
        for _, _, _, _, type_, level, down, across in order:
            labels.append(f"heading:{'' if level is None else level}" if type_ == "heading" else f"tableCell:{1 if down is None else down}x{1 if across is None else across}" if type_ == "tableCell" else type_)
    return labels, parents


def post_order(nodes: DataFrame) -> DataFrame:
    """doc_id, labels, parents in post-order."""
    return per_document(nodes, lambda doc, rows: [(doc, *tree_of(rows))], "doc_id string, labels array<string>, parents array<int>", "last_ord", "parent_ord", "type", "level", "row_span", "col_span")


def structure_scores(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b of doc_id) with structural similarity."""
    t = post_order(nodes)
    side = lambda x: t.select(F.col("doc_id").alias(x), F.col("labels").alias(f"l{x}"), F.col("parents").alias(f"p{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", structural_similarity("la", "pa", "lb", "pb").alias("structural"))


def grid(cells: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Row and column of each cell (row, index, row span, column span) of a table, in order:
    positions that an earlier cell spans are passed over."""
    taken: set[tuple[int, int]] = set()
    out = []
    at, col = None, 0
    for row, _, down, across in sorted(cells):
        at, col = row, col if row == at else 0  # what is taken stays taken: a row is walked once
        while (row, col) in taken:
            col += 1
        out.append((row, col))
        taken |= {(row + i, col + j) for i in range(max(1, down)) for j in range(max(1, across))}
    return out


def _f1(expected: list, actual: list) -> float:
    """F1 of two bags, as bag_overlap gives it; two empty ones agree."""
    if expected == actual:
        return 1.0
    matched = (Counter(expected) & Counter(actual)).total()
    return 2.0 * matched / (len(expected) + len(actual))


def features(nodes: DataFrame) -> DataFrame:
    """doc_id and all that compare reads of a document, from one walk: labels and parents (post_order), text, cells and
    spans, each cell as 128 bits of its place, spans and text."""
    from . import tree

    def run(doc, rows):
        labels, parents = tree_of([(r[0], r[1], r[2], r[5], r[3], r[8], r[6], r[7]) for r in rows])
        cell = lambda c: "\u0001".join((*map(str, c[1:5]), re.sub(r"\s+", " ", c[5], flags=re.A).strip(" ")))
        cells = [hashlib.blake2b(cell(c).encode("utf-8", "surrogatepass"), digest_size=16).digest() for c in tree.cells_of(rows)]
        short = [r[:5] for r in rows]
        spans = [f"{mark}:{start}-{end}" for mark, start, end in tree.spans_of([r for r in short if r[0] == "body"])]
        return [(doc, labels, parents, tree._body_text(short), cells, spans)]

    schema = "doc_id string, labels array<string>, parents array<int>, text string, cells array<binary>, spans array<string>"
    return per_document(nodes, run, schema, "last_ord", "type", "value", "parent_ord", "row_span", "col_span", "level")


@F.pandas_udf(DoubleType())
def bag_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_f1(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


def table_scores(expected: DataFrame, actual: DataFrame, with_position: bool = True) -> DataFrame:
    """Precision, recall, F1 per pair_id over cells (pair_id, row, col, row_span, col_span, text), by place, span and
    text, or by text alone."""
    where = [F.col(c).cast("string") for c in ("row", "col", "row_span", "col_span")] if with_position else []
    key = F.concat_ws("\u0001", *where, F.trim(F.regexp_replace("text", r"\s+", " ")))
    key = F.unhex(F.md5(key))  # the texts themselves need not be shuffled
    return bag_overlap(expected.withColumn("k", key), actual.withColumn("k", key), ["pair_id"], "k")


def span_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Precision, recall, F1 per pair_id over inline marks (pair_id, mark, start, end)."""
    key = F.concat(F.col("mark"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return bag_overlap(expected.withColumn("k", key), actual.withColumn("k", key), ["pair_id"], "k")
