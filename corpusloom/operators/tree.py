"""The node table as a tree: subtrees by interval, traversal order by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.nodes import BLOCK_TYPES, per_document

#: Which children each container may have; any block where a parent is not listed.
CONTENT = {
    "list": ("listItem",), "table": ("tableRow",), "tableRow": ("tableCell",), "descriptionList": ("descriptionTerm", "descriptionDetails"),
}


def select_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def subtrees(nodes: DataFrame, is_root: Column, include_root: bool = True) -> DataFrame:
    """Nodes within the subtrees of the marked ones. Subtrees nest, so that a node is inside one
    exactly if the furthest end of the marked nodes before it reaches it: one window, no self-join."""
    w = Window.partitionBy("doc_id", "root_kind").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0 if include_root else -1)
    reach = F.max(F.when(is_root, F.col("last_ord"))).over(w)
    return nodes.withColumn("reach", reach).where(F.col("ord") <= F.col("reach")).drop("reach")


def without_subtrees(nodes: DataFrame, is_root: Column) -> DataFrame:
    """Traversal that skips the marked subtrees. ord keeps its gaps; see renumber."""
    w = Window.partitionBy("doc_id", "root_kind").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(is_root, F.col("last_ord"))).over(w)
    return nodes.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("ord") > F.col("reach"))).drop("reach")


def until(nodes: DataFrame, stop: Column) -> DataFrame:
    """Traversal that stops at the first marked node, that one included."""
    w = Window.partitionBy("doc_id", "root_kind").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("over", F.coalesce(F.max(stop.cast("int")).over(w), F.lit(0))).where("over = 0").drop("over")


def find(nodes: DataFrame, wanted: Column) -> DataFrame:
    """The first wanted node of each document."""
    w = Window.partitionBy("doc_id").orderBy("root_kind", "ord")
    return nodes.where(wanted).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def renumber(nodes: DataFrame) -> DataFrame:
    """Dense ord, last_ord, parent_ord and child_index after nodes were dropped."""
    by = ["doc_id", "root_kind"]
    w = Window.partitionBy(*by).orderBy("ord")
    now = nodes.withColumn("new", F.row_number().over(w) - 1)
    places = now.select(*by, F.col("ord").alias("parent_ord"), F.col("new").alias("new_parent"))
    joined = now.join(places, [*by, "parent_ord"], "left")
    below = now.select(*by, F.col("ord").alias("o"), F.col("new").alias("n"))
    ends = joined.join(below, by).where((F.col("o") >= F.col("ord")) & (F.col("o") <= F.col("last_ord"))).groupBy(*by, "ord").agg(F.max("n").alias("new_last"))
    out = joined.join(ends, [*by, "ord"])
    index = F.row_number().over(Window.partitionBy(*by, "new_parent").orderBy("new")) - 1
    return out.withColumn("child_index", index.cast("int")).withColumn("ord", F.col("new").cast("int")).withColumn("last_ord", F.col("new_last").cast("int")).withColumn("parent_ord", F.coalesce("new_parent", F.lit(-1)).cast("int")).select(nodes.columns)


def _body_text(rows: list[tuple]) -> str:
    """Text of a document's rows (root_kind, ord, last_ord, type, value)."""
    parts: dict[tuple, list[str]] = {}
    kind = owner = closed = None
    for root_kind, at, last, type_, value in rows:
        if root_kind != kind:
            kind, owner, closed = root_kind, None, -1
        # A new part starts at each block, and after a block's subtree has ended.
        if type_ in _TEXT_BLOCKS:
            owner = at
            if type_ in _CLOSING:
                closed = max(closed, last)
        if type_ in ("text", "inlineCode", "code", "break"):
            parts.setdefault((kind, owner, at <= closed), []).append("\n" if type_ == "break" else value or "")
    joined = ((k[0], "".join(v)) for k, v in parts.items())
    return "\n\n".join(p for _, p in sorted(((k, p) for k, p in joined if p), key=lambda x: x[0]))


_TEXT_BLOCKS = frozenset(BLOCK_TYPES) - {"html"}
_CLOSING = frozenset(("paragraph", "heading", "code", "caption", "descriptionTerm"))


def text_content(nodes: DataFrame) -> DataFrame:
    """doc_id, text: inline text in order, blocks apart by a blank line; html and math are no text."""
    return per_document(nodes, lambda doc, rows: [(doc, text)] if (text := _body_text(rows)) else [], "doc_id string, text string", "last_ord", "type", "value")


def body_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, n_blocks, text: text_content of the body and its number of paragraphs and headings."""

    def run(doc, rows):
        own = [r for r in rows if r[0] == "body"]
        n, text = sum(r[3] in ("paragraph", "heading") for r in own), _body_text(own)
        return [(doc, n, text)] if n and text else []

    return per_document(nodes, run, "doc_id string, n_blocks long, text string", "last_ord", "type", "value")


def _held(rows: list[tuple], heads: frozenset, pieces: frozenset) -> list[tuple[tuple, list[str]]]:
    """The rows of heads' types, each with the pieces of its subtree, in one walk: rows begin root_kind, ord,
    last_ord, type, value; they come in order."""
    out: list[tuple[tuple, list[str]]] = []
    texts: list[str] = []
    open_: list[tuple[int, int, int]] = []  # last_ord, place in out, number of pieces before

    def close(until: tuple | None) -> None:
        while open_ and (until is None or open_[-1][0] < until[1]):
            _, i, n = open_.pop()
            out[i] = (out[i][0], texts[n:])
        if not open_:
            texts.clear()

    kind = None
    for r in rows:
        close(None if r[0] != kind else r)
        kind = r[0]
        if r[3] in heads:
            open_.append((r[2], len(out), len(texts)))
            out.append((r, []))
        if open_ and r[3] in pieces:
            texts.append("\n" if r[3] == "break" else r[4] or "")
    close(None)
    return out


def blocks_in_order(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, type, text, lang of headings, paragraphs, list items and code, in order. The text is
    the subtree's inline text; a list item's own paragraph comes again as a paragraph."""
    heads, pieces = frozenset(("heading", "paragraph", "listItem", "code")), frozenset(("text", "inlineCode", "break", "code"))

    def run(doc, rows):
        found = _held([r for r in rows if r[0] == "body"], heads, pieces)
        return [(doc, r[1], r[3], r[5], r[6], "".join(own)) for r, own in found if own]

    return per_document(nodes, run, "doc_id string, ord int, type string, lang string, level int, text string", "last_ord", "type", "value", "lang", "level")


def misplaced(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, parent_type, type of children that their parent may not have."""
    parent = nodes.select("doc_id", "root_kind", F.col("ord").alias("parent_ord"), F.col("type").alias("parent_type"))
    pairs = nodes.join(parent, ["doc_id", "root_kind", "parent_ord"])
    block = F.col("type").isin(*BLOCK_TYPES)
    bad = F.lit(False)
    for p, allowed in CONTENT.items():
        bad = bad | ((F.col("parent_type") == p) & ~F.col("type").isin(*allowed))
    bad = bad | (F.col("parent_type").isin("paragraph", "heading") & block & ~F.col("type").isin("unknown", "html"))
    bad = bad | (F.col("type").isin("listItem") & (F.col("parent_type") != "list")) | (F.col("type").isin("tableRow") & (F.col("parent_type") != "table"))
    return pairs.where(bad).select("doc_id", "ord", "parent_type", "type")


def audit(nodes: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """check, n: rows that break an invariant: ids unique, intervals nested, unknowns diagnosed."""
    ids = nodes.groupBy("doc_id", "node_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated node id").alias("check"), "n")
    parent = nodes.select("doc_id", "root_kind", F.col("ord").alias("parent_ord"), F.col("last_ord").alias("parent_last"))
    nest = nodes.join(parent, ["doc_id", "root_kind", "parent_ord"]).where((F.col("ord") <= F.col("parent_ord")) | (F.col("last_ord") > F.col("parent_last"))).agg(F.count("*").alias("n")).select(F.lit("not nested").alias("check"), "n")
    out = ids.unionByName(nest).unionByName(misplaced(nodes).agg(F.count("*").alias("n")).select(F.lit("misplaced child").alias("check"), "n"))
    if diagnostics is not None:
        silent = nodes.where("type = 'unknown'").join(diagnostics.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
        out = out.unionByName(silent.agg(F.count("*").alias("n")).select(F.lit("unknown without diagnostic").alias("check"), "n"))
    return out


_MARK_TYPES = frozenset("emphasis strong delete underline subscript superscript inlineCode link smallCaps highlight".split())


def spans_of(rows: list[tuple]) -> list[tuple[str, int, int]]:
    """mark, start, end of a body's rows (root_kind, ord, last_ord, type, value)."""
    at, after, marks = 0, {}, []
    for _, ord_, last, type_, value in rows:
        if type_ in _MARK_TYPES:
            marks.append((type_, at, last))
        if type_ in ("text", "inlineCode", "code"):
            at += len(value or "")
        after[ord_] = at
    return [(mark, start, after[last]) for mark, start, last in marks if last in after]


def inline_spans(nodes: DataFrame) -> DataFrame:
    """doc_id, mark, start, end: inline marks as ranges of the document's running text."""
    run = lambda doc, rows: [(doc, *s) for s in spans_of([r for r in rows if r[0] == "body"])]
    return per_document(nodes, run, "doc_id string, mark string, start long, end long", "last_ord", "type", "value")


def cells_of(rows: list[tuple]) -> list[tuple]:
    """table_ord, row, col, row_span, col_span, text of the cells of a document's rows (root_kind, ord, last_ord, type,
    value, parent_ord, row_span, col_span)."""
    from .fidelity import grid

    own_table = {(r[0], r[1]): (r[0], r[5]) for r in rows if r[3] == "tableRow"}
    tables: dict[tuple, list] = {(r[0], r[1]): [] for r in rows if r[3] == "table"}
    for r, own in _held(rows, frozenset(("tableCell",)), frozenset(("text", "inlineCode", "code"))):
        table = own_table.get((r[0], r[5]))
        if table in tables:
            tables[table].append((r[5], r[6] or 1, r[7] or 1, "".join(own)))
    out = []
    for (_, table), cells in tables.items():
        order = {o: i for i, o in enumerate(sorted({c[0] for c in cells}))}
        spans = [(order[o], i, down, across) for i, (o, down, across, _) in enumerate(cells)]
        out += [(table, row, col, s[2], s[3], c[3]) for (row, col), s, c in zip(grid(spans), spans, cells)]
    return out


def table_cells(nodes: DataFrame) -> DataFrame:
    """doc_id, table_ord, row, col, row_span, col_span, text of every cell, on the grid that spans leave."""
    schema = "doc_id string, table_ord int, row int, col int, row_span int, col_span int, text string"
    return per_document(nodes, lambda doc, rows: [(doc, *c) for c in cells_of(rows)], schema, "last_ord", "type", "value", "parent_ord", "row_span", "col_span")
