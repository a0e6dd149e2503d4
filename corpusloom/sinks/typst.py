"""Node table to Typst source, for a typesetter outside the engine, with what it cannot say."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.nodes import Node, tree

_MARKS = {"emphasis": "emph", "strong": "strong", "delete": "strike", "underline": "underline", "subscript": "sub", "superscript": "super", "smallCaps": "smallcaps", "highlight": "highlight", "insertion": "underline", "deletion": "strike"}


def escape(s: str) -> str:
    return re.sub(r"([\\#*_`$<>@=\[\]~/+-])", r"\\\1", s)


def string(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


class Renderer:
    def __init__(self) -> None:
        self.lost: list[str] = []

    def blocks(self, nodes: list[Node]) -> str:
        return "\n\n".join(x for x in map(self.block, nodes) if x)

    def block(self, n: Node) -> str:
        t = n.type
        if t in ("paragraph", "caption", "descriptionTerm"):
            return self.inline(n.children)
        if t == "heading":
            return f"{'=' * (n.level or 1)} {self.inline(n.children)}"
        if t == "list":
            mark = "+" if n.ordered else "-"
            return "\n".join(f"{mark} " + self.blocks(i.children).replace("\n", "\n  ") for i in n.children)
        if t == "code":
            return f"#raw({string(n.value or '')}, block: true{f', lang: {string(n.lang)}' if n.lang else ''})"
        if t in ("blockquote", "admonition"):
            return f"#quote(block: true)[\n{self.blocks(n.children)}\n]"
        if t == "thematicBreak":
            return "#line(length: 100%)"
        if t == "pageBreak":
            return "#pagebreak()"
        if t == "table":
            wide = max((sum(c.col_span or 1 for c in r.children) for r in n.children), default=1)
            cells = []
            for c in (c for r in n.children for c in r.children):
                spans = "".join(f"{k}: {v}, " for k, v in (("rowspan", c.row_span), ("colspan", c.col_span)) if v and v > 1)
                cells.append(f"table.cell({spans.rstrip(', ')})[{self.blocks(c.children)}]" if spans else f"[{self.blocks(c.children)}]")
            return f"#table(columns: {wide}, " + ", ".join(cells) + ")"
        if t in ("yaml", "toml", "definition"):
            return ""
        if t in ("html", "unknown", "math", "equationBlock", "footnoteDefinition"):
            self.lost.append(t)
            return escape(n.value or "") if t in ("math", "equationBlock") else self.blocks(n.children)
        return self.blocks(n.children)

    def inline(self, nodes: list[Node]) -> str:
        return "".join(map(self.phrase, nodes))

    def phrase(self, n: Node) -> str:
        t = n.type
        if t == "text":
            return escape(n.value or "")
        if t in _MARKS:
            return f"#{_MARKS[t]}[{self.inline(n.children)}]"
        if t == "inlineCode":
            return f"#raw({string(n.value or '')})"
        if t == "break":
            return " \\\n"
        if t == "link":
            return f"#link({string(n.attrs.get('url', ''))})[{self.inline(n.children)}]"
        if t in ("image", "inlineMath", "footnoteReference", "comment", "html"):
            self.lost.append(t)
            return escape(n.attrs.get("alt") or (n.value or "" if t == "inlineMath" else ""))
        return self.inline(n.children)


def render(nodes: DataFrame) -> DataFrame:
    """doc_id, rendered, lost (types that the source cannot carry)."""

    def run(key, group):
        r = Renderer()
        text = r.blocks(tree([x for x in group.to_pylist() if x["root_kind"] == "body"]).children)
        return pa.table({"doc_id": [key[0].as_py()], "rendered": [text + "\n" if text else ""], "lost": pa.array([sorted(set(r.lost))], pa.list_(pa.string()))})

    return nodes.groupBy("doc_id").applyInArrow(run, "doc_id string, rendered string, lost array<string>")
