"""Node table to HTML, a fragment or a whole document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators.slugs import next_slug
from ..sources.nodes import Node

_MARKS = {"emphasis": "em", "strong": "strong", "delete": "s", "underline": "u", "subscript": "sub", "superscript": "sup", "highlight": "mark", "insertion": "ins", "deletion": "del", "smallCaps": "small"}


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def slug(text: str) -> str:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.sub(r"[\s-]+", "-", re.sub(r"[^\w\s-]+", "", plain).strip()) or "section"


class Renderer:
    def __init__(self, whole: bool = False, style: str = "") -> None:
        self.whole, self.style, self.used = whole, style, set()

    def document(self, root: Node) -> str:
        body = self.blocks(root.children)
        if not self.whole:
            return body + "\n" if body else ""
        title = next((n.text() for n in root.children if n.type == "heading"), "")
        style = f"<style>{self.style}</style>" if self.style else ""
        return f'<!DOCTYPE html>\n<html>\n<head><title>{escape(title)}</title><meta charset="utf-8">{style}</head>\n<body>\n{body}\n</body>\n</html>\n'

    def blocks(self, nodes: list[Node]) -> str:
        return "\n".join(x for x in map(self.block, nodes) if x)

    def block(self, n: Node) -> str:
        t = n.type
        if t == "paragraph":
            return f"<p>{self.inline(n.children)}</p>"
        if t == "heading":
            level = min(6, max(1, n.level or 1))
            return f'<h{level} id="{next_slug(slug(n.text()), self.used)}">{self.inline(n.children)}</h{level}>'
        if t == "blockquote":
            return f"<blockquote>\n{self.blocks(n.children)}\n</blockquote>"
        if t == "admonition":
            return f'<div class="admonition {escape(n.attrs.get("kind", "note"))}">\n{self.blocks(n.children)}\n</div>'
        if t == "list":
            start = f' start="{n.attrs["start"]}"' if n.attrs.get("start") else ""
            tag = "ol" if n.ordered else "ul"
            tight = n.attrs.get("spread") != "true"
            items = "\n".join(f"<li>{self._box(i)}{self._item(i.children, tight)}</li>" for i in n.children)
            return f"<{tag}{start}>\n{items}\n</{tag}>"
        if t == "code":
            kind = f' class="language-{escape(n.lang)}"' if n.lang else ""
            return f"<pre><code{kind}>{escape(n.value or '')}\n</code></pre>"
        if t == "thematicBreak":
            return "<hr>"
        if t == "table":
            return self.table(n)
        if t == "figure":
            return f"<figure>\n{self.blocks(n.children)}\n</figure>"
        if t == "caption":
            return f"<figcaption>{self.inline(n.children)}</figcaption>"
        if t == "descriptionList":
            return f"<dl>\n{self.blocks(n.children)}\n</dl>"
        if t == "descriptionTerm":
            return f"<dt>{self.inline(n.children)}</dt>"
        if t == "descriptionDetails":
            return f"<dd>{self._item(n.children, True)}</dd>"
        if t in ("math", "equationBlock"):
            return f'<div class="math">{escape(n.value or "")}</div>'
        if t == "html":
            return n.value or ""
        if t == "footnoteDefinition":
            label = escape(n.attrs.get("label", ""))
            return f'<aside class="footnote" id="fn-{label}">\n{self.blocks(n.children)}\n</aside>'
        if t in ("yaml", "toml", "definition", "pageBreak", "columnBreak"):
            return ""
        if n.children and all(c.type in ("text", "break", *_MARKS, "link", "inlineCode") for c in n.children):
            return f"<p>{self.inline(n.children)}</p>"
        return self.blocks(n.children)

    def _box(self, item: Node) -> str:
        state = item.attrs.get("checked")
        return "" if state is None else f'<input type="checkbox" disabled{" checked" if state == "true" else ""}> '

    def _item(self, nodes: list[Node], tight: bool) -> str:
        parts = [self.inline(n.children) if tight and n.type == "paragraph" else self.block(n) for n in nodes]
        return "\n".join(p for p in parts if p)

    def table(self, n: Node) -> str:
        heads = int(n.attrs.get("headerRows", "0") or 0)

        def row(r: Node) -> str:
            cells = []
            for c in r.children:
                tag = "th" if c.attrs.get("header") == "true" else "td"
                spans = "".join(f' {name}="{v}"' for name, v in (("rowspan", c.row_span), ("colspan", c.col_span)) if v and v > 1)
                cells.append(f"<{tag}{spans}>{self._item(c.children, len(c.children) == 1)}</{tag}>")
            return f"<tr>{''.join(cells)}</tr>"

        part = lambda tag, rows: f"<{tag}>\n" + "\n".join(map(row, rows)) + f"\n</{tag}>" if rows else ""
        return "\n".join(x for x in ("<table>", part("thead", n.children[:heads]), part("tbody", n.children[heads:]), "</table>") if x)

    def inline(self, nodes: list[Node]) -> str:
        return "".join(map(self.phrase, nodes))

    def phrase(self, n: Node) -> str:
        t = n.type
        if t == "text":
            return escape(n.value or "")
        if t in _MARKS:
            return f"<{_MARKS[t]}>{self.inline(n.children)}</{_MARKS[t]}>"
        if t == "inlineCode":
            return f"<code>{escape(n.value or '')}</code>"
        if t == "break":
            return "<br>"
        if t == "link":
            title = f' title="{escape(n.attrs["title"])}"' if n.attrs.get("title") else ""
            return f'<a href="{escape(n.attrs.get("url", ""))}"{title}>{self.inline(n.children)}</a>'
        if t == "crossReference":
            return f'<a href="#{escape(n.attrs.get("target", ""))}">{self.inline(n.children)}</a>'
        if t == "image":
            return f'<img src="{escape(n.attrs.get("url", ""))}" alt="{escape(n.attrs.get("alt", ""))}">'
        if t == "footnoteReference":
            label = escape(n.attrs.get("label", ""))
            return f'<sup><a href="#fn-{label}">{label}</a></sup>'
        if t == "inlineMath":
            return f'<span class="math">{escape(n.value or "")}</span>'
        if t == "html":
            return n.value or ""
        if t == "comment":
            return f"<!-- {escape(n.text())} -->"
        return self.inline(n.children) if n.children else escape(n.value or "")


def render(nodes: DataFrame, whole: bool = False) -> DataFrame:
    from . import markdown

    return markdown.render(nodes, renderer=lambda: Renderer(whole))
