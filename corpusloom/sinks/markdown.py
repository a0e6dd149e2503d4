"""Node table to Markdown, in several flavours; what a flavour lacks takes a simpler form."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.nodes import BLOCK_TYPES, TREE, Node, body, per_document


@dataclass(frozen=True)
class Flavor:
    footnotes: bool = True
    math: bool = True
    admonitions: bool = True
    tables: str = "auto"  # auto: pipes where they can say it, else HTML; pipe; html
    front_matter: bool = True
    raw_html: bool = True


FLAVORS = {
    "default": Flavor(),
    "gfm": Flavor(),
    "commonmark": Flavor(footnotes=False, math=False, admonitions=False, tables="html", front_matter=False),
    "pandoc": Flavor(admonitions=False),
    "obsidian": Flavor(tables="pipe"),
    "mdx": Flavor(raw_html=False, tables="pipe"),
    "plain": Flavor(footnotes=False, math=False, admonitions=False, tables="pipe", front_matter=False, raw_html=False),
}
_MARKS = {"emphasis": ("*", "*"), "strong": ("**", "**"), "delete": ("~~", "~~")}
_TAGS = {"underline": "u", "subscript": "sub", "superscript": "sup", "highlight": "mark", "insertion": "ins", "deletion": "del", "smallCaps": "small"}


def expressible(table: Node) -> bool:
    """Whether a pipe table says all: no merged cells, no cell with more than one paragraph."""
    cells = [c for r in table.children for c in r.children]
    plain = all((c.row_span or 1) == 1 and (c.col_span or 1) == 1 for c in cells)
    return plain and bool(table.children) and all(len(c.children) <= 1 and all(b.type == "paragraph" and all(x.type != "break" for x in b.children) for b in c.children) for c in cells)


def escape(text: str) -> str:
    text = re.sub(r"([\\`*_\[\]<$|~])", r"\\\1", text)
    return re.sub(r"&(?=[A-Za-z#][A-Za-z0-9]*;)", r"\\&", text)


def _guard(line: str) -> str:
    """A line's start that would read as a block's."""
    if re.match(r"^(#{1,6}(\s|$)|>|[-+](\s|$)|=+\s*$|-+\s*$|:?-+:?\s*$)", line):
        return "\\" + line
    return re.sub(r"^(\d{1,9})([.)])(?=\s|$)", r"\1\\\2", line)


class Renderer:
    def __init__(self, flavor: Flavor = FLAVORS["default"]) -> None:
        self.f = flavor

    def document(self, root: Node) -> str:
        text = self.blocks(root.children)
        return text.rstrip("\n") + "\n" if text.strip() else ""

    def blocks(self, nodes: list[Node], tight: bool = False) -> str:
        parts, last = [], None
        for n in nodes:
            text = self.block(n, last)
            if text is not None:
                parts.append(text)
                last = n
        return ("\n" if tight else "\n\n").join(parts)

    def block(self, n: Node, last: Node | None = None) -> str | None:
        t = n.type
        if t == "paragraph":
            return "\n".join(_guard(x) for x in self.inline(n.children).split("\n")) or None
        if t == "heading":
            return f"{'#' * min(6, max(1, n.level or 1))} {self.inline(n.children).replace(chr(10), ' ')}".rstrip()
        if t == "thematicBreak":
            return "***" if last is not None and last.type == "paragraph" else "---" if last is not None else "***"
        if t == "code":
            mark = "`" * max(3, 1 + max((len(x) for x in re.findall(r"`+", n.value or "")), default=0))
            meta = f" {n.attrs['meta']}" if n.attrs.get("meta") else ""
            return f"{mark}{n.lang or ''}{meta}\n{n.value or ''}\n{mark}" if n.value else f"{mark}{n.lang or ''}{meta}\n{mark}"
        if t == "blockquote":
            return _prefixed(self.blocks(n.children), "> ")
        if t == "admonition":
            kind = n.attrs.get("kind", "note")
            head = f"[!{kind.upper()}]" if self.f.admonitions else f"**{kind.title()}**\n"
            return _prefixed(f"{head}\n{self.blocks(n.children)}".rstrip("\n"), "> ")
        if t == "list":
            return self.list(n, last)
        if t == "table":
            return self.table(n)
        if t in ("yaml", "toml"):
            mark = "---" if t == "yaml" else "+++"
            return f"{mark}\n{n.value}\n{mark}" if self.f.front_matter else None
        if t in ("math", "equationBlock"):
            return f"$$\n{n.value}\n$$" if self.f.math else f"```math\n{n.value}\n```"
        if t == "html":
            return n.value if self.f.raw_html else None
        if t == "definition":
            return f"[{n.attrs['label']}]: {n.attrs['url']}" + (f' "{n.attrs["title"]}"' if n.attrs.get("title") else "")
        if t == "footnoteDefinition":
            body = self.blocks(n.children)
            return f"[^{n.attrs['label']}]: " + body.replace("\n", "\n    ").replace("\n    \n", "\n\n") if self.f.footnotes else body
        if t == "descriptionTerm":
            return f"**{self.inline(n.children)}**"
        if t == "caption":
            return f"*{self.inline(n.children)}*"
        if t in ("pageBreak", "columnBreak"):
            return None
        if n.children and all(c.type not in BLOCK_TYPES for c in n.children):
            return self.inline(n.children) or None
        return self.blocks(n.children) or None

    def list(self, n: Node, last: Node | None) -> str:
        loose = n.attrs.get("spread") == "true" or any(len(i.children) > 1 and any(c.type != "list" for c in i.children[1:]) for i in n.children)
        other = last is not None and last.type == "list" and bool(last.ordered) == bool(n.ordered)
        number = int(n.attrs.get("start", "1"))
        parts = []
        for i, item in enumerate(n.children):
            mark = f"{number + i}{')' if other else '.'} " if n.ordered else "* " if other else "- "
            box = {"true": "[x] ", "false": "[ ] "}.get(item.attrs.get("checked", ""), "")
            body = self.blocks(item.children, tight=not loose)
            parts.append((mark + box + ("\n" + " " * len(mark)).join(body.split("\n"))).rstrip())
        return re.sub(r"\n[ ]+\n", "\n\n", ("\n\n" if loose else "\n").join(parts))

    def table(self, n: Node) -> str:
        if self.f.tables == "html" and self.f.raw_html or self.f.tables == "auto" and not expressible(n):
            from .html import Renderer as Html

            return Html().block(n)
        rows = [[self.inline([x for b in c.children for x in b.children]).replace("\n", " ") for c in r.children] for r in n.children]
        wide = max(map(len, rows), default=0)
        if not wide:
            return ""
        rows = [r + [""] * (wide - len(r)) for r in rows]
        align = (n.attrs.get("align", "").split(",") + [""] * wide)[:wide]
        rule = [{"left": ":--", "right": "--:", "center": ":-:"}.get(a, "---") for a in align]
        return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], rule, *rows[1:]])

    def inline(self, nodes: list[Node]) -> str:
        return "".join(map(self.phrase, nodes))

    def phrase(self, n: Node) -> str:
        t = n.type
        if t == "text":
            return escape(n.value or "")
        if t in _MARKS:
            body = self.inline(n.children)
            core = body.strip()
            if not core:
                return body
            lead, trail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
            return f"{lead}{_MARKS[t][0]}{core}{_MARKS[t][1]}{trail}"
        if t == "inlineCode":
            value = n.value or ""
            mark = "`" * (1 + max((len(x) for x in re.findall(r"`+", value)), default=0))
            pad = " " if value[:1] == "`" or value[-1:] == "`" or value[:1] == value[-1:] == " " and value.strip() else ""
            return f"{mark}{pad}{value}{pad}{mark}"
        if t == "break":
            return "\\\n"
        if t == "link":
            title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
            url = n.attrs.get("url", "")
            return f"[{self.inline(n.children)}]({f'<{url}>' if re.search(r'[ ()]', url) else url}{title})"
        if t == "crossReference":
            return f"[{self.inline(n.children)}](#{n.attrs.get('target', '')})"
        if t == "image":
            title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
            return f"![{n.attrs.get('alt', '')}]({n.attrs.get('url', '')}{title})"
        if t == "linkReference":
            return f"[{self.inline(n.children)}][{n.attrs['label']}]"
        if t == "imageReference":
            return f"![{n.attrs.get('alt', '')}][{n.attrs['label']}]"
        if t == "footnoteReference":
            return f"[^{n.attrs['label']}]" if self.f.footnotes else f"\\[{n.attrs['label']}\\]"
        if t == "inlineMath":
            return f"${n.value}$" if self.f.math else f"`{n.value}`"
        if t == "html":
            return (n.value or "") if self.f.raw_html else ""
        if t in _TAGS:
            return f"<{_TAGS[t]}>{self.inline(n.children)}</{_TAGS[t]}>" if self.f.raw_html else self.inline(n.children)
        if t == "comment":
            return ""
        return self.inline(n.children) if n.children else escape(n.value or "")


def _prefixed(text: str, mark: str) -> str:
    return "\n".join((mark + x).rstrip() for x in text.split("\n"))


def render(nodes: DataFrame, flavor: str = "default", renderer=None) -> DataFrame:
    """doc_id, rendered of every document of a node table."""
    settings = FLAVORS[flavor]

    def run(doc, rows):
        r = renderer() if renderer else Renderer(settings)
        return [(doc, r.document(body(rows)))]

    return per_document(nodes, run, "doc_id string, rendered string", *TREE)


def format_text(text: str, flavor: str = "default") -> str:
    """Markdown in, Markdown out; a fixed point of itself."""
    from ..sources.markdown import parse

    return Renderer(FLAVORS[flavor]).document(parse(text))
