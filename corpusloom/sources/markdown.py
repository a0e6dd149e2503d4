"""Markdown: CommonMark's common ground with tables, task lists, strike-through, footnotes, front
matter, dollar math and call-outs, to the node table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html as H
from .nodes import Node, read

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_QUOTE = re.compile(r"^ {0,3}> ?(.*)$")
_CALLOUT = re.compile(r"^\[!(\w+)\][ \t]*(.*)$")
_DELIMITERS = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_NOTE = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]^][^\]]*)\]:[ \t]*(\S+)(?:[ \t]+[\"'(](.*)[\"')])?[ \t]*$")
_HTML = re.compile(r"^ {0,3}<(/?[A-Za-z][A-Za-z0-9-]*|!--)")
#: Without any of these there is nothing but text, as every token starts with one or is a hard break.
_SIGN = re.compile(r"[\\`$\[<&*_~]|  \n")
_STRUCTURE = "blockquote dl figure ol table ul".split()


def parse(text: str) -> Node:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    root = Node("root")
    if lines and lines[0] in ("---", "+++"):
        end = next((i for i in range(1, len(lines)) if lines[i] == lines[0]), 0)
        if end:
            root.children.append(Node("yaml" if lines[0] == "---" else "toml", value="\n".join(lines[1:end])))
            lines = lines[end + 1 :]
    root.children += _blocks(lines)
    return root


def _interrupts(line: str) -> bool:
    if line[:1].isalpha():
        return False
    item = _ITEM.match(line)
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or item and item.group(4) and item.group(2) in ("-", "*", "+", "1.", "1)"))


def _blocks(lines: list[str]) -> list[Node]:
    out: list[Node] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if line[0].isalpha() and "|" not in line:  # what most lines are
            node, i = _paragraph(lines, i)
            out.append(node)
        elif m := _FENCE.match(line):
            mark, info = m.groups()
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[j])), len(lines))
            lang, _, meta = info.strip().partition(" ")
            out.append(Node("code", value="\n".join(lines[i + 1 : end]), lang=lang or None, attrs={"meta": meta} if meta else {}))
            i = end + 1
        elif line.strip() == "$$":
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() == "$$"), len(lines))
            out.append(Node("math", value="\n".join(lines[i + 1 : end])))
            i = end + 1
        elif m := _HEADING.match(line):
            out.append(Node("heading", inline(m.group(2) or ""), level=len(m.group(1))))
            i += 1
        elif _RULE.match(line):
            out.append(Node("thematicBreak"))
            i += 1
        elif _QUOTE.match(line):
            own = []
            while i < len(lines) and (m := _QUOTE.match(lines[i])) or i < len(lines) and own and own[-1].strip() and lines[i].strip() and not _interrupts(lines[i]):
                own.append(m.group(1) if m else lines[i])
                i += 1
            call = _CALLOUT.match(own[0])
            if call:
                out.append(Node("admonition", _blocks([call.group(2), *own[1:]]), attrs={"kind": call.group(1).lower()}))
            else:
                out.append(Node("blockquote", _blocks(own)))
        elif _ITEM.match(line):
            node, i = _list(lines, i)
            out.append(node)
        elif line.startswith("    "):
            end = i
            while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                end += 1
            out.append(Node("code", value="\n".join(x[4:] for x in lines[i:end]).rstrip("\n")))
            i = end
        elif m := _NOTE.match(line):
            own = [m.group(2)]
            i += 1
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip() and i + 1 < len(lines) and lines[i + 1].startswith("    ")):
                own.append(lines[i][4:])
                i += 1
            out.append(Node("footnoteDefinition", _blocks(own), attrs={"label": m.group(1)}))
        elif m := _DEFINITION.match(line):
            out.append(Node("definition", attrs={"label": m.group(1).lower(), "url": m.group(2).strip("<>")} | ({"title": m.group(3)} if m.group(3) else {})))
            i += 1
        elif "|" in line and i + 1 < len(lines) and _DELIMITERS.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            node, i = _table(lines, i)
            out.append(node)
        elif _HTML.match(line):
            end = i
            while end < len(lines) and lines[end].strip():
                end += 1
            raw = "\n".join(lines[i:end])
            tag = re.match(r"\s*<([A-Za-z]+)", raw)
            if tag and tag.group(1).lower() in _STRUCTURE and raw.lower().count(f"<{tag.group(1).lower()}") == raw.lower().count(f"</{tag.group(1).lower()}"):
                out += H.parse(raw).children
            else:
                out.append(Node("html", value=raw))
            i = end
        else:
            node, i = _paragraph(lines, i)
            out.append(node)
    return out


def _paragraph(lines: list[str], i: int) -> tuple[Node, int]:
    """A paragraph, or a heading if it is underlined."""
    own = [lines[i].strip()]
    i += 1
    level = 0
    while i < len(lines) and lines[i].strip() and not level:
        if re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[i]):
            level = 1 if "=" in lines[i] else 2
        elif _interrupts(lines[i]):
            break
        else:
            own.append(lines[i].lstrip())
        i += 1
    body = inline("\n".join(own).rstrip())
    return (Node("heading", body, level=level) if level else Node("paragraph", body)), i


def _list(lines: list[str], i: int) -> tuple[Node, int]:
    first = _ITEM.match(lines[i])
    kind = first.group(2)[-1]
    ordered = kind in ".)"
    items: list[Node] = []
    loose = False
    while i < len(lines) and (m := _ITEM.match(lines[i])) and m.group(2)[-1] == kind and not _RULE.match(lines[i]):
        pad = len(m.group(1)) + len(m.group(2)) + (len(m.group(3)) if m.group(3) and len(m.group(3)) < 5 else 1)
        own = [m.group(4) or ""]
        i += 1
        blank = False
        while i < len(lines):
            if not lines[i].strip():
                blank = True
                own.append("")
            elif lines[i].startswith(" " * pad):
                loose |= blank and not lines[i][pad:].startswith((" ", "-", "*", "+"))
                own.append(lines[i][pad:])
                blank = False
            elif not blank and own[-1].strip() and not _interrupts(lines[i]) and not _ITEM.match(lines[i]):
                own.append(lines[i].strip())
            else:
                break
            i += 1
        loose |= blank and i < len(lines) and bool(_ITEM.match(lines[i])) and _ITEM.match(lines[i]).group(2)[-1] == kind
        attrs = {}
        if task := re.match(r"^\[([ xX])\][ \t]+(.*)$", own[0]):
            attrs, own[0] = {"checked": str(task.group(1) != " ").lower()}, task.group(2)
        while own and not own[-1].strip():
            own.pop()
        items.append(Node("listItem", _blocks(own), attrs=attrs))
    start = first.group(2)[:-1]
    attrs = {"start": str(int(start))} if ordered and int(start) != 1 else {}
    if loose:
        attrs["spread"] = "true"
    return Node("list", items, ordered=ordered, attrs=attrs), i


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _table(lines: list[str], i: int) -> tuple[Node, int]:
    head, marks = _cells(lines[i]), _cells(lines[i + 1])
    align = ",".join("center" if m[:1] == ":" and m[-1:] == ":" else "left" if m[:1] == ":" else "right" if m[-1:] == ":" else "" for m in marks)
    row = lambda cells, header: Node("tableRow", [Node("tableCell", [Node("paragraph", inline(c))] if c else [], row_span=1, col_span=1, attrs={"header": "true"} if header else {}) for c in cells])
    rows = [row(head, True)]
    i += 2
    while i < len(lines) and lines[i].strip() and not _interrupts(lines[i]):
        cells = _cells(lines[i])
        rows.append(row((cells + [""] * len(head))[: len(head)], False))
        i += 1
    return Node("table", rows, attrs={"headerRows": "1"} | ({"align": align} if align.strip(",") else {})), i


_TOKEN = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)\n)|(?P<code>(?P<ticks>`+)(?!`)(?P<body>.+?)(?<!`)(?P=ticks)(?!`))|(?P<math>(?<![\\$])\$(?![\s$])(?P<tex>[^$\n]+?)(?<![\s\\])\$(?![$\d]))"
    r"|(?P<note>\[\^(?P<label>[^\]\s]+)\])|(?P<open>!?\[)|(?P<auto><(?P<url>[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*)>)|(?P<raw></?[A-Za-z][^<>]*>|<!--.*?-->)"
    r"|(?P<entity>&(?:[A-Za-z][A-Za-z0-9]*|\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6});)|(?P<run>\*+|_+|~~)",
    re.S,
)


def inline(text: str) -> list[Node]:
    """Phrasing content: code first, then links from the inside out, then emphasis by the flanking rules."""
    if not _SIGN.search(text):
        return [Node("text", value=text)] if text else []
    out: list = []  # nodes, and delimiter runs as [sign, count, can open, can close]
    at = 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        if not m:
            break
        if m.start() > at:
            out.append(Node("text", value=text[at : m.start()]))
        at = m.end()
        if m["escape"]:
            out.append(Node("text", value=m["escape"][1]))
        elif m["hard"]:
            out.append(Node("break"))
        elif m["code"]:
            body = m["body"].replace("\n", " ")
            out.append(Node("inlineCode", value=body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body))
        elif m["math"]:
            out.append(Node("inlineMath", value=m["tex"]))
        elif m["note"]:
            out.append(Node("footnoteReference", attrs={"label": m["label"]}))
        elif m["open"]:
            node, at = _link(text, m.start(), m["open"] == "![")
            out.append(node)
        elif m["auto"]:
            out.append(Node("link", [Node("text", value=m["url"])], attrs={"url": m["url"]}))
        elif m["raw"]:
            out.append(Node("html", value=m["raw"]))
        elif m["entity"]:
            import html

            out.append(Node("text", value=html.unescape(m["entity"])))
        else:
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            punct = lambda c: not c.isalnum() and not c.isspace()
            left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
            right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
            word = m["run"][0] == "_"
            out.append([m["run"][0], len(m["run"]), left and (not word or not right or punct(before)), right and (not word or not left or punct(after))])
    if at < len(text):
        out.append(Node("text", value=text[at:]))
    return _merged(_emphasis(out))


def _link(text: str, at: int, image: bool) -> tuple[Node, int]:
    start = at + (2 if image else 1)
    depth, end = 1, start
    while end < len(text) and depth:
        c = text[end]
        depth += (c == "[") - (c == "]")
        end += 2 if c == "\\" else 1
    if depth:
        return Node("text", value=text[at:start]), start
    label = text[start : end - 1]
    if m := re.compile(r"\(\s*(<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)").match(text, end):
        attrs = {"url": m.group(1).strip("<>")} | ({"title": m.group(2)[1:-1]} if m.group(2) else {})
        if image:
            return Node("image", attrs=attrs | {"alt": label}), m.end()
        if attrs["url"].startswith("#"):
            return Node("crossReference", inline(label), attrs={"target": attrs["url"][1:]}), m.end()
        return Node("link", inline(label), attrs=attrs), m.end()
    if m := re.compile(r"\[([^\]]*)\]").match(text, end):
        attrs = {"label": (m.group(1) or label).lower()}
        return (Node("imageReference", attrs=attrs | {"alt": label}) if image else Node("linkReference", inline(label), attrs=attrs)), m.end()
    return Node("text", value=text[at:start]), start


def _emphasis(items: list) -> list[Node]:
    i = 0
    while i < len(items):
        c = items[i]
        if isinstance(c, list) and c[3]:
            for j in range(i - 1, -1, -1):
                o = items[j]
                if isinstance(o, list) and o[0] == c[0] and o[2] and o[1] and not ((o[3] or c[2]) and (o[1] + c[1]) % 3 == 0 and (o[1] % 3 or c[1] % 3)) and (c[0] != "~" or o[1] == c[1] == 2):
                    n = 2 if min(o[1], c[1]) >= 2 else 1
                    kind = "delete" if c[0] == "~" else "strong" if n == 2 else "emphasis"
                    node = Node(kind, _merged([_plain(x) for x in items[j + 1 : i]]))
                    o[1] -= n
                    c[1] -= n
                    items[j + 1 : i] = [node]
                    i = j + 2
                    if not o[1]:
                        del items[j]
                        i -= 1
                    if not c[1]:
                        del items[i]
                        i -= 1
                    else:
                        i -= 1
                    break
        i += 1
    return [_plain(x) for x in items]


def _plain(x) -> Node:
    return Node("text", value=x[0] * x[1]) if isinstance(x, list) else x


def _merged(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for n in nodes:
        if n.type == "text" and out and out[-1].type == "text":
            out[-1] = Node("text", value=(out[-1].value or "") + (n.value or ""))
        elif n.type != "text" or n.value:
            out.append(n)
    return out


def read_markdown(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The node table of all documents."""
    return read(docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(column).cast("string")), parse)
