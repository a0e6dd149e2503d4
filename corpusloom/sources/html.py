"""HTML: by regular expressions what they can give, by a forgiving tree parser the rest."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .nodes import BLOCK_TYPES, Node, read

_DROPPED = set("base head link meta noscript script style template title".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HOIST = set("address article aside body button center colgroup div font footer form header html label main nav section small span tbody tfoot thead time".split())
_MARKS = {"b": "strong", "strong": "strong", "i": "emphasis", "em": "emphasis", "cite": "emphasis", "u": "underline", "ins": "insertion", "s": "delete", "del": "delete", "strike": "delete", "sub": "subscript", "sup": "superscript", "mark": "highlight"}
_BLOCKS = {"p": "paragraph", "blockquote": "blockquote", "li": "listItem", "dl": "descriptionList", "dt": "descriptionTerm", "dd": "descriptionDetails", "figure": "figure", "figcaption": "caption"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ENDS_P = set("article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "euro": "€", "deg": "°", "times": "×", "laquo": "«", "raquo": "»", "shy": "­"}


def tags(pages: DataFrame) -> DataFrame:
    """page_id, type of every opening tag."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<(\p{Alpha}\p{Alnum}*)"), 1)).alias("t")).select("page_id", F.lower("t").alias("type"))


def metadata(pages: DataFrame) -> DataFrame:
    """Title, language, character set, author and keywords, without a parser."""
    first = lambda p: F.regexp_extract("html", p, 1)
    return pages.withColumns({
        "title": F.trim(first("<title>([^<]*)</title>")), "lang": first('<html[^>]*lang="([^"]*)"'), "charset": first('<meta[^>]*charset="([^"]*)"'),
        "author": first('<meta[^>]*name="author"[^>]*content="([^"]*)"'), "keywords": F.filter(F.transform(F.split(first('<meta[^>]*name="keywords"[^>]*content="([^"]*)"'), ","), lambda x: F.trim(x)), lambda x: x != ""),
    })


def visible_text(c: Column) -> Column:
    """Text without comments, scripts, styles, head and tags; an unknown entity stays as it is."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?is)<(?:script|style|head)(?![A-Za-z0-9_])[^>]*>.*?</(?:script|style|head)>", " ")
    c = F.trim(T.collapse(F.regexp_replace(c, r"<[^>]*>", " "), T.TREE_SPACE))
    return T.decode_entities(c, {"lt": "<", "gt": ">", "quot": '"', "copy": "©", "nbsp": " "})


class _Element:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []  # children: elements and strings


class _Tree(HTMLParser):
    """Elements as they nest: void tags, implied ends, stray end tags ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.top = _Element("#top", {})
        self.stack = [self.top]

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P and any(e.tag == "p" for e in self.stack):
            self._close("p")
        if tag in _CLOSES:
            for e in reversed(self.stack):
                if e.tag in _SCOPES[tag]:
                    break
                if e.tag in _CLOSES[tag]:
                    self._close(e.tag)
                    break
        e = _Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.stack[1:]):
            self._close(tag)

    def _close(self, tag: str) -> None:
        while len(self.stack) > 1 and self.stack.pop().tag != tag:
            pass

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def handle_entityref(self, name):
        self.handle_data(_ENTITIES.get(name, f"&{name};"))

    def handle_charref(self, name):
        try:
            self.handle_data(chr(int(name[1:], 16) if name[:1] in "xX" else int(name)))
        except (ValueError, OverflowError):
            self.handle_data(f"&#{name};")


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return Node("root", _blocks(_convert_all(t.top.children)))


def _plain(e: _Element) -> str:
    return "".join(c if isinstance(c, str) else _plain(c) for c in e.children)


def _convert_all(children: list, verbatim: bool = False) -> list[Node]:
    out: list[Node] = []
    for c in children:
        if isinstance(c, str):
            text = c if verbatim else " ".join(c.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) if c.strip(" \t\r\n") else " "
            while "  " in text and not verbatim:
                text = text.replace("  ", " ")
            if out and out[-1].type == "text":
                out[-1].value += text
            else:
                out.append(Node("text", value=text))
        else:
            out += _convert(c)
    return out


def _convert(e: _Element) -> list[Node]:
    tag, own = e.tag, lambda: _convert_all(e.children)
    if tag in _DROPPED:
        return []
    if tag in _HOIST:
        return _blocks(own()) if tag in _ENDS_P or tag in ("body", "html", "main") else own()
    if tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2:
        return [Node("heading", _inline(own()), level=int(tag[1]))]
    if tag in _MARKS:
        return [Node(_MARKS[tag], own())]
    if tag in ("p", "dt", "figcaption"):
        return [Node(_BLOCKS[tag], _inline(own()))]
    if tag in ("blockquote", "li", "dd", "dl", "figure"):
        return [Node(_BLOCKS[tag], _blocks(own()) if tag != "dl" else [n for n in own() if n.type in BLOCK_TYPES])]
    if tag in ("ul", "ol"):
        start = {"start": e.attrs["start"]} if tag == "ol" and e.attrs.get("start", "1") != "1" else {}
        items = [n if n.type == "listItem" else Node("listItem", _blocks([n])) for n in own() if not _blank(n)]
        return [Node("list", items, ordered=tag == "ol", attrs=start)]
    if tag == "br":
        return [Node("break")]
    if tag == "hr":
        return [Node("thematicBreak")]
    if tag == "pre":
        inner = next((c for c in e.children if isinstance(c, _Element) and c.tag == "code"), None)
        kinds = (inner.attrs if inner else {}).get("class", "").split()
        lang = next((k[9:] for k in kinds if k.startswith("language-")), None)
        return [Node("code", value=_plain(e).strip("\n"), lang=lang)]
    if tag in ("code", "kbd", "samp", "tt", "var"):
        return [Node("inlineCode", value=_plain(e))]
    if tag == "a":
        href = e.attrs.get("href", "")
        if href.startswith("#"):
            return [Node("crossReference", own(), attrs={"target": href[1:]})]
        return [Node("link", own(), attrs={"url": href})] if href else own()
    if tag == "img":
        return [Node("image", attrs={"url": e.attrs.get("src", ""), "alt": e.attrs.get("alt", "")})]
    if tag == "table":
        return _table(e)
    return [Node("unknown", own(), attrs={"construct": f"html:{tag}"})]


def _blank(n: Node) -> bool:
    return n.type == "text" and not (n.value or "").strip(" \t\r\n")


def _inline(nodes: list[Node]) -> list[Node]:
    """Inline content of a block: blocks inside give their own content; ends are trimmed."""
    flat: list[Node] = []
    for n in nodes:
        flat += _inline(n.children) if n.type in BLOCK_TYPES and n.type not in ("unknown", "code") else [n]
    return trimmed(flat)


def trimmed(nodes: list[Node]) -> list[Node]:
    """Adjacent texts merged, white space at both ends and empty texts gone."""
    out: list[Node] = []
    for n in nodes:
        if n.type == "text" and out and out[-1].type == "text":
            out[-1] = Node("text", value=(out[-1].value or "") + (n.value or ""))
        else:
            out.append(n)
    if out and out[0].type == "text":
        out[0] = Node("text", value=out[0].value.lstrip(" \t\r\n"))
    if out and out[-1].type == "text":
        out[-1] = Node("text", value=out[-1].value.rstrip(" \t\r\n"))
    return [n for n in out if n.type != "text" or n.value]


def _blocks(nodes: list[Node]) -> list[Node]:
    """Blocks only: runs of inline content become paragraphs."""
    out: list[Node] = []
    run: list[Node] = []
    for n in [*nodes, None]:
        if n is not None and (n.type not in BLOCK_TYPES or n.type == "unknown" and all(c.type not in BLOCK_TYPES for c in n.children)):
            run.append(n)
            continue
        own = trimmed(run)
        if own and not all(x.type == "break" for x in own):
            out.append(Node("paragraph", own))
        run = []
        if n is not None:
            out.append(n)
    return out


def _span(e: _Element, name: str) -> int:
    v = e.attrs.get(name, "1")
    return max(1, min(1000, int(v))) if v.isdigit() else 1


def _table(e: _Element) -> list[Node]:
    found: list[Node] = []
    caption = None
    heads = 0

    def rows_of(x: _Element, head: bool) -> None:
        nonlocal caption, heads
        for c in x.children:
            if isinstance(c, str):
                continue
            if c.tag == "caption":
                caption = Node("caption", _inline(_convert_all(c.children)), attrs={"for": "table"})
            elif c.tag in ("thead", "tbody", "tfoot"):
                rows_of(c, c.tag == "thead")
            elif c.tag == "tr":
                cells = [d for d in c.children if isinstance(d, _Element) and d.tag in ("td", "th")]
                is_head = head or bool(cells) and all(d.tag == "th" for d in cells) and len(found) == heads
                heads += is_head
                found.append(Node("tableRow", [Node("tableCell", _blocks(_convert_all(d.children)), row_span=_span(d, "rowspan"), col_span=_span(d, "colspan"), attrs={"header": "true"} if d.tag == "th" or is_head else {}) for d in cells]))

    rows_of(e, False)
    table = Node("table", found, attrs={"headerRows": str(heads)})
    return [Node("figure", [table, caption])] if caption else [table]


def read_html(pages: DataFrame, id_column: str = "page_id", column: str = "html") -> DataFrame:
    """The node table of all pages."""
    return read(pages.select(F.col(id_column).cast("string").alias("doc_id"), F.col(column).cast("string")), parse)
