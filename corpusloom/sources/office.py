"""Office packages: word-processing, presentation and spreadsheet files to node trees.

A package is a zip of XML parts. Elements are matched by local name; what a reader does not know
becomes an unknown node that names it, so that nothing is lost in silence.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET

from .html import trimmed
from .nodes import Node


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e if local(c) == name] if e is not None else []


class Package:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id to type and target (a part's name, or a URL)."""
        folder, file = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{file}.rels".lstrip("/"))
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target)
        return out


# Styles and numbering


class Styles:
    """Named styles with what they inherit: document defaults, then the chain of bases, at most 32 long."""

    def __init__(self, root: ET.Element | None) -> None:
        self.by_id = {attr(s, "styleId", ""): s for s in children(root, "style")}
        self.defaults = [child(root, "docDefaults", "rPrDefault", "rPr"), child(root, "docDefaults", "pPrDefault", "pPr")]

    def chain(self, style_id: str | None) -> list[ET.Element]:
        """From the root style to the named one; empty where a cycle breaks it."""
        out: list[ET.Element] = []
        while style_id in self.by_id:
            s = self.by_id[style_id]
            if s in out or len(out) > 32:
                return []
            out.append(s)
            style_id = attr(child(s, "basedOn"), "val")
        return out[::-1]

    def name(self, style_id: str | None) -> str:
        return attr(child(self.by_id.get(style_id or ""), "name"), "val", "") or ""

    def property(self, style_id: str | None, group: str, name: str, direct: ET.Element | None = None) -> ET.Element | None:
        """The innermost layer's element: direct formatting, then style, its bases, defaults."""
        layers = [direct, *(child(s, group) for s in reversed(self.chain(style_id))), *self.defaults]
        return next((found for x in layers if (found := child(x, name)) is not None), None)


class Numbering:
    def __init__(self, root: ET.Element | None) -> None:
        self.abstract = {attr(a, "abstractNumId"): {attr(x, "ilvl"): x for x in children(a, "lvl")} for a in children(root, "abstractNum")}
        self.nums = {attr(n, "numId"): n for n in children(root, "num")}

    def level(self, num_id: str | None, ilvl: str) -> tuple[bool, int, bool] | None:
        """ordered, start, restarts; null for no list (numId 0)."""
        num = self.nums.get(num_id)
        if num is None or num_id == "0":
            return None
        lvl = self.abstract.get(attr(child(num, "abstractNumId"), "val"), {}).get(ilvl)
        override = next((o for o in children(num, "lvlOverride") if attr(o, "ilvl") == ilvl), None)
        lvl = child(override, "lvl") if child(override, "lvl") is not None else lvl
        start = attr(child(override, "startOverride"), "val") or attr(child(lvl, "start"), "val", "1")
        kind = attr(child(lvl, "numFmt"), "val", "decimal")
        return kind not in ("bullet", "none"), int(start), override is not None and int(start) != 1


# Word processing

_RUN_MARKS = (("b", "strong"), ("i", "emphasis"), ("u", "underline"), ("strike", "delete"), ("smallCaps", "smallCaps"))


class _Docx:
    def __init__(self, package: Package, part: str) -> None:
        self.rel = package.relations(part)
        self.styles = Styles(package.xml("word/styles.xml"))
        self.numbering = Numbering(package.xml("word/numbering.xml"))

    def blocks(self, body: ET.Element | None) -> list[Node]:
        out: list[Node] = []
        stack: list[tuple[int, str, Node]] = []  # open lists: level, number id, node
        for e in body if body is not None else ():
            kind = local(e)
            if kind == "sdt":
                out += self.blocks(child(e, "sdtContent"))
            elif kind == "p":
                node, item = self.paragraph(e)
                if item:
                    self.to_list(out, stack, node, *item)
                    continue
                out += node
            elif kind == "tbl":
                out.append(self.table(e))
            elif kind not in ("sectPr", "tcPr", "bookmarkStart", "bookmarkEnd", "proofErr", "permStart", "permEnd"):
                out.append(Node("unknown", attrs={"construct": f"docx:{kind}"}))
            stack.clear()
        return out

    def to_list(self, out, stack, nodes, num_id, level, ordered, start) -> None:
        while stack and (stack[-1][0] > level or stack[-1][0] == level and stack[-1][1] != num_id):
            stack.pop()
        if not stack or stack[-1][0] < level:
            new = Node("list", ordered=ordered, attrs={"start": str(start)} if ordered and start != 1 else {})
            if stack and stack[-1][2].children:
                stack[-1][2].children[-1].children.append(new)
            else:
                out.append(new)
            stack.append((level, num_id, new))
        stack[-1][2].children.append(Node("listItem", nodes))

    def paragraph(self, p: ET.Element) -> tuple[list[Node], tuple | None]:
        pr = child(p, "pPr")
        style = attr(child(pr, "pStyle"), "val")
        inline = trimmed(self.inline(p))
        name = self.styles.name(style).lower()
        outline = attr(self.styles.property(style, "pPr", "outlineLvl", pr), "val")
        named = re.fullmatch(r"heading ([1-6])", name) or re.fullmatch(r"heading([1-6])", (style or "").lower())
        if named or outline is not None and int(outline) < 6:
            return [Node("heading", inline, level=int(named.group(1)) if named else int(outline) + 1)], None
        number = self.styles.property(style, "pPr", "numPr", pr)
        num_id, level = attr(child(number, "numId"), "val"), attr(child(number, "ilvl"), "val", "0")
        block = [Node("paragraph", inline)] if inline else []
        if (found := self.numbering.level(num_id, level)) and inline:
            return block, (num_id, int(level), *found[:2])
        if name in ("quote", "intense quote", "block text"):
            return [Node("blockquote", block)], None
        if name in ("source code", "html preformatted"):
            return [Node("code", value=Node("root", inline).text())], None
        if "caption" in name:
            return [Node("caption", inline)], None
        return block, None

    def inline(self, e: ET.Element) -> list[Node]:
        out: list[Node] = []
        for c in e:
            kind = local(c)
            if kind == "r":
                out += self.run(c)
            elif kind == "hyperlink":
                target, anchor = self.rel.get(attr(c, "id") or "", ("", ""))[1], attr(c, "anchor")
                own = self.inline(c)
                out.append(Node("crossReference", own, attrs={"target": anchor}) if anchor and not target else Node("link", own, attrs={"url": target}))
            elif kind in ("ins", "moveTo"):
                out.append(Node("insertion", self.inline(c), attrs={"author": attr(c, "author") or ""}))
            elif kind in ("del", "moveFrom"):
                out.append(Node("deletion", self.inline(c), attrs={"author": attr(c, "author") or ""}))
            elif kind in ("smartTag", "sdtContent", "fldSimple"):
                out += self.inline(c)
            elif kind == "sdt":
                out += self.inline(child(c, "sdtContent")) if child(c, "sdtContent") is not None else []
            elif kind in ("oMath", "oMathPara"):
                out.append(Node("inlineMath", value="".join(t.text or "" for t in c.iter() if local(t) == "t")))
        return out

    def run(self, r: ET.Element) -> list[Node]:
        pr = child(r, "rPr")
        out: list[Node] = []
        for c in r:
            kind = local(c)
            if kind in ("t", "delText"):
                out.append(Node("text", value=c.text or ""))
            elif kind in ("br", "cr"):
                out.append(Node("break"))
            elif kind == "tab":
                out.append(Node("text", value="\t"))
            elif kind == "noBreakHyphen":
                out.append(Node("text", value="‑"))
            elif kind in ("footnoteReference", "endnoteReference"):
                out.append(Node("footnoteReference", attrs={"label": ("e" if kind[0] == "e" else "") + (attr(c, "id") or "")}))
            elif kind == "commentReference":
                out.append(Node("comment", attrs={"id": attr(c, "id") or ""}))
            elif kind in ("drawing", "pict"):
                alt = next((attr(x, "descr") or "" for x in c.iter() if local(x) == "docPr"), "")
                blip = next((attr(x, "embed") for x in c.iter() if local(x) in ("blip", "imagedata")), None)
                out.append(Node("image", attrs={"url": self.rel.get(blip or "", ("", ""))[1], "alt": alt}))
            elif kind == "object":
                out.append(Node("unknown", attrs={"construct": "docx:object"}))
        if not out:
            return []
        vertical = attr(child(pr, "vertAlign"), "val")
        if (style := attr(child(pr, "rStyle"), "val")) and self.styles.name(style).lower() in ("verbatim char", "source code char", "html code"):
            return [Node("inlineCode", value=Node("root", out).text())]
        for tag, mark in reversed(_RUN_MARKS):
            e = child(pr, tag)
            if e is not None and attr(e, "val", "1") not in ("0", "false", "none"):
                out = [Node(mark, out)]
        if color := attr(child(pr, "highlight"), "val"):
            out = [Node("highlight", out, attrs={"color": color})] if color != "none" else out
        if vertical in ("superscript", "subscript"):
            out = [Node(vertical, out)]
        return out

    def table(self, t: ET.Element) -> Node:
        rows: list[Node] = []
        open_: dict[int, Node] = {}  # the cell that a vertical merge continues, by column
        heads = 0
        for tr in children(t, "tr"):
            row, col = Node("tableRow"), 0
            is_head = attr(child(tr, "trPr", "tblHeader"), "val", "1" if child(tr, "trPr", "tblHeader") is not None else "0") not in ("0", "false")
            heads += is_head and heads == len(rows)
            for tc in children(tr, "tc"):
                pr = child(tc, "tcPr")
                span = int(attr(child(pr, "gridSpan"), "val", "1"))
                merge = child(pr, "vMerge")
                if merge is not None and attr(merge, "val") != "restart" and col in open_:
                    open_[col].row_span += 1
                else:
                    cell = Node("tableCell", self.blocks(tc), row_span=1, col_span=span, attrs={"header": "true"} if is_head else {})
                    row.children.append(cell)
                    open_.pop(col, None)
                    if merge is not None:
                        open_[col] = cell
                col += span
            rows.append(row)
        return Node("table", rows, attrs={"headerRows": str(heads)})


def parse_docx(data: bytes) -> list[tuple[str, Node]]:
    """Roots by kind: body, and headers and footers apart."""
    p = Package(data)
    part = next((t for k, t in p.relations("").values() if k == "officeDocument"), "word/document.xml")
    root = p.xml(part)
    body = Node("root", _Docx(p, part).blocks(child(root, "body")))
    for name, prefix in (("footnotes", ""), ("endnotes", "e")):
        notes = p.xml(f"word/{name}.xml")
        reader = _Docx(p, f"word/{name}.xml")
        for n in notes if notes is not None else ():
            if attr(n, "type") in (None, "normal"):
                body.children.append(Node("footnoteDefinition", reader.blocks(n), attrs={"label": prefix + (attr(n, "id") or "")}))
    roots = [("body", body)]
    for kind, target in sorted(p.relations(part).values()):
        if kind in ("header", "footer"):
            roots.append((f"{kind}:{posixpath.basename(target)}", Node("root", _Docx(p, target).blocks(p.xml(target)))))
    return roots


def docx_metadata(data: bytes) -> dict[str, str]:
    root = Package(data).xml("docProps/core.xml")
    return {local(e): e.text or "" for e in root if local(e) in ("title", "creator", "language", "created", "modified", "keywords")} if root is not None else {}


# Presentations


def _shape_place(s: ET.Element) -> tuple[int, int, int]:
    kind = next((attr(x, "type") for x in s.iter() if local(x) == "ph"), None)
    off = next((x for x in s.iter() if local(x) == "off"), None)
    # Shapes within 20 points of height form one row, so that the order is transitive.
    return (0 if kind in ("title", "ctrTitle") else 1, int(attr(off, "y", "0")) // (20 * 12700), int(attr(off, "x", "0")))


def _text_body(body: ET.Element | None, title: bool = False) -> list[Node]:
    out: list[Node] = []
    open_: Node | None = None
    for p in children(body, "p"):
        text: list[Node] = []
        for r in p:
            if local(r) in ("r", "fld"):
                value = [Node("text", value=(child(r, "t").text if child(r, "t") is not None else "") or "")]
                for name, mark in (("b", "strong"), ("i", "emphasis")):
                    if attr(child(r, "rPr"), name, "0") in ("1", "true"):
                        value = [Node(mark, value)]
                text += value
            elif local(r) == "br":
                text.append(Node("break"))
        text = trimmed(text)
        pr = child(p, "pPr")
        if not text:
            continue
        if title:
            out.append(Node("heading", text, level=1))
        elif child(pr, "buNone") is not None:
            out.append(Node("paragraph", text))
            open_ = None
        else:
            ordered = child(pr, "buAutoNum") is not None
            if open_ is None or open_.ordered != ordered:
                open_ = Node("list", ordered=ordered)
                out.append(open_)
            open_.children.append(Node("listItem", [Node("paragraph", text)], attrs={"depth": attr(pr, "lvl", "0") or "0"}))
    return out


def _grid_table(t: ET.Element) -> Node:
    rows = []
    for tr in children(t, "tr"):
        cells = [c for c in children(tr, "tc") if attr(c, "hMerge", "0") == "0" and attr(c, "vMerge", "0") == "0"]
        rows.append(Node("tableRow", [Node("tableCell", [Node("paragraph", n.children) if n.type == "paragraph" else n for n in _plain_cell(c)], row_span=int(attr(c, "rowSpan", "1")), col_span=int(attr(c, "gridSpan", "1"))) for c in cells]))
    head = attr(child(t, "tblPr"), "firstRow", "0") in ("1", "true")
    return Node("table", rows, attrs={"headerRows": "1" if head else "0"})


def _plain_cell(c: ET.Element) -> list[Node]:
    text = "\n".join("".join(t.text or "" for t in p.iter() if local(t) == "t") for p in children(child(c, "txBody"), "p")).strip()
    return [Node("paragraph", [Node("text", value=text)])] if text else []


def parse_pptx(data: bytes) -> Node:
    p = Package(data)
    slides = sorted((int(m.group(1)), n) for n in p.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    root = Node("root")
    for number, name in slides:
        slide = Node("slide", attrs={"number": str(number)})
        rel = p.relations(name)
        for s in sorted((e for e in child(p.xml(name), "cSld", "spTree") if local(e) in ("sp", "pic", "graphicFrame", "grpSp")), key=_shape_place):
            kind = local(s)
            if kind == "sp":
                slide.children += _text_body(child(s, "txBody"), _shape_place(s)[0] == 0)
            elif kind == "pic":
                alt = next((attr(x, "descr") or "" for x in s.iter() if local(x) == "cNvPr"), "")
                blip = next((attr(x, "embed") for x in s.iter() if local(x) == "blip"), "")
                slide.children.append(Node("paragraph", [Node("image", attrs={"url": rel.get(blip or "", ("", ""))[1], "alt": alt})]))
            elif kind == "graphicFrame" and (t := next((x for x in s.iter() if local(x) == "tbl"), None)) is not None:
                slide.children.append(_grid_table(t))
            else:
                slide.children.append(Node("unknown", attrs={"construct": f"pptx:{kind}"}))
        for kind, target in rel.values():
            if kind == "notesSlide" and (notes := p.xml(target)) is not None:
                own = [n for s in notes.iter() if local(s) == "sp" and next((attr(x, "type") for x in s.iter() if local(x) == "ph"), "") == "body" for n in _text_body(child(s, "txBody"))]
                if own:
                    slide.children.append(Node("admonition", own, attrs={"kind": "notes"}))
        root.children.append(slide)
    return root


# Spreadsheets


def cell_place(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B7."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    col = 0
    for c in m.group(1):
        col = 26 * col + ord(c) - 64
    return int(m.group(2)) - 1, col - 1


def _shared(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if local(t) == "t")


def parse_xlsx(data: bytes, max_rows: int | None = None) -> Node:
    """Every sheet with all of its rows; max_rows is a caller's own limit, which the sheet's node then tells."""
    p = Package(data)
    strings = [_shared(e) for e in p.xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in p.names else []
    rel = p.relations("xl/workbook.xml")
    root = Node("root")
    for s in child(p.xml("xl/workbook.xml"), "sheets"):
        sheet = p.xml(rel[attr(s, "id")][1])
        node = Node("sheet", [Node("heading", [Node("text", value=s.get("name", ""))], level=1)], attrs={"name": s.get("name", "")})
        root.children.append(node)
        cells: dict[tuple[int, int], str] = {}
        degraded = 0
        for c in (c for r in children(child(sheet, "sheetData"), "row") for c in children(r, "c")):
            value, kind = child(c, "v"), c.get("t", "n")
            text = _shared(child(c, "is")) if kind == "inlineStr" and child(c, "is") is not None else value.text if value is not None else None
            degraded += child(c, "f") is not None
            if text is not None:
                cells[cell_place(c.get("r"))] = strings[int(text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
        if not cells:
            continue
        spans, covered = {}, set()
        for m in child(sheet, "mergeCells") if child(sheet, "mergeCells") is not None else ():
            (a, b), (c, d) = (cell_place(x) for x in m.get("ref").split(":"))
            spans[a, b] = (c - a + 1, d - b + 1)
            covered |= {(i, j) for i in range(a, c + 1) for j in range(b, d + 1)} - {(a, b)}
        top, left = min(r for r, _ in cells), min(c for _, c in cells)
        bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
        if max_rows is not None and bottom - top + 1 > max_rows:
            node.attrs["truncated"] = str(bottom - top + 1 - max_rows)
            bottom = top + max_rows - 1
        if degraded:
            node.attrs["formulas"] = str(degraded)
        rows = []
        for r in range(top, bottom + 1):
            row = Node("tableRow")
            for c in range(left, right + 1):
                if (r, c) not in covered:
                    down, across = spans.get((r, c), (1, 1))
                    text = cells.get((r, c), "")
                    row.children.append(Node("tableCell", [Node("paragraph", [Node("text", value=text)])] if text else [], row_span=down, col_span=across, attrs={"header": "true"} if r == top else {}))
            rows.append(row)
        node.children.append(Node("table", rows, attrs={"headerRows": "1"}))
    return root
