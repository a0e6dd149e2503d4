"""Node table to word-processing packages: named styles, numbered lists, merged cells, notes, links."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from ..sources.nodes import TREE, Node, body, per_document

OX = "openxmlformats"
NS = f"http://schemas.{OX}.org"
W, R = f"{NS}/wordprocessingml/2006/main", f"{NS}/officeDocument/2006/relationships"
PACKAGE = f"{NS}/package/2006"
STYLES = ["Normal", *(f"Heading {i}" for i in range(1, 7)), "Quote", "Source Code", "Caption", "Verbatim Char"]
_MARKS = {"strong": "<w:b/>", "emphasis": "<w:i/>", "underline": '<w:u w:val="single"/>', "delete": "<w:strike/>", "smallCaps": "<w:smallCaps/>", "superscript": '<w:vertAlign w:val="superscript"/>', "subscript": '<w:vertAlign w:val="subscript"/>', "highlight": '<w:highlight w:val="yellow"/>'}


def style_id(name: str) -> str:
    return name.replace(" ", "")


def missing_styles(available: list[str]) -> list[str]:
    """Style names that a template does not define."""
    have = {a.lower() for a in available}
    return [s for s in STYLES if s.lower() not in have]


class Writer:
    def __init__(self) -> None:
        self.links: list[str] = []
        self.lists: list[tuple[bool, int]] = []
        self.notes: list[tuple[str, Node]] = []

    def package(self, root: Node) -> bytes:
        self.notes = [(str(i + 1), n) for i, n in enumerate(n for n in root.children if n.type == "footnoteDefinition")]
        self.note_ids = {n.attrs.get("label", ""): i for i, n in self.notes}
        body = self.blocks([n for n in root.children if n.type != "footnoteDefinition"])
        notes = "".join(f'<w:footnote w:id="{i}">{self.blocks(n.children)}</w:footnote>' for i, n in self.notes)
        doc = f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{body}</w:body></w:document>'
        kind = f"application/vnd.{OX}-officedocument.wordprocessingml"
        default = lambda ending, what: f'<Default Extension="{ending}" ContentType="{what}"/>'
        override = lambda part, what: f'<Override PartName="/word/{part}.xml" ContentType="{kind}.{what}"/>'
        relation = lambda i, what, to, more="": f'<Relationship Id="{i}" Type="{R}/{what}" Target={quoteattr(to)}{more}/>'
        relations = lambda *own: f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(own)}</Relationships>'
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types">{default("xml", "application/xml")}{default("rels", f"application/vnd.{OX}-package.relationships+xml")}{override("document", "document.main+xml")}{override("styles", "styles+xml")}{override("numbering", "numbering+xml")}{override("footnotes", "footnotes+xml")}</Types>',
            "_rels/.rels": relations(relation("r1", "officeDocument", "word/document.xml")),
            "word/document.xml": doc,
            "word/styles.xml": f'<w:styles xmlns:w="{W}">' + "".join(f'<w:style w:type="{"character" if s.endswith("Char") else "paragraph"}" w:styleId="{style_id(s)}"><w:name w:val="{s}"/>' + (f'<w:pPr><w:outlineLvl w:val="{int(s[-1]) - 1}"/></w:pPr>' if s.startswith("Heading") else "") + "</w:style>" for s in STYLES) + "</w:styles>",
            "word/numbering.xml": self.numbering(),
            "word/footnotes.xml": f'<w:footnotes xmlns:w="{W}" xmlns:r="{R}">{notes}</w:footnotes>',
            "word/_rels/document.xml.rels": relations(*(relation(f"s{i}", k, f"{k}.xml") for i, k in enumerate(("styles", "numbering", "footnotes"))), *(relation(f"l{i}", "hyperlink", u, ' TargetMode="External"') for i, u in enumerate(self.links))),
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(parts):  # fixed order and time: the same tree gives the same bytes
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), parts[name], zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def numbering(self) -> str:
        levels = lambda fmt: "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/></w:lvl>' for i in range(9))
        nums = "".join(f'<w:num w:numId="{i + 1}"><w:abstractNumId w:val="{int(o)}"/>' + "".join(f'<w:lvlOverride w:ilvl="{k}"><w:startOverride w:val="{s}"/></w:lvlOverride>' for k in ([level] if o else [])) + "</w:num>" for i, (o, s, level) in enumerate(self.lists))
        return f'<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0">{levels("bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal")}</w:abstractNum>{nums}</w:numbering>'

    def blocks(self, nodes: list[Node], pr: str = "", depth: int = 0) -> str:
        return "".join(self.block(n, pr, depth) for n in nodes)

    def p(self, nodes: list[Node], pr: str = "") -> str:
        return f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}{self.runs(nodes)}</w:p>"

    def block(self, n: Node, pr: str, depth: int) -> str:
        t = n.type
        style = lambda name: f'<w:pStyle w:val="{style_id(name)}"/>'
        if t == "heading":
            return self.p(n.children, style(f"Heading {min(6, n.level or 1)}"))
        if t in ("blockquote", "admonition"):
            return self.blocks(n.children, style("Quote"), depth)
        if t == "code":
            return self.p([x for i, line in enumerate((n.value or "").split("\n")) for x in ([Node("break")] if i else []) + [Node("text", value=line)]], style("Source Code"))
        if t == "caption":
            return self.p(n.children, style("Caption"))
        if t == "list":
            self.lists.append((bool(n.ordered), int(n.attrs.get("start", "1")), depth))
            number = f'<w:numPr><w:ilvl w:val="{depth}"/><w:numId w:val="{len(self.lists)}"/></w:numPr>'
            return "".join(self.blocks([c], number if c.type == "paragraph" else "", depth + 1) for i in n.children for c in i.children)
        if t == "table":
            return self.table(n)
        if t == "thematicBreak":
            return '<w:p><w:pPr><w:pBdr><w:bottom w:val="single"/></w:pBdr></w:pPr></w:p>'
        if t in ("paragraph", "descriptionTerm"):
            return self.p(n.children, pr)
        return self.blocks(n.children, pr, depth)

    def table(self, n: Node) -> str:
        from ..operators.fidelity import grid

        cells = [(i, j, c.row_span or 1, c.col_span or 1, c) for i, r in enumerate(n.children) for j, c in enumerate(r.children)]
        at = dict(zip(grid([c[:4] for c in cells]), cells))
        heads = int(n.attrs.get("headerRows", "0"))
        out = []
        below: dict[tuple[int, int], int] = {}
        for (r, c), (_, _, down, across, _) in at.items():
            below |= {(r + i, c): across for i in range(1, down)}
        for r in range(len(n.children)):
            row = []
            for col in sorted({c for q, c in (*at, *below) if q == r}):
                if (r, col) in at:
                    _, _, down, across, cell = at[r, col]
                    pr = (f'<w:gridSpan w:val="{across}"/>' if across > 1 else "") + ('<w:vMerge w:val="restart"/>' if down > 1 else "")
                    row.append(f"<w:tc><w:tcPr>{pr}</w:tcPr>{self.blocks(cell.children) or '<w:p/>'}</w:tc>")
                else:
                    across = below[r, col]
                    row.append(f"<w:tc><w:tcPr>{f'<w:gridSpan w:val=%s/>' % quoteattr(str(across)) if across > 1 else ''}<w:vMerge/></w:tcPr><w:p/></w:tc>")
            out.append(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if r < heads else ''}{''.join(row)}</w:tr>")
        return f"<w:tbl>{''.join(out)}</w:tbl>"

    def runs(self, nodes: list[Node], pr: str = "") -> str:
        out = ""
        for n in nodes:
            t = n.type
            wrap = lambda inner: f"<w:r>{f'<w:rPr>{pr}</w:rPr>' if pr else ''}{inner}</w:r>"
            if t == "text":
                out += wrap(f'<w:t xml:space="preserve">{escape(n.value or "")}</w:t>')
            elif t == "inlineCode":
                out += f'<w:r><w:rPr><w:rStyle w:val="VerbatimChar"/></w:rPr><w:t xml:space="preserve">{escape(n.value or "")}</w:t></w:r>'
            elif t == "break":
                out += wrap("<w:br/>")
            elif t in _MARKS:
                out += self.runs(n.children, pr + _MARKS[t])
            elif t == "link":
                self.links.append(n.attrs.get("url", ""))
                out += f'<w:hyperlink r:id="l{len(self.links) - 1}">{self.runs(n.children, pr)}</w:hyperlink>'
            elif t == "crossReference":
                out += f"<w:hyperlink w:anchor={quoteattr(n.attrs.get('target', ''))}>{self.runs(n.children, pr)}</w:hyperlink>"
            elif t == "footnoteReference" and n.attrs.get("label") in self.note_ids:
                out += f'<w:r><w:footnoteReference w:id="{self.note_ids[n.attrs["label"]]}"/></w:r>'
            elif t in ("insertion", "deletion"):
                tag = "ins" if t == "insertion" else "del"
                own = self.runs(n.children, pr)
                out += f"<w:{tag} w:author={quoteattr(n.attrs.get('author', ''))}>{own.replace('<w:t ', '<w:delText ').replace('</w:t>', '</w:delText>') if tag == 'del' else own}</w:{tag}>"
            elif t == "inlineMath":
                out += f'<m:oMath xmlns:m="{NS}/officeDocument/2006/math"><m:r><m:t>{escape(n.value or "")}</m:t></m:r></m:oMath>'
            else:
                out += self.runs(n.children, pr)
        return out


def render(nodes: DataFrame) -> DataFrame:
    """doc_id, bytes."""
    return per_document(nodes, lambda doc, rows: [(doc, Writer().package(body(rows)))], "doc_id string, bytes binary", *TREE)
