"""Node table to canonical JSON, one document a row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.hashing import canonical
from ..sources.nodes import Node, tree


def as_dict(n: Node) -> dict:
    own = {"type": n.type, "children": [as_dict(c) for c in n.children] or None, "value": n.value, "depth": n.level, "ordered": n.ordered, "lang": n.lang, "rowSpan": n.row_span, "colSpan": n.col_span, **n.attrs}
    return {k: v for k, v in own.items() if v is not None}


def render(nodes: DataFrame) -> DataFrame:
    """doc_id, rendered: keys sorted, strings composed, the same bytes for the same tree."""

    def run(key, group):
        return pa.table({"doc_id": [key[0].as_py()], "rendered": [canonical(as_dict(tree([r for r in group.to_pylist() if r["root_kind"] == "body"])))]})

    return nodes.groupBy("doc_id").applyInArrow(run, "doc_id string, rendered string")
