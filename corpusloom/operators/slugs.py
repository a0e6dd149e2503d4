"""Anchors that are unique within a document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def next_slug(base: str, used: set[str]) -> str:
    """base, or base-2, base-3, ... whatever is not taken yet, by a natural slug either."""
    slug, n = base, 2
    while slug in used:
        slug, n = f"{base}-{n}", n + 1
    used.add(slug)
    return slug


def unique(headings: DataFrame, scope: str, order: str, base: str) -> DataFrame:
    """headings with slug. Which suffix is free depends on all slugs before: a fold over each
    scope's sorted rows, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, tried = object(), set(), {}
        for b in batches:
            out = []
            for s, x in zip(b.column(scope).to_pylist(), b.column(base).to_pylist()):
                if s != now:
                    now, used, tried = s, set(), {}
                n = tried.get(x, 1)  # lower numbers are known to be taken
                slug = x if n == 1 else f"{x}-{n}"
                while slug in used:
                    n += 1
                    slug = f"{x}-{n}"
                used.add(slug)
                tried[x] = n
                out.append(slug)
            yield b.append_column("slug", pa.array(out, pa.string()))

    return headings.repartition(scope).sortWithinPartitions(scope, order).mapInArrow(run, StructType([*headings.schema.fields, StructField("slug", StringType())]))
