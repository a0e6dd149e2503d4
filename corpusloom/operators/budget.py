"""Routing to sections, unit order, and the greedy fill of a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SECTIONS = "section string, section_idx int, categories array<string>, weight double, max_units int"
OVERFLOW = ("linkToSecondary", "truncateLowestValue", "fail")


def value_of(weight: Column, authority: Column, confidence: Column, n_sources: Column) -> Column:
    spread = F.least(F.lit(1.0), (n_sources.cast("double") - 1) / 2)
    return weight * (F.lit(0.4) + F.lit(0.3) * authority + F.lit(0.2) * confidence + F.lit(0.1) * spread)


def route(units: DataFrame, sections: DataFrame) -> DataFrame:
    """Each unit with the first section that lists its category; null section where none does.
    sections is a profile's: a few rows, broadcast."""
    listed = sections.select("section", "section_idx", "weight", "max_units", F.posexplode("categories").alias("category_idx", "category"))
    first = listed.groupBy("category").agg(F.min_by(F.struct("section", "section_idx", "category_idx", "weight", "max_units"), F.struct("section_idx", "category_idx")).alias("s"))
    return units.join(F.broadcast(first), "category", "left").select(*units.columns, "s.*")


def unit_order(routed: DataFrame, within: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*within).orderBy("section_idx", "category_idx", *order)
    return routed.withColumn("position", F.row_number().over(w))


def fill(units: DataFrame, group: str, order: list, primary: int, secondary: int, overflow: str = "linkToSecondary") -> DataFrame:
    """place of each unit: units in order of falling value go to the primary budget if its section
    has room and they fit, else to the secondary if they fit, else nowhere; later, smaller ones may still
    fit. Columns read: group (string), section (string), max_units (int), tokens (long). A unit whose
    tokens are null (it has no text) takes none.

    The fold runs over each group's sorted rows as they stream by: its state is a few numbers, so
    that a group may be larger than memory."""
    if overflow not in OVERFLOW:
        raise ValueError(f"overflow must be one of {OVERFLOW}")
    schema = StructType([*units.schema.fields, StructField("place", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, spare, count = object(), 0, 0, {}
        for b in batches:
            places = []
            for g, section, most, tokens in zip(*(b.column(c).to_pylist() for c in (group, "section", "max_units", "tokens"))):
                tokens = tokens or 0
                if g != now:
                    now, used, spare, count = g, 0, 0, {}
                if section is None:
                    places.append("unrouted")
                elif (most is None or count.get(section, 0) < most) and used + tokens <= primary:
                    used += tokens
                    count[section] = count.get(section, 0) + 1
                    places.append("primary")
                elif overflow == "fail":
                    raise ValueError(f"group {g} exceeds its budget")
                elif overflow == "linkToSecondary" and spare + tokens <= secondary:
                    spare += tokens
                    places.append("secondary")
                else:
                    places.append("dropped")
            yield b.append_column("place", pa.array(places, pa.string()))

    return units.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
