"""Contradictions: one entity with different values in different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(n_values: Column, n_paths: Column) -> Column:
    return F.when(n_values == 1, "agreement").when(n_paths == 1, "sequence").otherwise("conflict")


def entity_groups(units: DataFrame, entity: list[str], value: str, path: str) -> DataFrame:
    """Groups of units with an entity and a value: 'conflict' for several values in several paths,
    'sequence' for several in one path, 'agreement' for one value."""
    keyed = units.where(" and ".join(f"{c} is not null" for c in [*entity, value]))
    groups = keyed.groupBy(*entity).agg(F.count_distinct(value).alias("n_values"), F.count_distinct(path).alias("n_paths"), F.count("*").alias("n_units"), F.array_sort(F.collect_set(F.col(value).cast("string"))).alias("values"))
    return groups.withColumn("verdict", verdict(F.col("n_values"), F.col("n_paths")))


def conflicts_with(units: DataFrame, entity: list[str], value: str, path: str) -> DataFrame:
    """unit_id and the other units of its conflict, sorted."""
    found = entity_groups(units, entity, value, path).where("verdict = 'conflict'").select(*entity)
    members = units.where(F.col(value).isNotNull()).join(found, entity)
    ids = members.groupBy(*entity).agg(F.array_sort(F.collect_set("unit_id")).alias("ids"))
    return members.join(ids, entity).select("unit_id", F.array_remove("ids", F.col("unit_id")).alias("conflicts_with"))


def sides(units: DataFrame, entity: list[str], value: str, path: str) -> DataFrame:
    """Every side of every conflict: entity, unit_id, value, path, authority and its place, by falling
    authority, then path. Both sides are shown and none is chosen."""
    found = entity_groups(units, entity, value, path).where("verdict = 'conflict'").select(*entity)
    members = units.where(F.col(value).isNotNull()).join(found, entity).groupBy(*entity, "unit_id", F.col(value).alias("value")).agg(F.min(path).alias("path"), F.max("authority").alias("authority"))
    return members.withColumn("place", F.row_number().over(Window.partitionBy(*entity).orderBy(F.desc("authority"), "path", "unit_id")))


def report(groups: DataFrame) -> DataFrame:
    """A line of text for each conflict."""
    rows = groups.where("verdict = 'conflict'")
    entity = F.concat_ws("/", *(c for c in groups.columns if c not in ("n_values", "n_paths", "n_units", "values", "verdict")))
    return rows.select(entity.alias("entity"), F.concat(entity, F.lit(": "), F.array_join("values", " | "), F.lit(" in "), F.col("n_paths").cast("string"), F.lit(" sources")).alias("line"))
