"""Diagnostics as rows, with the algebra of severity and loss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"^CE-[A-Z]+-[0-9]{4}$"


def _row(code: str, severity: str, lossy: bool, degraded: bool) -> list[Column]:
    import re

    if not re.match(PATTERN, code):
        raise ValueError(f"{code} is not a diagnostic code")
    return [F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(lossy).alias("lossy"), F.lit(degraded).alias("degraded")]


def lost(code: str) -> list[Column]:
    """Content is gone."""
    return _row(code, "warning", True, False)


def degraded(code: str) -> list[Column]:
    """Content is there in a lesser form."""
    return _row(code, "warning", True, True)


def unavailable(code: str) -> list[Column]:
    """A capability was missing; nothing is gone."""
    return _row(code, "warning", False, True)


def info(code: str) -> list[Column]:
    return _row(code, "info", False, False)


def error(code: str) -> list[Column]:
    return _row(code, "error", True, False)


def collect(*bags: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, bags)


def strict(bag: DataFrame) -> DataFrame:
    """What fails a strict run."""
    return bag.where("lossy or degraded")


def summary(bag: DataFrame) -> DataFrame:
    return bag.groupBy("code", "severity").agg(F.count("*").alias("n"), F.sum((F.col("lossy") | F.col("degraded")).cast("long")).alias("n_strict"))


def call_report(calls: DataFrame) -> DataFrame:
    """Totals over a log of model calls (task, cached, failed, repairs, tokens_in, tokens_out) by task."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    return calls.groupBy("task").agg(F.count("*").alias("calls"), count("cached").alias("hits"), count("failed").alias("failures"), count("repairs").alias("repairs"), count("tokens_in").alias("tokens_in"), count("tokens_out").alias("tokens_out"))


def answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (task, input) with the cached answer for their digest, null where none is held: a read-only
    cache of model calls as a table (cache_key, answer)."""
    key = F.sha2(F.to_json(F.struct("input", "task")), 256)
    return requests.withColumn("cache_key", key).join(cache, "cache_key", "left")
