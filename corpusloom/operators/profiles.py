"""Target profiles as data: sections, budget, outputs; one may extend another."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .budget import SECTIONS

REQUIRED = ("id", "version", "kind")
KINDS = ("flat", "scoped", "skills", "commands", "manifest")

BASE = {
    "id": "base", "version": 1, "kind": "flat",
    "budget": {"primary": 6000, "secondary": 24000, "chars_per_token": 3.8, "overflow": "linkToSecondary"},
    "sections": [
        {"section": "commands", "heading": "Commands", "categories": ["command"], "weight": 1.6, "render": "code"},
        {"section": "constraints", "heading": "Constraints", "categories": ["invariant", "constraint"], "weight": 1.5, "render": "list"},
        {"section": "anti-patterns", "heading": "Avoid", "categories": ["antiPattern"], "weight": 1.4, "render": "list"},
        {"section": "conventions", "heading": "Conventions", "categories": ["convention"], "weight": 1.2, "render": "list"},
        {"section": "environment", "heading": "Environment", "categories": ["environment"], "weight": 1.1, "render": "code"},
        {"section": "decisions", "heading": "Decisions", "categories": ["decision"], "weight": 1.0, "render": "list"},
        {"section": "glossary", "heading": "Glossary", "categories": ["glossary"], "weight": 0.6, "render": "list"},
    ],
}


def resolve(profiles: dict[str, dict], name: str, seen: tuple[str, ...] = ()) -> dict:
    """The profile with what it extends, laid under it key by key; a cycle or a missing key is an error."""
    if name in seen:
        raise ValueError(f"profiles extend each other: {' -> '.join((*seen, name))}")
    if name not in profiles:
        raise KeyError(f"no profile {name}")
    own = profiles[name]
    if missing := [k for k in REQUIRED if k not in own]:
        raise ValueError(f"profile {name} lacks {', '.join(missing)}")
    base = resolve(profiles, own["extends"], (*seen, name)) if own.get("extends") else {}
    found = {k: v for k, v in {**base, **own}.items() if k != "extends"}
    if found["kind"] not in KINDS:
        raise ValueError(f"profile {name} has kind {found['kind']}")
    return found


def load(folder: str) -> dict[str, dict]:
    found = {}
    for path in sorted(Path(folder).glob("*.json")):
        profile = json.loads(path.read_text())
        if profile["id"] in found:
            raise ValueError(f"two profiles have the id {profile['id']}")
        found[profile["id"]] = profile
    return found


def sections(spark: SparkSession, profile: dict) -> DataFrame:
    rows = [(s["section"], i, s["categories"], float(s.get("weight", 1.0)), s.get("max_units")) for i, s in enumerate(profile["sections"])]
    return spark.createDataFrame(rows, SECTIONS)


def verification_age(date: Column, today: Column) -> Column:
    """Days since a profile's facts were last checked; null without a date, which is neither fresh nor old."""
    return F.datediff(today, F.try_to_date(date, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(date))


def verification_ages(spark: SparkSession, profiles: dict[str, dict], today: str) -> DataFrame:
    """id, checked, age_days of every profile."""
    rows = spark.createDataFrame([(k, p.get("verified")) for k, p in sorted(profiles.items())], "id string, checked string")
    return rows.withColumn("age_days", verification_age(F.col("checked"), F.lit(today).cast("date")))


def init(folder: str, name: str = "base") -> str:
    """Write a first profile to a folder that has none of that name; its path."""
    path = Path(folder) / f"{name}.json"
    if path.exists():
        raise FileExistsError(f"{path} is there already")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(BASE | {"id": name}, indent=2, sort_keys=True) + "\n")
    return str(path)
