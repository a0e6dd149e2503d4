"""Every query of the engine by name, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from .plans import corpus, derived, tables  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401


def entry(spark, sf_dir: str):
    """The flagship: restatements over all documents."""
    return QUERIES["q03_restatement_dedup"](spark, sf_dir)
