"""All registered queries of the archive engine."""

from __future__ import annotations

from . import annotations, archive, canonical, extraction, further, labels, layout, lifecycle, measures, pagequeries, records, retrieval, rules, stagequeries, textual, texts  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
