"""All registered queries."""

from __future__ import annotations

from txrisk.plans import describe, learn, measure, rows, scans  # noqa: F401
from txrisk.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
