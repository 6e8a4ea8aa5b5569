"""Queries over the driver tables, one or more per operator, with their SQL twins."""

from __future__ import annotations

from logwarden.catalog import alerting, analytics, detection, logs, search  # noqa: F401  (they register queries)
from logwarden.catalog.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
