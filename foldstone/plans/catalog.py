"""All registered queries."""

from __future__ import annotations

from foldstone.plans import commands, compliance, documents, files, lineage, log, readmodels, sessions, views  # noqa: F401
from foldstone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
