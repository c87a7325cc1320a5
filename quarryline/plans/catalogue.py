"""The engine's queries and the SQL that must give the same rows."""

from __future__ import annotations

from quarryline.plans import chunks, compute, datasets, ingest, lexical, more, relational, sketches, sources, temporal, vectors  # noqa: F401  they register their queries
from quarryline.plans.registry import QUERIES, SQL
from quarryline.plans.vectors import flagship

__all__ = ["QUERIES", "SQL", "flagship"]
