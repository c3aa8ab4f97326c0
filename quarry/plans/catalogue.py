"""Every query of the engine, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import extra, graphs, ingest, metadata, more, reports, retrieval, streams, texts  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
