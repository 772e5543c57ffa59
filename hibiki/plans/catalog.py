"""All queries of the core, by name."""

from __future__ import annotations

from . import ingest, japanese, matching, operations, quality, reconciling, reference_checks, retrieval, review, stats, streams, text

_MODULES = (text, japanese, retrieval, quality, stats, operations, reconciling, ingest, review, matching, streams, reference_checks)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
FLAGSHIP = "r1_bm25_topk"
