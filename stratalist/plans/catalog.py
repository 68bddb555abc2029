"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import listing_queries, reading_queries, record_queries, resolution_queries, score_queries, storage_queries, text_queries

_MODULES = (listing_queries, text_queries, record_queries, resolution_queries, score_queries, storage_queries, reading_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
