"""All registered queries and their SQL twins."""

from __future__ import annotations

from sluiceway.plans import file_queries, flow_queries, record_queries, stage_queries, stream_queries

_MODULES = (flow_queries, record_queries, stage_queries, file_queries, stream_queries)
QUERIES = {n: f for m in _MODULES for n, f in m.QUERIES.items() if f.__module__ == m.__name__}
ORACLES = {n: s for m in _MODULES for n, s in m.ORACLES.items()}
