"""All queries over the driver's tables and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from . import contract_queries, derived_queries, ledger_queries, privacy_queries, protocol_queries, stream_queries, warehouse_queries

_MODULES = (warehouse_queries, contract_queries, privacy_queries, ledger_queries, derived_queries, stream_queries, protocol_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
