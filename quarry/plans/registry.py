"""Named queries over the driver tables and their SQL twins."""

from __future__ import annotations

from quarry.plans import document_queries, frame_queries, index_queries, operator_queries, record_queries, sql_queries, store_queries

QUERIES = sql_queries.QUERIES | frame_queries.QUERIES | document_queries.QUERIES | operator_queries.QUERIES | index_queries.QUERIES | store_queries.QUERIES | record_queries.QUERIES
ORACLES = sql_queries.ORACLES | frame_queries.ORACLES | document_queries.ORACLES | operator_queries.ORACLES | index_queries.ORACLES | store_queries.ORACLES | record_queries.ORACLES
