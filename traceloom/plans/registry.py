"""Registered queries over the driver's tables, and the SQL that must agree with each."""

from __future__ import annotations

from traceloom.plans import append_queries, cohort_queries, evidence_queries, ingest_queries, interval_queries, native_queries, relation_queries, rule_queries, selected_queries, sequence_queries, store_queries

FLAGSHIP = "interval_union"
_MODULES = [interval_queries, sequence_queries, cohort_queries, relation_queries, ingest_queries, native_queries, selected_queries, rule_queries, append_queries, store_queries, evidence_queries]
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
