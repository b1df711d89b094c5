"""The event table as sessions of actions for the rules over patterns.

Sessions are forty actions long and of four styles (edits and validations, searches,
retries, repeated lookups), so that each rule has what it looks for, next to sessions
that one odd row blocks. The mapping is synthetic; what proofs would say of an action
(admitted, place) is part of it. Its expressions are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceloom.sources.driver_tables import EVENTS_SQL, events

_BASE = {
    "id": "id", "session_id": "CAST(floor(id / 40) AS bigint)", "style": "CAST(floor(id / 40) AS bigint) % 4", "source_id": "CAST(floor(id / 40) AS bigint) % 23",
    "provider": "CASE WHEN CAST(floor(id / 40) AS bigint) % 2 = 0 THEN 'codex' ELSE 'claude' END", "tool": "tool", "took": "1 + duration_ms % 5000", "k": "CAST(op_key AS bigint)",
}
_WHAT = {
    "what": """CASE WHEN style = 0 THEN CASE WHEN tool = 'signup' THEN 'edit' WHEN tool = 'click' THEN 'search' ELSE 'test' END
 WHEN style = 1 THEN CASE WHEN tool = 'signup' AND id % 4 = 1 THEN 'edit' WHEN tool = 'error' THEN 'read' ELSE 'search' END
 WHEN style = 2 THEN CASE WHEN tool = 'purchase' THEN 'read' ELSE 'build' END ELSE CASE WHEN tool = 'signup' AND id % 3 = 0 THEN 'edit' ELSE 'read' END END""",
    "byte_offset": "id * 10 - CASE WHEN id % 1301 = 7 THEN 10 ELSE 0 END", "start_ms": "1700000000000 + id * 7000", "end_ms": "1700000000000 + id * 7000 + CASE WHEN id % 1201 = 5 THEN 8000 ELSE took END",
    "turn_id": "CASE WHEN id % 1709 = 3 THEN NULL ELSE session_id * 10 + CAST(floor((id % 40) / 16) AS bigint) END", "file_id": "source_id",
}
_MORE = {
    "kind": "CASE WHEN id % 503 = 11 THEN 'mcp' WHEN id % 709 = 1 THEN 'model' WHEN what = 'edit' THEN 'file_edit' WHEN what = 'read' THEN 'file_read' WHEN what = 'search' THEN 'search' ELSE 'shell' END",
    "category": "CASE WHEN id % 503 = 11 THEN 'mcp' WHEN id % 709 = 1 THEN 'model' ELSE what END", "tool_name": "CASE WHEN id % 709 = 1 THEN NULL WHEN what = 'edit' THEN 'Edit' WHEN what = 'read' THEN 'Read' WHEN what = 'search' THEN 'Grep' WHEN id % 577 = 3 THEN 'Bash' ELSE 'exec_command' END",
    "status": "CASE WHEN what = 'test' AND id % 3 = 0 OR what = 'build' AND id % 7 <> 0 OR what = 'edit' AND id % 311 = 8 THEN 'failed' ELSE 'completed' END",
    "outcome": "CASE WHEN what = 'test' AND id % 3 = 0 OR what = 'build' AND id % 7 <> 0 OR what = 'edit' AND id % 311 = 8 THEN 'error' WHEN what IN ('test', 'build') AND id % 67 = 9 THEN 'unknown' ELSE 'success' END",
    "op_key": "CASE WHEN id % 1811 = 4 THEN NULL WHEN what = 'build' THEN 'make' WHEN what = 'test' THEN CASE WHEN k % 9 = 0 THEN 'pytest -q' ELSE 'pytest' END END",
    "error_class": "CASE WHEN what IN ('test', 'build') THEN 'exit' END", "error_key": "CASE WHEN what IN ('test', 'build') AND id % 97 <> 1 THEN CASE WHEN floor(id / 9) % 3 = 0 THEN 'e1' ELSE 'e2' END END",
    "lookup_key": "CASE WHEN what IN ('read', 'search') AND id % 71 <> 6 THEN CASE WHEN k % 2 = 0 THEN 'src' ELSE 'docs' END END", "lookup_range": "CASE WHEN what = 'read' AND id % 89 <> 2 THEN '1-40' END",
    "content_key": "CASE WHEN id % 83 <> 3 THEN CASE WHEN k % 5 = 0 THEN 'c1' ELSE 'c2' END END", "content_state": "CASE WHEN id % 79 = 4 THEN 'partial' ELSE 'complete' END", "change_state": "CASE WHEN id % 73 = 5 THEN 'changed' ELSE 'unchanged' END",
    "validation_scope": "CASE WHEN k % 11 = 0 THEN 'unknown' WHEN k % 11 < 9 THEN 'full' ELSE 'targeted' END",
    "interval_scope": "CASE WHEN session_id % 41 = 5 AND id % 2 = 0 THEN 'item_lifecycle' ELSE 'invocation_latency' END", "interval_evidence": "'paired_timestamps'",
    "admitted": "id % 709 <> 1 AND id % 401 <> 13", "position_reason": "CASE WHEN id % 601 = 17 THEN 'missing_position_proof' END",
    "partition_status": "CASE WHEN session_id % 53 = 7 THEN 'provenance_unresolved' ELSE 'evaluated' END", "suppressed": "CASE WHEN source_id = 19 THEN 'state_limited' END",
    "coverage": "CASE WHEN source_id = 18 THEN 'partial' ELSE 'recognized_shapes' END", "unsupported_records": "CASE WHEN source_id = 17 THEN 1 ELSE 0 END",
}


def _columns(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in exprs.items()]


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with their proofs, places and what their source is."""
    return events(spark, sf_dir).selectExpr(*_columns(_BASE)).selectExpr("*", *_columns(_WHAT)).selectExpr("*", *_columns(_MORE))


ACTIONS_SQL = f"{EVENTS_SQL}, a0 AS (SELECT {', '.join(_columns(_BASE))} FROM ev), a1 AS (SELECT *, {', '.join(_columns(_WHAT))} FROM a0), ac AS (SELECT *, {', '.join(_columns(_MORE))} FROM a1)"
