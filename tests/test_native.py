"""Blockers of sessions: in one pass over their rows, for any width of the blocks."""

import pytest
from pyspark.sql import functions as F

from traceloom.functions.saved import saved
from traceloom.operators import gates, native
from traceloom.sources.agent_tables import executions, observations, sources


@pytest.fixture(scope="module")
def tables(spark, data):
    return saved(executions(spark, data)), saved(observations(spark, data)), saved(sources(spark, data))


@pytest.fixture(scope="module")
def placed(tables):
    rows, seen, origins = tables
    told = saved(gates.suppression(origins, seen, rows))
    return saved(native.positions(native.admission(rows, seen, told), seen).join(told.select("source_id", "coverage", "unsupported_records"), "source_id")), told


def listed(df):
    return sorted((r.source_id, r.session_id, tuple(r.reasons)) for r in df.collect())


def test_blockers_read_their_rows_once(placed):
    plan = native.session_blockers(placed[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("width", [30, 1 << 20])
def test_one_pass_equals_proofs_and_places(tables, placed, width):
    rows, seen, _ = tables
    want = listed(native.session_blockers(placed[0]))
    assert len({r for *_, why in want for r in why}) > 5
    assert listed(native.session_blockers(placed[0], width)) == want
    assert listed(native.blockers_of(native.examined_sessions(rows, seen, width), placed[1])) == want


def test_neighbours_in_other_blocks(spark):
    """Places that overlap count if blocks without a placed row lie between."""
    rows = [(1, 1, 0, 0, 100, 5), (2, 1, 5, 0, 50, None), (3, 1, 90, 50, 120, 5), (4, 2, 0, 0, 10, 5), (5, 2, 90, 20, 30, 5)]
    df = spark.createDataFrame(rows, "id long, session_id long, byte_offset long, start_ms long, end_ms long, ok long").selectExpr(
        "*", "1L AS source_id", "'shell' AS kind", "'test' AS category", "'claude' AS provider", "'completed' AS status", "'success' AS outcome", "1L AS turn_id", "1L AS file_id", "'s' AS interval_scope", "'e' AS interval_evidence",
        "true AS admitted", "CASE WHEN ok IS NULL THEN 'x' END AS position_reason", "'evaluated' AS partition_status", "CAST(NULL AS string) AS suppressed", "'recognized_shapes' AS coverage", "0 AS unsupported_records",
    )
    for width in (1, 7, 1000):
        assert listed(native.session_blockers(df, width)) == [(1, 1, ("overlapping_actions", "unpositioned_action")), (1, 2, ())]
    assert native.session_blockers(df.where(F.lit(False))).count() == 0
