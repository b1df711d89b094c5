"""Usage out of records: growth, repeats, conflicts, parts that lack or don't fit."""

import json

import pytest

from traceloom.operators import usage


def frame(spark, records):
    return spark.createDataFrame([("s", k, 100 * k, json.dumps(r)) for k, r in enumerate(records)], "source_id string, ordinal long, byte_offset long, raw string").repartition(3)


def said(uuid, used, response="m", content="x", **more):
    return {"type": "assistant", "uuid": uuid, "sessionId": "a", "message": {"id": response, "content": content, "usage": used} | more}


def full(n):
    return {"input_tokens": 5, "output_tokens": n, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}


def one(spark, records):
    rows = usage.claude_usage(frame(spark, records)).collect()
    assert len(rows) == 1
    return rows[0]


def test_a_growing_response_keeps_its_last_record(spark):
    r = one(spark, [said("a", full(1)), said("b", full(7)), said("c", full(20), stop_reason="end_turn"), said("a", full(1))])
    assert (r.counts.output, r.counts.input, r.counts.total, r.selection, r.records, r.stop_reason) == (20, 10, 30, "provisional", 3, "end_turn")


def test_a_message_with_other_content_conflicts(spark):
    r = one(spark, [said("a", full(1)), said("a", full(1), content="y"), said("b", full(2))])
    assert (r.counts, r.selection, r.conflicted) == (None, "conflicted", True)
    two = {r.response_id: r.conflicted for r in usage.claude_usage(frame(spark, [said("a", full(1)), said("a", full(1), response="n", content="y")])).collect()}
    assert two == {"m": False, "n": True}


@pytest.mark.parametrize(("used", "status", "counts"), [
    ({"input_tokens": 5}, "partial", (None, 5, None, None)), (full(7), "complete", (10, 5, 7, 17)), (full("7"), "invalid", (10, 5, None, None)), (full(-1), "invalid", (10, 5, None, None)), (full(1.5), "invalid", (10, 5, None, None)),
    (full(None), "partial", (10, 5, None, None)), (full(2**53), "invalid", (10, 5, None, None)), (full(2**53 - 5), "invalid", (10, 5, 2**53 - 5, None)), ({}, "partial", (None,) * 4), ("text", "invalid", (None,) * 4), (None, "invalid", (None,) * 4), (full(0), "complete", (10, 5, 0, 10)),
])
def test_counts_of_the_second_provider(spark, used, status, counts):
    r = one(spark, [said("a", used)])
    assert (r.count_status, (r.counts.input, r.counts.uncached_input, r.counts.output, r.counts.total)) == (status, counts)
    assert r.selection == ("invalid" if status == "invalid" else "provisional")


def test_responses_without_id_or_message(spark):
    rows = usage.claude_usage(frame(spark, [said(None, full(1), response=None), said(None, full(1), response=None), said("a", full(1), response=None), said("a", full(1), response=None)])).collect()
    assert len(rows) == 3 and {r.selection for r in rows} == {"invalid"}
    assert usage.claude_usage(frame(spark, [{"type": "user"}, said("a", full(1)) | {"type": "system"}])).count() == 0


def meta(version="0.157.0", **more):
    return {"type": "session_meta", "payload": {"id": "s1", "cli_version": version} | more}


def used(counts, response="r", **more):
    return {"type": "token_usage_record", "payload": {"response_id": response, "usage": counts} | more}


def codex(spark, records):
    return {r.response_id: r for r in usage.codex_usage(frame(spark, records)).collect()}


COUNTS = {"input_tokens": 9, "output_tokens": 4, "cached_input_tokens": 3, "cache_write_input_tokens": 2, "reasoning_output_tokens": 1, "total_tokens": 13}


@pytest.mark.parametrize(("change", "status", "lost"), [
    ({}, "complete", ()), ({"cached_input_tokens": 10}, "invalid", ("cached_input",)), ({"cache_write_input_tokens": 10}, "invalid", ("cache_write_input",)), ({"cached_input_tokens": 8}, "invalid", ("cached_input", "cache_write_input")),
    ({"reasoning_output_tokens": 5}, "invalid", ("reasoning_output",)), ({"total_tokens": 99}, "invalid", ("total",)), ({"input_tokens": None}, "partial", ("input", "total")), ({"total_tokens": None}, "partial", ("total",)),
])
def test_parts_of_verified_programs_fit(spark, change, status, lost):
    r = codex(spark, [meta(), used(COUNTS | change)])["r"]
    assert r.count_status == status and {k for k, v in r.counts.asDict().items() if v is None} == set(lost)
    assert r.selection == ("invalid" if status == "invalid" else "provisional" if "input" in lost else "eligible")


def test_other_programs_and_sessions(spark):
    r = codex(spark, [meta("1.0"), used(COUNTS | {"cached_input_tokens": 99})])["r"]
    assert (r.count_status, r.counts.cached_input, r.counts.total, r.selection, r.final) == ("partial", 99, None, "provisional", False)
    got = codex(spark, [meta(), used(COUNTS, "a"), meta(id="s2"), used(COUNTS, "b"), used(COUNTS, "a"), used(COUNTS, "c"), used(COUNTS | {"output_tokens": 5}, "c"), used(COUNTS, "d", turn_id="1"), used(COUNTS, "d", turn_id="2")])
    assert {k: r.selection for k, r in got.items()} == {"a": "eligible", "b": "provisional", "c": "conflicted", "d": "conflicted"}
    assert got["c"].counts is None and got["a"].records == 2
