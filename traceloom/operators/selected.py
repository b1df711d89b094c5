"""Analyses of chosen sources: operations that may be retried, turns that prove active time, usage by day, scans.

The columns are those of ``operators.native``. Every rule counts what it leaves out by
reason, and one unclear attempt silences its whole operation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.expr import SAFE, complete_sum, first_reason
from traceloom.functions.saved import saved
from traceloom.operators import intervals, native, sequences
from traceloom.operators.blocks import WIDTH, running

_KEYS = ["source_id", "id"]
_SESSION = ["source_id", "session_id"]
_OPERATION = [*_SESSION, "turn_id", "op_key"]
_DAY = 86_400_000


def _is(condition: Column) -> Column:
    """Unknown counts as no."""
    return F.coalesce(condition, F.lit(False))


def _reasons(named: dict[str, Column]) -> Column:
    """The names whose column is true, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()])))


def attempts(admitted: DataFrame, seen: DataFrame) -> DataFrame:
    """Attempts at operations with what their place in time lacks: admitted executions and op_key in, flags ``no_*`` and ``placed`` out."""
    mine = admitted.where("(kind = 'shell' AND tool_name = 'exec_command') OR (kind = 'mcp' AND tool_name = 'mcp')")
    structured = _is((F.col("interval_scope") == "item_lifecycle") & (F.col("interval_evidence") == "source_reported") & (F.col("record_type") == "event_msg"))
    paired = _is((F.col("interval_scope") == "invocation_latency") & (F.col("interval_evidence") == "paired_timestamps") & (F.col("record_type") == "response_item"))
    both = native.linked(mine.withColumn("_st", structured).withColumn("_pa", paired), seen, ("call", "result", "structured", "poll"))
    call = F.col("_pa") & _is((F.col("representation") == "call") & (F.col("o_file") == F.col("file_id")) & (F.col("o_at") < F.col("byte_offset")))
    own = _is((F.col("origin") == "ordinary") & (F.col("o_file") == F.col("file_id")))
    same = F.col("o_turn").eqNullSafe(F.col("turn_id"))
    end = own & F.col("here") & F.when(F.col("_st"), F.col("representation") == "structured").otherwise(F.col("representation").isin("result", "poll"))
    bad = (own & call & ~same) | (end & ~same & (F.col("_st") | F.col("o_turn").isNotNull()))
    # The execution goes with its group, so that it need not be joined back.
    row = F.first(F.struct(*mine.columns, "_st", "_pa")).alias("_row")
    found = both.groupBy(*_KEYS).agg(row, F.bool_or(bad).alias("_bad"), F.bool_or(end).alias("_end"), F.bool_or(own & call & same).alias("_call"), F.bool_or(call).alias("_any"))
    out = found.select("_row.*", "_bad", "_end", "_call", "_any")
    bounds = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    valid = bounds & (F.col("end_ms") >= F.col("start_ms"))
    fits = valid & (F.col("_st") | F.col("_pa"))
    lacks = F.col("_pa") & ~F.col("_call")
    flags = {
        "missing_boundaries": ~bounds, "invalid_boundaries": bounds & ~_is(valid), "unsupported_interval": valid & ~F.col("_st") & ~F.col("_pa"), "contradictory_turn_proof": fits & F.col("_bad"), "missing_terminal_proof": fits & ~F.col("_end"),
        "missing_turn_proof": fits & lacks & F.col("_any"), "missing_call_before_result": fits & lacks & ~F.col("_any"),
    }
    out = out.withColumns({f"no_{n}": F.col("admitted") & _is(c) for n, c in flags.items()})
    return out.withColumn("placed", F.col("admitted") & ~reduce(lambda a, b: a | b, [F.col(f"no_{n}") for n in flags])).drop("_st", "_pa", "_bad", "_end", "_call", "_any")


def operations(tried: DataFrame) -> DataFrame:
    """One row for each operation of a turn: keys, attempts, known_failed, and the sorted reasons for which its order can't be told.

    What blocks a session (``session_unavailable``): a suppressed source, another provider,
    an unproven end, an attempt without operation or turn.
    """
    order = W.partitionBy(*_OPERATION).orderBy("byte_offset", "id")
    known = tried.where("op_key IS NOT NULL AND turn_id IS NOT NULL")
    known = known.withColumns({f"_{c}": F.lag(c).over(order) for c in ("byte_offset", "start_ms", "end_ms", "placed")})
    both = F.col("placed") & _is(F.col("_placed"))
    status, error = F.col("status"), (F.col("status") == "failed") & (F.col("outcome") == "error")
    per_row = {
        "terminal_not_admitted": ~F.col("admitted"), "pending_attempt": status == "pending", "cancelled_attempt": status == "cancelled", "unknown_status": ~status.isin("pending", "cancelled", "failed", "completed"),
        "unconfirmed_outcome": status.isin("failed", "completed") & ~error & ~((status == "completed") & (F.col("outcome") == "success")), "ambiguous_source_order": F.col("byte_offset") == F.col("_byte_offset"),
        "tied_boundaries": both & ((F.col("start_ms") == F.col("_start_ms")) | (F.col("end_ms") == F.col("_end_ms"))), "source_time_order_conflict": both & ((F.col("start_ms") < F.col("_start_ms")) | (F.col("end_ms") < F.col("_end_ms"))), "overlapping_attempts": both & (F.col("start_ms") < F.col("_end_ms")),
    } | {c[3:]: F.col(c) for c in tried.columns if c.startswith("no_")}
    several = {"operation_class_conflict": (F.lit(True), ["kind", "category", "tool_name"]), "mixed_interval_evidence": (F.col("placed"), ["interval_scope", "interval_evidence"]), "inconsistent_source_file": (F.lit(True), ["file_id"])}
    spread = {n: F.min(F.when(w, F.struct(*c))) != F.max(F.when(w, F.struct(*c))) for n, (w, c) in several.items()}
    named = {n: F.bool_or(_is(c)) for n, c in per_row.items()} | {n: _is(c) for n, c in spread.items()}
    groups = known.groupBy(*_OPERATION).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("admitted") & error).alias("known_failed"), *[c.alias(f"_{n}") for n, c in named.items()])
    blocked = F.bool_or(F.col("suppressed").isNotNull() | (F.col("provider") != "codex") | (F.col("partition_status") == "provenance_unresolved") | F.col("op_key").isNull() | F.col("turn_id").isNull())
    out = groups.join(tried.groupBy(*_SESSION).agg(blocked.alias("_session_unavailable")), _SESSION)
    return out.select(*_OPERATION, "attempts", "known_failed", _reasons({n: F.col(f"_{n}") for n in ("session_unavailable", *named)}).alias("reasons"))


def operation_chains(tried: DataFrame, grouped: DataFrame) -> DataFrame:
    """Recovery chains of the operations without a reason against them."""
    clear = tried.join(grouped.where(F.size("reasons") == 0).select(*_OPERATION), _OPERATION, "left_semi")
    return sequences.recovery_chains(clear, _OPERATION, F.col("status") == "failed", F.col("status") == "completed", "byte_offset")


def failed_duration_reason() -> Column:
    """Why the duration of a failed attempt of a chain isn't measured; null if it is."""
    took, scope, told = F.col("duration_ms"), F.col("duration_scope"), F.col("timing_evidence")
    reported = told == "source_reported"
    direct = _is((F.col("record_type") == "event_msg") & (((F.col("kind") == "shell") & (scope == "process_runtime")) | ((F.col("kind") == "mcp") & (scope == "invocation_latency"))))
    paired = _is((scope == "invocation_latency") & (F.col("record_type") == "response_item"))
    return first_reason(
        (took.isNull(), "missing_duration"), ((took < 0) | (took > SAFE), "invalid_duration"), (scope == "unknown", "unknown_scope"), (told == "estimated", "estimated_timing"), (~told.isin("source_reported", "paired_timestamps"), "unknown_timing"),
        (F.when(reported, ~direct).otherwise(~paired), "unsupported_timing_representation"), (~reported & (F.col("end_ms") - F.col("start_ms") != took), "missing_timing_provenance"),
    )


def retry_attempts(tried: DataFrame, grouped: DataFrame, width: int = WIDTH) -> DataFrame:
    """The failed attempts of proven chains, each with its chain and ``why`` its duration isn't measured."""
    clear = tried.join(grouped.where(F.size("reasons") == 0).select(*_OPERATION), _OPERATION, "left_semi")
    done = _is((F.col("status") == "completed") & (F.col("outcome") == "success"))
    placed = running(clear, _OPERATION, "byte_offset", width, sums={"chain": done.cast("long")}, inclusive=False)
    return placed.where("status = 'failed'").withColumn("why", failed_duration_reason())


def retry_chains(failed: DataFrame) -> DataFrame:
    """Per chain: failed, measured, the sum of their durations if it can be told, and the union of their intervals."""
    keys = [*_OPERATION, "chain"]
    told = _durations(failed, keys)
    return told.join(intervals.union_length(failed, keys).select(*keys, F.col("union_ms").alias("retry_overhead_ms")), keys)


def _durations(failed: DataFrame, keys: list[str]) -> DataFrame:
    """failed_n, measured_n, duration_sum_ms and why there is none. Durations of several scopes or kinds of evidence are never added."""
    kind = F.when(F.col("why").isNull(), F.struct("session_id", "duration_scope", "timing_evidence"))
    told = failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_n"), F.count_if(F.col("why").isNull()).alias("measured_n"), F.sum(F.when(F.col("why").isNull(), F.col("duration_ms"))).cast("long").alias("_sum"), (F.min(kind) != F.max(kind)).alias("_mixed"))
    reason = first_reason((F.col("measured_n") < F.col("failed_n"), "incomplete_duration_coverage"), (_is(F.col("_mixed")), "incompatible_duration_cohorts"), (F.col("_sum") > SAFE, "numeric_overflow"))
    return told.select(*keys, "failed_n", "measured_n", F.when(reason.isNull(), F.col("_sum")).alias("duration_sum_ms"), reason.alias("duration_reason"))


def retry_overhead(tried: DataFrame, grouped: DataFrame, sources: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per source (source_id, usable): chains, failed and measured attempts, the sum of durations and the time of failed attempts.

    Attempts of all chains of a partition (session, interval scope and evidence) are united
    again, never added. More than one partition has no total; no chain at all is 0.
    """
    failed = saved(retry_attempts(tried, grouped, width))
    part = ["source_id", "session_id", "interval_scope", "interval_evidence"]
    spent = intervals.union_length(failed, part).groupBy("source_id").agg(F.count(F.lit(1)).alias("_parts"), F.min("union_ms").alias("_union"))
    chains = failed.select(*_OPERATION, "chain").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("chain_n"))
    out = sources.join(_durations(failed, ["source_id"]), "source_id", "left").join(spent, "source_id", "left").join(chains, "source_id", "left")
    ok, none = F.col("usable"), F.col("_parts").isNull()
    counts = {c: F.when(ok, F.coalesce(c, F.lit(0))).cast("long") for c in ("chain_n", "failed_n", "measured_n")}
    several = F.col("_parts") > 1
    return out.select(
        "source_id", *[v.alias(c) for c, v in counts.items()], F.when(ok, F.when(none, F.lit(0)).otherwise(F.col("duration_sum_ms"))).cast("long").alias("duration_sum_ms"), F.when(~ok, "recovery_unavailable").otherwise(F.col("duration_reason")).alias("duration_reason"),
        F.when(ok & ~_is(several), F.coalesce("_union", F.lit(0))).cast("long").alias("retry_overhead_ms"), F.when(~ok, "recovery_unavailable").when(several, "incompatible_interval_partitions").alias("retry_overhead_reason"),
    )


def turn_reasons(turns: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds ``reason``: why a turn's times don't count as active time, or null.

    turns: source_id, id, provider, status, start_ms, end_ms, scope, evidence, file_id,
    byte_offset. seen: source_id, turn_id, origin, o_status, o_file, o_at. A turn needs an
    observed end at its own place and, if its times are paired, an observed start before it.
    """
    both = turns.join(seen.withColumnRenamed("turn_id", "id"), _KEYS, "left")
    last = F.col("o_status").isin("completed", "cancelled", "failed")
    own = _is((F.col("origin") == "ordinary") & (F.col("o_file") == F.col("source_id")) & (F.col("o_file") == F.col("file_id")))
    found = both.groupBy(*_KEYS).agg(
        F.bool_or(_is(last & (F.col("o_status") != F.col("status")))).alias("_against"), F.bool_or(_is(last & own & (F.col("o_at") == F.col("byte_offset")))).alias("_end"),
        (F.min(F.when(own & (F.col("o_status") == "pending"), F.col("o_at"))) < F.min(F.when(own & last, F.col("o_at")))).alias("_begun"),
    )
    contract = F.when(F.col("scope") == "turn_wall", "source_reported").when(F.col("scope") == "observed_turn", "paired_timestamps")
    why = first_reason(
        (F.col("provider") != "codex", "unsupported_provider"), (F.col("status") == "pending", "pending"), (~F.col("status").isin("completed", "cancelled"), "unknown_status"), (F.col("start_ms").isNull() | F.col("end_ms").isNull(), "missing_boundaries"),
        (F.col("evidence") == "estimated", "estimated_timing"), ((F.col("scope") == "unknown") | (F.col("evidence") == "unknown"), "unknown_interval"), (~_is(F.col("evidence") == contract), "inconsistent_interval"), (F.col("end_ms") < F.col("start_ms"), "invalid_boundaries"),
        (F.col("_against"), "contradictory_terminal_proof"), (~F.col("_end"), "missing_terminal_proof"), ((F.col("scope") == "observed_turn") & ~_is(F.col("_begun")), "missing_pending_proof"),
    )
    return turns.join(found, _KEYS).withColumn("reason", why).drop("_against", "_end", "_begun")


def usage_history(copies: DataFrame, seen: DataFrame, counts: list[str], from_ms: int, to_ms: int) -> DataFrame:
    """One row for each response of a session: copies, reason, state, selection, first_seen_ms and its counts.

    copies: source_id, usage_id, session_id, response_id, scope, selection, finality, counts.
    seen: source_id, usage_id, origin, o_finality, o_<count>, seen_ms. Copies of one
    response in several sources are one; if they differ it is withheld. An ordinary
    observation with equal counts and finality proves it and gives its time; a final one
    with others contradicts. Final and provisional responses are never mixed. Rows that
    are no response (cumulative, or without response id) are left out before.
    """
    rows = copies.where((F.col("scope") == "response") & F.col("response_id").isNotNull())
    both = rows.join(seen.where("origin = 'ordinary'"), ["source_id", "usage_id"], "left")
    equal = reduce(lambda a, b: a & b, [F.col(f"o_{c}").eqNullSafe(F.col(c)) for c in counts]) & _is(F.col("o_finality") == F.col("finality"))
    payload = F.struct("selection", "finality", *counts)
    out = both.groupBy("session_id", "response_id").agg(
        F.countDistinct("source_id", "usage_id").alias("copies"), (F.min(payload) != F.max(payload)).alias("_differ"), F.min(payload).alias("_payload"), F.bool_or(F.col("o_finality").isNotNull() & equal).alias("_proven"),
        F.bool_or(_is(F.col("o_finality").isin("source_terminal", "trusted_final")) & ~equal).alias("_against"), F.min(F.when(F.col("o_finality").isNotNull() & equal, F.col("seen_ms"))).alias("first_seen_ms"),
    )
    chosen = F.col("_payload.selection")
    why = first_reason((F.col("_differ"), "response_conflict"), (chosen.isin("invalid", "conflicted"), chosen), (~chosen.isin("eligible", "provisional"), "unverified_selection"), (F.col("_against"), "terminal_observation_conflict"), (~F.col("_proven"), "missing_usage_proof"))
    out = out.withColumn("reason", why)
    at, held = F.col("first_seen_ms"), F.col("reason").isNotNull()
    state = F.when(held, "excluded").when(at.isNull(), "undated").when((at < from_ms) | (at >= to_ms), "outside_window").otherwise("dated")
    return out.select(
        "session_id", "response_id", "copies", "reason", state.alias("state"), F.when(~held, F.when(chosen == "eligible", "final").otherwise("provisional")).alias("selection"),
        F.when(~held, at).alias("first_seen_ms"), *[F.when(~held, F.col(f"_payload.{c}")).alias(c) for c in counts],
    )


def usage_history_days(responses: DataFrame, counts: list[str], offset_minutes: int = 0) -> DataFrame:
    """Dated responses by day of a fixed offset, session and selection; one unknown count makes its sum unknown."""
    day = F.floor((F.col("first_seen_ms") + offset_minutes * 60_000) / F.lit(float(_DAY))).cast("long").alias("day")
    return responses.where("state = 'dated'").groupBy(day, "session_id", "selection").agg(F.count(F.lit(1)).alias("responses"), *[complete_sum(F.col(c)).alias(c) for c in counts])


def scan_outcomes(listed: DataFrame, stored: DataFrame, page: int = 16) -> DataFrame:
    """What a scan does with each source: status, reused or committed revision, how often it was listed, and whether a paged scan gets to it.

    listed: path, source_id, digest, rejected. stored: source_id, expected (revision when
    read), actual (revision when written), stored_digest, current (can be compared). A
    source listed twice is taken once. Equal content confirms the stored revision and
    writes nothing. A paged scan takes sources by path, ``page`` at a time, and stops after
    the first page with one that is neither committed nor unchanged; the end of that page
    is found by a count and a bounded top-k, not by ranking all sources.
    """
    once = listed.groupBy("source_id").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("listings"), F.min_by("digest", "path").alias("digest"), F.min_by("rejected", "path").alias("rejected"))
    both = once.join(stored, "source_id", "left")
    equal, moved = _is(F.col("current") & (F.col("digest") == F.col("stored_digest"))), _is(F.col("actual") != F.col("expected"))
    status = F.when(F.col("rejected") & ~equal, "rejected").when(moved, "stale").when(equal, "unchanged").otherwise("committed")
    out = both.withColumn("status", status)
    first = out.where("status NOT IN ('committed', 'unchanged')").agg(F.min("path").alias("_stop"))
    before = out.join(F.broadcast(first), F.col("path") < F.col("_stop")).agg(F.count(F.lit(1)).alias("_before"))
    rest = out.select("path").join(F.broadcast(first), F.col("path") >= F.col("_stop")).select("path").orderBy("path").limit(page)
    place = F.row_number().over(W.orderBy("path"))
    ends = rest.withColumn("_place", place).join(F.broadcast(before)).where(F.col("_place") <= page - F.col("_before") % page).agg(F.max("path").alias("_last"))
    return out.join(F.broadcast(ends)).select(
        "source_id", "status", F.when(F.col("status") == "unchanged", F.col("expected")).alias("reused"), F.when(F.col("status") == "committed", F.coalesce("expected", F.lit(0)) + 1).cast("long").alias("revision"),
        "listings", F.coalesce(F.col("path") <= F.col("_last"), F.lit(True)).alias("in_pages"),
    )
