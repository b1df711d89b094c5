"""Which executions may be measured, and what proves them: classes, proofs, admission, timing, positions, blockers.

Executions have id, source_id, provider (of the source), event_provider, session_id,
turn_id, kind, tool_name, category, status, outcome, record_type, file_id, byte_offset,
and times with their scopes and evidence. Observations have o_id, event_id, source_id,
origin, representation, o_provider, o_session, o_file, o_at (offset), o_turn,
transport_status and, of provider B's results, is_error, completion_kind, observed_ms,
result_ms, result_scope, unassigned. source_id and id name an execution. All joins are equi-joins on
them; one execution has few observations. What a group of observations says is added to
the execution in the same aggregation, so that it is shuffled and joined once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.expr import SAFE, first_reason
from traceloom.operators.blocks import WIDTH

#: Kinds and tools of each provider whose executions are counted, and the category of each kind.
NATIVE = {
    "codex": (("shell", "exec_command"), ("mcp", "mcp"), ("file_edit", "apply_patch")),
    "claude": (("shell", "Bash"), ("file_read", "Read"), ("file_write", "Write"), ("file_edit", "Edit"), ("search", "Grep"), ("search", "Glob"), ("mcp", "mcp"), ("browser", "browser")),
}
CATEGORY_OF = {"file_read": "read", "file_write": "write", "file_edit": "edit", "search": "search", "mcp": "mcp", "browser": "browser"}
SHELL_CATEGORIES = ("test", "build", "search", "read", "other")
#: Kinds of actions nothing is known of, and shell categories that are understood.
OPAQUE, CLEAR_SHELL = ("other", "skill", "subagent", "mcp", "browser"), ("test", "build", "search", "read")

_KEYS = ["source_id", "id"]


def _is(condition: Column) -> Column:
    """Unknown counts as no."""
    return F.coalesce(condition, F.lit(False))


def class_reason() -> Column:
    """Why an execution's class is not counted; null if it is."""
    label = F.concat_ws("/", "provider", "kind", "tool_name")
    known = label.isin(*[f"{p}/{k}/{t}" for p, pairs in NATIVE.items() for k, t in pairs])
    expected = F.create_map(*[F.lit(x) for pair in CATEGORY_OF.items() for x in pair])[F.col("kind")]
    fits = F.when(F.col("kind") == "shell", F.col("category").isin(*SHELL_CATEGORIES)).otherwise(F.col("category") == expected)
    return first_reason((_is(F.col("kind") == "model") | _is(F.col("category") == "model"), "model"), (~known, "unsupported_call_class"), (~_is(fits), "inconsistent_category"))


def status_reason() -> Column:
    return F.when(F.col("status").isin("completed", "failed"), None).when(F.col("status").isin("pending", "cancelled"), F.col("status")).otherwise("unknown_status")


def linked(rows: DataFrame, seen: DataFrame, kinds: tuple[str, ...] = ("call", "result", "structured", "poll", "wrapper")) -> DataFrame:
    """Each execution with each of its observations, or once without; ``here`` says whether one is ordinary and at the execution's own place."""
    mine = seen.where(F.col("representation").isin(*kinds)).withColumnRenamed("event_id", "id")
    out = rows.join(mine, _KEYS, "left")
    return out.withColumn("here", _is((F.col("o_file") == F.col("file_id")) & (F.col("o_at") == F.col("byte_offset"))))


def _row(rows: DataFrame) -> Column:
    """The execution itself, the same in each row of its group."""
    return F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("_row")


def _foreign() -> Column:
    """An observation that can't be one of this execution."""
    return F.col("o_id").isNotNull() & ((F.col("origin") != "ordinary") | (F.col("o_provider") != F.col("provider")) | ((F.col("o_provider") == "claude") & ~_is(F.col("o_session") == F.col("session_id"))))


def _structured() -> Column:
    return (F.col("provider") == "codex") & _is(F.col("record_type") == "event_msg")


def _invocation_result() -> Column:
    """A result that is no acknowledgement, nor one of which it isn't known what it acknowledges."""
    return _is((F.col("representation") == "result") & (F.col("completion_kind") == "invocation_result") & ~F.coalesce("unassigned", F.lit(False)) & (F.col("is_error") == (F.col("status") == "failed")))


def _proofs(rows: DataFrame, seen: DataFrame, matches: Column, contradicts: Column) -> DataFrame:
    """Adds to each execution: whether something contradicts it, the least call, and the least decisive observation with what it says."""
    both = linked(rows, seen).withColumn("_own", F.col("o_id").isNotNull() & ~_foreign()).withColumn("_match", F.col("_own") & F.col("here") & _is(matches))
    against = _foreign() | (F.col("_own") & F.col("here") & contradicts & ~F.col("_match"))
    decisive = F.when(F.col("_match"), F.struct("o_id", "representation", "observed_ms", "result_ms", "result_scope"))
    found = both.groupBy(*_KEYS).agg(_row(rows), F.bool_or(against).alias("against"), F.min(F.when(F.col("_own") & (F.col("representation") == "call"), F.col("o_id"))).alias("call_id"), F.min(decisive).alias("decisive"))
    return found.select("_row.*", "against", "call_id", "decisive")


def _failure_votes() -> tuple[Column, Column]:
    """What an observation that is linked says of an end: that it is proven, and that it can't be right."""
    matches, contradicts = _failure_kinds()
    own = F.col("o_id").isNotNull() & ~_foreign()
    match = own & F.col("here") & _is(matches)
    return match, _foreign() | (own & F.col("here") & contradicts & ~match)


def failure_proofs(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds call_id, decisive and ``failure``: why an execution's end is not proven, or null.

    Only an observation at the execution's own place can decide. One at another place is
    neither proof nor contradiction. A call is needed too, but for structured records.
    """
    matches, contradicts = _failure_kinds()
    out = _proofs(rows, seen, matches, contradicts)
    wrong = F.col("against") | ~_is(F.col("event_provider") == F.col("provider")) | ~_is(_supported_record())
    lacking = F.col("decisive").isNull() | (~_structured() & F.col("call_id").isNull())
    return out.withColumn("failure", first_reason((wrong, "contradictory_provenance"), (lacking, "missing_provenance"))).drop("against")


def _supported_record() -> Column:
    return F.when(F.col("provider") == "claude", F.col("record_type") == "user").otherwise(F.col("record_type").isin("event_msg", "response_item"))


def _failure_kinds() -> tuple[Column, Column]:
    """Which observations decide an end, and which contradict it."""
    told = F.col("transport_status")
    structured = F.when(F.col("status") == "failed", (F.col("outcome") == "error") & (told == "failed")).when(F.col("outcome").isin("no_match", "change_detected"), (F.col("kind") == "shell") & (told == "failed")).otherwise(F.col("outcome").isin("success", "unknown") & (told == "completed"))
    plain = F.col("representation").isin("result", "poll") & (told == "unknown")
    matches = F.when(F.col("provider") == "claude", _invocation_result()).when(_structured(), (F.col("representation") == "structured") & structured).otherwise(plain)
    return matches, F.col("representation") != "call"


def slow_proofs(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """The same for durations, whose rules differ: a result must also agree in time, and only what could decide contradicts."""
    reported = F.col("timing_evidence") == "source_reported"
    agrees = _invocation_result() & _is(F.col("observed_ms") == F.col("end_ms")) & (~reported | _is((F.col("result_ms") == F.col("duration_ms")) & (F.col("result_scope") == F.col("duration_scope"))))
    structured = (F.col("representation") == "structured") & F.col("transport_status").isin("completed", "failed")
    matches = F.when(F.col("provider") == "claude", agrees).when(reported, structured).otherwise(F.col("representation").isin("result", "poll"))
    contradicts = F.when(F.col("provider") == "claude", F.col("representation") == "result").otherwise(reported & (F.col("representation") == "structured"))
    out = _proofs(rows, seen, matches, contradicts)
    latency = F.col("duration_scope") == "invocation_latency"
    direct = ((F.col("kind") == "shell") & (F.col("duration_scope") == "process_runtime")) | ((F.col("kind") == "mcp") & latency)
    supported = F.when(F.col("provider") == "claude", reported | latency).otherwise(F.when(reported, direct).otherwise(latency))
    needs_call = (F.col("provider") == "claude") | (F.col("timing_evidence") == "paired_timestamps")
    lacking = F.col("decisive").isNull() | (needs_call & F.col("call_id").isNull())
    wrong = F.col("against") | ~_is(F.col("event_provider") == F.col("provider"))
    return out.withColumn("failure", first_reason((wrong, "contradictory_provenance"), (~_is(supported), "unsupported_timing_representation"), (_is(lacking), "missing_provenance"))).drop("against")


def admission(rows: DataFrame, seen: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Adds ``exclusion``, the proof columns and ``partition_status`` of the session: one unproven end silences its session.

    ``suppressed`` has source_id and suppressed (a reason or null).
    """
    marked = rows.join(suppressed.select("source_id", "suppressed"), "source_id", "left")
    marked = marked.withColumn("exclusion", F.when(F.col("suppressed").isNotNull(), "source_suppressed").otherwise(F.coalesce(class_reason(), status_reason())))
    proven = failure_proofs(marked, seen)
    open_ = F.col("exclusion").isNull()
    sessions = proven.groupBy("source_id", "session_id").agg(F.bool_or(F.col("suppressed").isNotNull()).alias("_silent"), F.count_if(open_).alias("_n"), F.count_if(open_ & F.col("failure").isNotNull()).alias("_bad"))
    status = F.when(F.col("_silent"), "source_suppressed").when(F.col("_n") == 0, "no_eligible_events").when(F.col("_bad") > 0, "provenance_unresolved").otherwise("evaluated")
    out = proven.join(sessions.select("source_id", "session_id", status.alias("partition_status")), ["source_id", "session_id"])
    return out.withColumn("admitted", open_ & (F.col("partition_status") == "evaluated"))


def timing_reason() -> Column:
    """Why the duration of a proven execution is not measured; null if it is. Over the columns of ``failure_proofs``."""
    took, scope, told, by = F.col("duration_ms"), F.col("duration_scope"), F.col("timing_evidence"), F.col("decisive.representation")
    codex, reported = F.col("provider") == "codex", told == "source_reported"
    latency = scope == "invocation_latency"
    direct = _is(by == "structured") & (((F.col("kind") == "shell") & (scope == "process_runtime")) | ((F.col("kind") == "mcp") & latency))
    represented = F.when(codex & reported, direct).when(codex, latency & _is(by.isin("result", "poll"))).when(~reported, latency).otherwise(F.lit(True))
    same = _is((F.col("decisive.result_ms") == took) & (F.col("decisive.result_scope") == scope))
    paired = F.col("call_id").isNotNull() & _is((F.col("end_ms") >= F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") == took)) & (codex | _is(F.col("decisive.observed_ms") == F.col("end_ms")))
    return first_reason(
        (took.isNull(), "missing_duration"), ((took < 0) | (took > SAFE), "invalid_duration"), (scope == "unknown", "unknown_scope"), (told == "estimated", "estimated_timing"), (~told.isin("source_reported", "paired_timestamps"), "unknown_timing"),
        (~represented, "unsupported_timing_representation"), (F.when(reported, ~codex & ~same).otherwise(~paired), "missing_timing_provenance"),
    )


def _place_kinds() -> tuple[Column, Column]:
    """Whether an execution's interval is of a structured record, or of a call and its result."""
    structured = _structured() & (F.col("interval_scope") == "item_lifecycle") & (F.col("interval_evidence") == "source_reported")
    paired = (F.col("interval_scope") == "invocation_latency") & (F.col("interval_evidence") == "paired_timestamps") & (F.col("record_type") == F.when(F.col("provider") == "codex", "response_item").otherwise("user"))
    return _is(structured), _is(paired)


def _position_lacks() -> Column:
    """Whether an execution has no place whatever was observed of it."""
    structured, paired = _place_kinds()
    return F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") < F.col("start_ms")) | (~structured & ~paired)


def _position_votes() -> tuple[Column, Column, Column, Column]:
    """What an observation that is linked is to a place: its call, its end, a contradiction in turn or in time. Over ``_structured``."""
    own = F.col("o_id").isNotNull() & (F.col("origin") == "ordinary") & _is(F.col("o_file") == F.col("file_id"))
    call = own & (F.col("representation") == "call") & (F.col("o_at") < F.col("byte_offset"))
    end = own & F.col("here") & F.when(F.col("_structured"), F.col("representation") == "structured").otherwise(F.col("representation").isin("result", "poll"))
    same_turn = F.col("o_turn").eqNullSafe(F.col("turn_id"))
    bad_turn = (call & ~same_turn) | (end & ~same_turn & (F.col("_structured") | F.col("o_turn").isNotNull()))
    late = end & (F.col("o_provider") == "claude") & ~F.col("observed_ms").eqNullSafe(F.col("end_ms"))
    return call, end, bad_turn, late


def positions(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds ``position_reason``: why an execution has no proven place in time, or null."""
    structured, paired = _place_kinds()
    both = linked(rows.withColumn("_structured", structured).withColumn("_paired", paired), seen, ("call", "result", "structured", "poll"))
    call, end, bad_turn, late = _position_votes()
    # Of two contradictions the one met first in the order of offsets counts.
    first = F.min(F.when(bad_turn, F.struct("o_at", F.lit("contradictory_turn_proof").alias("why"))).when(late, F.struct("o_at", F.lit("contradictory_terminal_time").alias("why"))))
    found = both.groupBy(*_KEYS).agg(_row(rows), first.alias("_first"), F.bool_or(call).alias("_call"), F.bool_or(end).alias("_end"), F.first("_structured").alias("_structured"), F.first("_paired").alias("_paired"))
    out = found.select("_row.*", "_first", "_call", "_end", "_structured", "_paired")
    reason = first_reason(
        (F.col("start_ms").isNull() | F.col("end_ms").isNull(), "missing_boundaries"), (F.col("end_ms") < F.col("start_ms"), "invalid_boundaries"), (~F.col("_structured") & ~F.col("_paired"), "unsupported_interval"),
        (F.col("_first").isNotNull(), F.col("_first.why")), (~F.col("_end") | (F.col("_paired") & ~F.col("_call")), "missing_position_proof"),
    )
    return out.withColumn("position_reason", reason).drop("_first", "_call", "_end", "_structured", "_paired")


def _set(flags: dict[str, Column]) -> Column:
    """One number with a bit for each flag, in their order; unknown counts as no."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(flags.values())])


def _has(flags: dict[str, Column] | list[str], name: str, column: str) -> Column:
    return F.col(column).bitwiseAND(F.lit(1 << list(flags).index(name)).cast("long")) != 0


#: What only holds between neighbours of a session, in the order of its offsets.
_PAIRS = ["ambiguous_source_order", "overlapping_actions", "tied_or_contradictory_boundaries"]
_SEVERAL = {"inconsistent_source_file": ["file_id"], "mixed_interval_contracts": ["interval_scope", "interval_evidence"]}


def _neighbours(before: str, now: str) -> Column:
    """The bits of ``_PAIRS`` of two neighbours, which are structs of byte_offset, id, start_ms, end_ms."""
    b, n = (lambda c: F.col(f"{before}.{c}")), (lambda c: F.col(f"{now}.{c}"))
    held = [n("byte_offset") == b("byte_offset"), n("start_ms") < b("end_ms"), (n("start_ms") <= b("start_ms")) | (n("end_ms") <= b("end_ms"))]
    return _set(dict(zip(_PAIRS, held, strict=True)))


def _sessions(rows: DataFrame, placed: Column, flags: dict[str, Column], width: int, more: dict[str, Column] | None = None) -> DataFrame:
    """Per session: ``_flags`` (bits of ``flags`` that hold for a row), ``_pairs`` (of neighbours among the placed rows), several values of a placed row's columns, and maxima of ``more``.

    A row is shuffled once, as numbers and what its order needs, to a block of its session's
    offsets. A block leaves one row with its first and last place, and so do its rows that
    aren't placed; what lies between two blocks is settled over these.
    """
    more, several = more or {}, [c for cs in _SEVERAL.values() for c in cs]
    block = F.floor(F.col("byte_offset") / F.lit(float(width))).cast("long")
    bits = rows.withColumns({"_placed": _is(placed), "_flags": _set(flags), "_block": block} | {f"_more_{n}": c for n, c in more.items()})
    bits = bits.select("session_id", "source_id", "_block", "_placed", "_flags", "byte_offset", "id", "start_ms", "end_ms", *several, *[f"_more_{n}" for n in more])
    keys = ["session_id", "source_id", "_block", "_placed"]
    at = F.struct("byte_offset", "id", "start_ms", "end_ms")
    met = bits.withColumn("_at", at).withColumn("_before", F.when(F.col("_placed"), F.lag("_at").over(W.partitionBy(*keys).orderBy("byte_offset", "id"))))
    edge = F.when(F.col("_placed"), F.col("_at"))
    blocks = met.withColumn("_pairs", _neighbours("_before", "_at")).groupBy(*keys).agg(
        F.bit_or("_flags").alias("_flags"), F.bit_or("_pairs").alias("_pairs"), F.min(edge).alias("_first"), F.max(edge).alias("_last"),
        *[f(F.when(F.col("_placed"), F.col(c))).alias(f"{n}_{c}") for c in several for n, f in (("_min", F.min), ("_max", F.max))], *[F.max(f"_more_{n}").alias(f"_more_{n}") for n in more],
    )
    across = W.partitionBy("session_id", "source_id").orderBy("_placed", "_block")
    # Rows without a place come first, so a placed block's forerunner is placed or has no last place.
    joined = blocks.withColumn("_prior", F.lag("_last").over(across)).withColumn("_pairs", F.col("_pairs").bitwiseOR(_neighbours("_prior", "_first")))
    differ = {n: reduce(lambda a, b: a | b, [F.min(f"_min_{c}") != F.max(f"_max_{c}") for c in cs]) for n, cs in _SEVERAL.items()}
    return joined.groupBy("source_id", "session_id").agg(F.bit_or("_flags").alias("_flags"), F.bit_or("_pairs").alias("_pairs"), *[_is(c).alias(f"_{n}") for n, c in differ.items()], *[F.max(f"_more_{n}").alias(n) for n in more])


def _listed(named: dict[str, Column], *first: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*first, *[F.when(c, F.lit(n)) for n, c in named.items()]))).alias("reasons")


def _relevant() -> Column:
    return ~_is((F.col("kind") == "model") | (F.col("category") == "model"))


def _row_blockers() -> dict[str, Column]:
    """Reasons that an action gives whether it is admitted or not."""
    opaque = F.col("kind").isin(*OPAQUE) | ((F.col("kind") == "shell") & ~F.col("category").isin(*CLEAR_SHELL))
    edit = F.col("kind").isin("file_edit", "file_write")
    return {
        "opaque_action_in_stream": _relevant() & opaque, "unconfirmed_edit_effect": _relevant() & edit & ~((F.col("status") == "completed") & (F.col("outcome") == "success")),
        "missing_turn_identity": _relevant() & (F.col("provider") == "codex") & F.col("turn_id").isNull(),
    }


def _unclear_source() -> Column:
    return (F.col("coverage") != "recognized_shapes") | (F.col("unsupported_records") > 0)


def session_blockers(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per session the sorted reasons for which its order in time can't be used; an empty list if it can.

    Takes the columns of ``admission`` and ``positions``, and of the source suppressed,
    coverage and unsupported_records. A session is worked on in blocks of its offsets.
    """
    inside = _relevant() & F.col("admitted")
    flags = _row_blockers() | {
        "incomplete_temporal_context": _unclear_source(), "provenance_unresolved": F.col("partition_status") == "provenance_unresolved",
        "nonterminal_or_unadmitted_action": _relevant() & ~F.col("admitted"), "unpositioned_action": inside & F.col("position_reason").isNotNull(),
    }
    found = _sessions(rows, inside & F.col("position_reason").isNull(), flags, width, {"suppressed": F.col("suppressed")})
    named = {n: _has(flags, n, "_flags") for n in flags} | {n: _has(_PAIRS, n, "_pairs") for n in _PAIRS} | {n: F.col(f"_{n}") for n in _SEVERAL}
    return found.select("source_id", "session_id", _listed(named, F.col("suppressed")))


def examined_sessions(rows: DataFrame, seen: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per session, of its executions and what was observed of them, all that ``blockers_of`` needs of it.

    Proofs of ends and of places are found in one pass: a row goes through one join with
    its observations and one grouping, in which each observation is a number of bits. That
    a session is evaluated is known only at its end, so what depends on it is told of all
    executions of a countable class and end, and taken back for the others in ``blockers_of``.
    """
    open_ = class_reason().isNull() & status_reason().isNull()
    place, paired = _place_kinds()
    known = {"structured": _structured(), "placed_structured": place, "placed_paired": paired}
    own = {
        "open": open_, "relevant": _relevant(), "unopened": _relevant() & ~open_, "wrong": ~_is(F.col("event_provider") == F.col("provider")) | ~_is(_supported_record()),
        "nowhere": _position_lacks(), "related": F.col("parent_id").isNotNull(), **known, **_row_blockers(),
    }
    carried = ["id", "source_id", "session_id", "byte_offset", "start_ms", "end_ms", "file_id", "interval_scope", "interval_evidence"]
    asked = ["provider", "turn_id", "status", "outcome", "kind", "record_type"]
    mine = rows.select(*carried, *asked, _set(own).alias("_own")).withColumns({"_structured": _has(own, "placed_structured", "_own"), "_paired": _has(own, "placed_paired", "_own")})
    both = linked(mine, seen)
    match, against = _failure_votes()
    call, end, bad_turn, late = _position_votes()
    votes = {
        "match": match, "against": against, "call": ~_foreign() & F.col("o_id").isNotNull() & (F.col("representation") == "call"), "place_call": call, "place_end": end, "misplaced": bad_turn | late,
        "wrapped": F.col("o_id").isNotNull() & (F.col("o_provider") == "codex") & (F.col("representation") == "wrapper"),
    }
    # Grouped by what the execution carries, all of it numbers and short names: it is the same in each row of an execution.
    met = both.withColumn("_votes", _set(votes)).groupBy(*carried, "_own").agg(F.bit_or("_votes").alias("_votes"))
    has, told = (lambda n: _has(own, n, "_own")), (lambda n: _has(votes, n, "_votes"))
    failed = told("against") | has("wrong") | ~told("match") | (~has("structured") & ~told("call"))
    unplaced = has("nowhere") | told("misplaced") | ~told("place_end") | (has("placed_paired") & ~told("place_call"))
    rated = has("open") & has("relevant")
    flags = {n: has(n) for n in ("open", "relevant", "unopened", *_row_blockers())} | {"unproven": has("open") & failed, "unpositioned": rated & unplaced, "related": has("related") | told("wrapped")}
    return _sessions(met, rated & ~unplaced, flags, width).withColumns({f"is_{n}": _has(flags, n, "_flags") for n in flags} | {n: _has(_PAIRS, n, "_pairs") for n in _PAIRS}).withColumnsRenamed({f"_{n}": n for n in _SEVERAL}).drop("_flags", "_pairs")


def blockers_of(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """The result of ``session_blockers`` from ``examined_sessions`` and, for each source, suppressed, coverage and unsupported_records."""
    out = sessions.join(sources.select("source_id", "suppressed", "coverage", "unsupported_records"), "source_id")
    heard = F.col("suppressed").isNull() & F.col("is_open")
    evaluated = heard & ~F.col("is_unproven")
    named = {n: F.col(f"is_{n}") for n in _row_blockers()} | {
        "incomplete_temporal_context": _unclear_source(), "provenance_unresolved": heard & F.col("is_unproven"),
        "nonterminal_or_unadmitted_action": F.when(evaluated, F.col("is_unopened")).otherwise(F.col("is_relevant")), "unpositioned_action": evaluated & F.col("is_unpositioned"),
    }
    named |= {n: evaluated & F.col(n) for n in (*_PAIRS, *_SEVERAL)}
    return out.select("source_id", "session_id", _listed(named, F.col("suppressed")))
