"""Predicates that decide whether a source, a session or a row may be measured at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.expr import first_reason
from traceloom.operators.blocks import WIDTH, running

#: The newest record format of each provider that is understood; all from 1 on are.
NEWEST = {"codex": 3, "claude": 4}


def suppression(sources: DataFrame, observations: DataFrame, events: DataFrame | None = None, related: DataFrame | None = None) -> DataFrame:
    """Adds ``suppressed``: the first reason that silences a source, or null.

    ``sources`` has source_id, availability, has_evidence, state_limited. Observations of
    ambiguous origin silence their source. The longer ladder, with ``events``, also looks at
    the source's provider, parser_version, diagnostics_dropped, ambiguous_records and what
    its capabilities state (capability_provider, capability_version); then at executions
    with a parent, or that a wrapper record names. In place of ``events``, ``related`` may
    tell of each source whether it has such (source_id, _related).
    """
    ambiguous = observations.groupBy("source_id").agg(F.bool_or(F.col("origin") == "ambiguous").alias("_ambiguous"))
    out = sources.join(ambiguous, "source_id", "left")
    limited, unclear = F.col("state_limited"), F.coalesce("_ambiguous", F.lit(False))
    if related is None and events is not None:
        wrappers = observations.where("o_provider = 'codex' AND representation = 'wrapper'").select("source_id", F.col("event_id").alias("id")).distinct().withColumn("_wrapped", F.lit(True))
        related = events.select("source_id", "id", "parent_id").join(wrappers, ["source_id", "id"], "left").groupBy("source_id").agg(F.bool_or(F.col("parent_id").isNotNull() | F.col("_wrapped").isNotNull()).alias("_related"))
    if related is not None:
        out = out.join(related, "source_id", "left")
        limited, unclear = limited | (F.col("diagnostics_dropped") > 0), unclear | (F.col("ambiguous_records") > 0)
    ladder = [(F.col("availability") != "available", "source_unavailable"), (~F.col("has_evidence"), "evidence_absent"), (limited, "state_limited"), (unclear, "ambiguous_origin")]
    if related is not None:
        newest = F.when(F.col("provider") == "codex", NEWEST["codex"]).otherwise(NEWEST["claude"])
        known = F.col("parser_version").between(1, newest) & (F.col("capability_provider") == F.col("provider")) & (F.col("capability_version") == F.col("parser_version"))
        ladder += [(~F.coalesce(known, F.lit(False)), "unsupported_contract"), (F.coalesce("_related", F.lit(False)), "unresolved_execution_relation")]
    return out.withColumn("suppressed", first_reason(*ladder)).drop("_ambiguous", "_related")


def poisoned(rows: DataFrame, keys: list[str], resolved: Column) -> DataFrame:
    """Adds ``poisoned``: one row that is not resolved silences its whole partition."""
    return rows.withColumn("poisoned", F.bool_or(~resolved).over(W.partitionBy(*keys)))


def propagate(rows: DataFrame, keys: list[str], flag: Column, order: str, width: int = WIDTH) -> DataFrame:
    """Adds ``ambiguous``: true from the first flagged row of a partition on."""
    return running(rows, keys, order, width, sums={"_flags": flag.cast("long")}).withColumn("ambiguous", F.col("_flags") > 0).drop("_flags")


def resolve_timing(rows: DataFrame) -> DataFrame:
    """Interval and duration of one known scope that differ by more than 1 ms conflict, and the weaker evidence goes.

    A duration without evidence or scope is null. An end before its start voids both. The
    start and end of an interval that goes stay, but their scope and evidence are unknown. A
    duration the source reports outranks an interval it doesn't; otherwise the duration goes,
    and the interval too unless the source reports it alone. What is pending has no end, no
    duration and no interval. Adds ``timing_conflict``.
    """
    reported = lambda c: F.col(c) == "source_reported"
    known = lambda *names: reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "unknown") for c in names])
    forward = F.coalesce(F.col("end_ms") >= F.col("start_ms"), F.lit(True))
    out = rows.withColumns({c: F.when(forward, F.col(c)) for c in ("start_ms", "end_ms")})
    timed = F.col("duration_ms").isNotNull() & known("duration_scope", "timing_evidence")
    placed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & known("interval_scope", "interval_evidence")
    out = out.withColumns({"_timed": timed, "_placed": placed})
    apart = F.abs(F.col("duration_ms") - (F.col("end_ms") - F.col("start_ms"))) > 1
    conflict = F.col("_timed") & F.col("_placed") & F.coalesce((F.col("duration_scope") == F.col("interval_scope")) & apart, F.lit(False))
    out = out.withColumn("timing_conflict", conflict)
    done = F.col("status") != "pending"
    keep_duration = F.col("_timed") & done & ~(F.col("timing_conflict") & ~(reported("timing_evidence") & ~reported("interval_evidence")))
    keep_interval = F.col("_placed") & done & ~(F.col("timing_conflict") & ~(reported("interval_evidence") & ~reported("timing_evidence")))
    out = out.withColumns({"_timed": keep_duration, "_placed": keep_interval, "end_ms": F.when(done, F.col("end_ms"))})
    named = {c: F.when(F.col(kept), F.col(c)).otherwise("unknown") for kept, names in (("_timed", ("duration_scope", "timing_evidence")), ("_placed", ("interval_scope", "interval_evidence"))) for c in names}
    return out.withColumns({"duration_ms": F.when(F.col("_timed"), F.col("duration_ms")), **named}).drop("_timed", "_placed")


def token_counts(rows: DataFrame) -> DataFrame:
    """Checks a usage row's components: parts within their whole, total the sum. What breaks a rule becomes null.

    Columns input, cached_input, output, reasoning_output, total; adds ``count_status``.
    """
    bad_cached, bad_reasoning = (F.coalesce(F.col(p) > F.col(w), F.lit(False)) for p, w in (("cached_input", "input"), ("reasoning_output", "output")))
    bad_total = F.coalesce(F.col("total") != F.col("input") + F.col("output"), F.lit(False))
    return rows.withColumn("count_status", F.when(bad_cached | bad_reasoning | bad_total, "invalid").otherwise("valid")).withColumn("cached_input", F.when(~bad_cached, F.col("cached_input"))).withColumn("reasoning_output", F.when(~bad_reasoning, F.col("reasoning_output"))).withColumn("total", F.when(~bad_total, F.col("total")))
