"""Copies of events across sources, and calendar days."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators import intervals

DAY = intervals.DAY


def parse_offset(text: str) -> int:
    """Minutes of a fixed offset such as +05:30, at most 14 hours; -00:00 is refused."""
    m = re.fullmatch(r"([+-])(\d{2}):(\d{2})", text)
    if not m or text == "-00:00" or int(m[3]) > 59:
        raise ValueError(f"not a fixed offset: {text!r}")
    minutes = (int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1)
    if abs(minutes) > 14 * 60:
        raise ValueError(f"beyond 14 hours: {text!r}")
    return minutes


#: A strict UTC time, and the days that a period may have.
_UTC = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z", re.ASCII)
MOST_DAYS = 366


def parse_period(start: str, end: str) -> tuple[int, int]:
    """Milliseconds of a period [start, end) of strict UTC times that exist; it isn't empty and has at most 366 days."""
    bounds = []
    for text in (start, end):
        if not isinstance(text, str) or not _UTC.fullmatch(text):
            raise ValueError(f"not a UTC time: {text!r}")
        moment = datetime.fromisoformat(text[:-1]).replace(tzinfo=UTC)  # refuses days and hours that don't exist
        bounds.append((moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1))
    if not 0 < bounds[1] - bounds[0] <= MOST_DAYS * DAY:
        raise ValueError(f"a period has more than 0 and at most {MOST_DAYS} days")
    return bounds[0], bounds[1]


def reconcile(copies: DataFrame, keys: list[str], signature: list[str], admitted: str, position: list[str], carry: bool = False) -> DataFrame:
    """One row for each event seen in one or more sources, and its state.

    In this order: conflict, if copies differ in meaning or only some are admitted;
    excluded, if none is; unpositioned, if one lacks a position (any column of it null);
    conflict, if positions differ; else admitted. With ``carry`` the columns of signature
    and position come along, in which all copies of an admitted event are equal, so that
    nothing need be joined back.
    """
    placed = F.lit(True)
    for c in position:
        placed = placed & F.col(c).isNotNull()
    whole = F.struct(*signature, *position)
    grouped = copies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), (F.min(F.struct(*signature)) != F.max(F.struct(*signature))).alias("_s"), F.count_if(admitted).alias("_in"), F.count_if(~placed).alias("_nowhere"), (F.min(F.struct(*position)) != F.max(F.struct(*position))).alias("_p"), *([F.min(whole).alias("_whole")] if carry else []),
    )
    partly = (F.col("_in") > 0) & (F.col("_in") < F.col("copies"))
    state = F.when(F.col("_s") | partly, "conflict").when(F.col("_in") == 0, "excluded").when(F.col("_nowhere") > 0, "unpositioned").when(F.col("_p"), "conflict").otherwise("admitted")
    return grouped.withColumn("state", state).select(*keys, "copies", "state", *([F.col(f"_whole.{c}") for c in (*signature, *position)] if carry else []))


def days(rows: DataFrame, from_ms: int, to_ms: int, offset_minutes: int = 0) -> DataFrame:
    """Per day of a fixed offset in [from_ms, to_ms): completions by their end, and busy time cut at midnights and the period's ends."""
    shift = offset_minutes * 60_000
    done = rows.where((F.col("end_ms") >= from_ms) & (F.col("end_ms") < to_ms)).groupBy(F.floor((F.col("end_ms") + shift) / F.lit(float(DAY))).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("completions"))
    parts = intervals.split_days(intervals.clip(rows, from_ms, to_ms), offset_minutes)
    busy = intervals.islands(parts, ["session_id", "day"]).groupBy("day").agg(F.sum(F.col("hi") - F.col("lo")).alias("busy_ms"))
    return done.join(busy, "day", "full_outer").select("day", F.coalesce("completions", F.lit(0).cast("long")).alias("completions"), F.coalesce("busy_ms", F.lit(0).cast("long")).alias("busy_ms"))


def _chosen(reconciled: DataFrame, session: int | None) -> DataFrame:
    """Admitted events; the session filter comes after all copies were compared, so it can't hide a conflict."""
    kept = reconciled.where("state = 'admitted'")
    return kept if session is None else kept.where(F.col("session_id") == session)


def session_days(reconciled: DataFrame, from_ms: int, to_ms: int, offset_minutes: int = 0, session: int | None = None) -> DataFrame:
    """Completed and failed executions by the day of their end, provider and session; ``reconciled`` carries its columns."""
    day = F.floor((F.col("end_ms") + offset_minutes * 60_000) / F.lit(float(DAY))).cast("long").alias("day")
    ended = _chosen(reconciled, session).where((F.col("end_ms") >= from_ms) & (F.col("end_ms") < to_ms))
    return ended.groupBy(day, "provider", "session_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def busy_days(reconciled: DataFrame, from_ms: int, to_ms: int, offset_minutes: int = 0, session: int | None = None) -> DataFrame:
    """Time of the same executions, cut at midnights and the period's ends; sessions, scopes and evidence are never mixed."""
    keys = ["day", "provider", "session_id", "interval_scope", "interval_evidence"]
    parts = intervals.split_days(intervals.clip(_chosen(reconciled, session), from_ms, to_ms), offset_minutes)
    return intervals.union_length(parts, keys).select(*keys, "n", "sum_ms", F.col("union_ms").alias("busy_ms"))


def usage_dates(usage: DataFrame, seen: DataFrame, key: str, counts: list[str], time: str) -> DataFrame:
    """Adds ``first_seen_ms``: the earliest observation with equal counts, null-safe; null if there is none."""
    names = [f"seen_{c}" for c in (key, *counts)]
    first = seen.groupBy(*names).agg(F.min(time).alias("first_seen_ms"))
    same = usage[key] == first[f"seen_{key}"]
    for c in counts:
        same = same & usage[c].eqNullSafe(first[f"seen_{c}"])
    return usage.join(first, same, "left").drop(*names)
