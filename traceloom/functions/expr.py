"""Column helpers that keep unknown apart from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest integer that the source formats can carry exactly.
SAFE = (1 << 53) - 1
_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z$"


def fraction(part: Column, whole: Column) -> Column:
    """part / whole; null unless 0 < whole and 0 <= part <= whole."""
    return F.when((whole > 0) & (part >= 0) & (part <= whole), part / whole)


def checked(total: Column) -> Column:
    """Null where a sum exceeds what the source formats carry exactly."""
    return F.when(F.abs(total) <= SAFE, total)


def complete_sum(value: Column) -> Column:
    """Sum of a group; null if any member is null."""
    return checked(F.when(F.count(value) == F.count(F.lit(1)), F.sum(value)))


def key_text(*parts: Column) -> Column:
    """Sort key that orders as the text of a JSON array does: null after strings."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]))


def utc_ms(text: Column) -> Column:
    """Milliseconds of a strict UTC timestamp with at most three decimals; null for anything else."""
    return F.when(text.rlike(_UTC), F.floor(F.unix_micros(F.try_to_timestamp(text)) / 1000).cast("long"))


def ntz_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without time zone, read as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) div 1000")


def first_reason(*ladder: tuple[Column, Column | str]) -> Column:
    """The reason of the first condition that holds; null if none does."""
    out = F
    for condition, reason in ladder:
        out = out.when(condition, F.lit(reason))
    return out
