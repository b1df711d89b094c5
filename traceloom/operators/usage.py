"""Token usage of responses out of log records (source_id, ordinal, byte_offset, raw), by grouping.

A record is parsed once, as a variant. A count is taken only if it is a whole number of
the format's range: one that lacks makes counts partial, one of another kind invalid, and
neither is zero. Of the first provider's copies of a response no one outranks another;
the second provider writes a response again while it grows, so its last record counts.
All grouping is by response or message; a source in one log is as many tasks as it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.expr import SAFE
from traceloom.functions.saved import saved

#: Versions of the first provider's program whose counts are known to be its service's.
VERIFIED = ("0.153.4", "0.157.0", "0.159.0", "0.159.2")


def _text(path: str) -> Column:
    """A string at a path that is not empty; else null. Its kind is looked at only where something is there."""
    value = F.try_variant_get("v", path, "string")
    return F.when(value != "", F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", value))


def _component(here: Column, number: Column, kind: Column) -> Column:
    """value, missing and bad of a count."""
    missing = here.isNull() | F.is_variant_null(here)
    numeric = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    good = ~missing & F.coalesce(numeric & number.between(0, SAFE) & (number == F.floor(number)), F.lit(False))
    return F.struct(F.when(good, number.cast("long")).alias("value"), missing.alias("missing"), (~missing & ~good).alias("bad"))


def _is_object(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")).startswith("OBJECT"), F.lit(False))


def _any(parts: list[str], what: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.col(f"{p}.{what}")
    return out


def _safe(total: Column) -> Column:
    return F.when(total <= SAFE, total)


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later expressions use many times. A generator of one row keeps them from being computed anew for each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def components(rows: DataFrame, usage: str, keys: dict[str, str]) -> DataFrame:
    """Adds a struct (value, missing, bad) for each count, and whether there is an object of counts. Each count is looked up once."""
    out = once(rows, {f"{c}_here": F.try_variant_get("v", f"{usage}.{k}", "variant") for c, k in keys.items()})
    out = once(out, {f"{c}_{n}": e for c in keys for n, e in (("number", F.try_variant_get(f"{c}_here", "$", "double")), ("kind", F.schema_of_variant(f"{c}_here")))})
    found = {c: _component(*[F.col(f"{c}_{n}") for n in ("here", "number", "kind")]) for c in keys} | {"_object": _is_object(usage)}
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[e.alias(c) for c, e in found.items()])


def parsed(records: DataFrame) -> DataFrame:
    """Records with their content as variant ``v``."""
    return once(records, {"v": F.try_parse_json("raw")}).select("source_id", "ordinal", "byte_offset", "v")


def claude_counts(rows: DataFrame, usage: str = "$.message.usage") -> DataFrame:
    """Adds counts (input, uncached_input, output, cached_input, cache_write_input, total) and count_status.

    Input is what was new, read from and written to the cache; with one of them unknown it
    is unknown, and so is the total.
    """
    keys = {"_u": "input_tokens", "_o": "output_tokens", "_r": "cache_read_input_tokens", "_w": "cache_creation_input_tokens"}
    out = components(rows, usage, keys)
    whole = F.col("_u.value") + F.col("_r.value") + F.col("_w.value")
    out = out.withColumn("_input", _safe(whole)).withColumn("_total", _safe(F.col("_input") + F.col("_o.value")))
    over = (whole.isNotNull() & F.col("_input").isNull()) | ((F.col("_input") + F.col("_o.value")).isNotNull() & F.col("_total").isNull())
    status = F.when(~F.col("_object") | _any([*keys], "bad") | over, "invalid").when(_any([*keys], "missing"), "partial").otherwise("complete")
    counts = {"input": F.col("_input"), "uncached_input": F.col("_u.value"), "output": F.col("_o.value"), "cached_input": F.col("_r.value"), "cache_write_input": F.col("_w.value"), "total": F.col("_total")}
    return out.withColumns({"counts": F.struct(*[v.alias(k) for k, v in counts.items()]), "count_status": status}).drop(*keys, "_object", "_input", "_total")


#: Names of the first provider's counts.
_CODEX = {"_i": "input_tokens", "_o": "output_tokens", "_c": "cached_input_tokens", "_w": "cache_write_input_tokens", "_g": "reasoning_output_tokens", "_t": "total_tokens"}


def codex_counts(rows: DataFrame, usage: str, verified: Column) -> DataFrame:
    """The same of the first provider: input, output, cached_input, cache_write_input, reasoning_output, total.

    Only of verified programs are parts compared with wholes: a part that exceeds its whole
    and a total that isn't the sum are taken away and make the counts invalid. Of others the total is unknown.
    """
    return _codex_judged(components(rows, usage, _CODEX), verified)


def _codex_judged(rows: DataFrame, verified: Column) -> DataFrame:
    keys = _CODEX
    out = rows.withColumn("_known", F.coalesce(verified, F.lit(False)))
    i, o, c, w, g, t = (F.col(f"{k}.value") for k in keys)
    no = lambda x: F.coalesce(x, F.lit(False))
    bad_c, bad_w, bad_g = no(c > i), no(w > i), no(g > o)
    bad_both = ~bad_c & ~bad_w & no(c + w > i)
    bad_t = no(t != i + o) | no(i + o > SAFE)
    known = F.col("_known")
    wrong = known & (bad_c | bad_w | bad_both | bad_g | bad_t)
    status = F.when(~F.col("_object") | _any([*keys], "bad") | wrong, "invalid").when(_any([*keys], "missing") | ~known, "partial").otherwise("complete")
    counts = {
        "input": i, "output": o, "cached_input": F.when(~(known & (bad_c | bad_both)), c), "cache_write_input": F.when(~(known & (bad_w | bad_both)), w), "reasoning_output": F.when(~(known & bad_g), g),
        "total": F.when(known & ~bad_t & i.isNotNull() & o.isNotNull(), t),
    }
    return out.withColumns({"counts": F.when(F.col("_object"), F.struct(*[v.alias(k) for k, v in counts.items()])), "count_status": status}).drop(*keys, "_object", "_known")


def claude_usage(records: DataFrame) -> DataFrame:
    """One row for each response of each source; a response without id has one for each of its messages.

    The last record of a response counts. A repeated record (same message, content and
    usage) changes nothing. A message that comes again with other content makes what is
    read from then on of its response conflicted; its counts are null. No record says that
    it is final, so nothing is more than provisional.
    """
    rows = parsed(records).where((_text("$.type") == "assistant") & F.try_variant_get("v", "$.message.usage", "variant").isNotNull())
    link = [F.coalesce(F.to_json(F.try_variant_get("v", p, "variant")), F.lit("null")) for p in ("$.parentUuid", "$.sourceToolAssistantUUID", "$.message.id", "$.message.content")]
    rows = saved(claude_counts(rows).select(
        "source_id", "ordinal", "byte_offset", _text("$.sessionId").alias("session_id"), _text("$.uuid").alias("uuid"), _text("$.message.id").alias("response_id"), _text("$.message.stop_reason").alias("stop_reason"),
        F.sha2(F.concat_ws("\x00", *link), 256).alias("_digest"), F.to_json(F.try_variant_get("v", "$.message.usage", "variant")).alias("_usage"), "counts", "count_status",
    ))
    first = rows.where("uuid IS NOT NULL").groupBy("source_id", "uuid").agg(F.min_by("_digest", "ordinal").alias("_first"))
    bad = rows.join(first, ["source_id", "uuid"]).where(F.col("_digest") != F.col("_first")).groupBy("source_id", "uuid").agg(F.min("ordinal").alias("_bad_from"))
    marked = rows.join(bad, ["source_id", "uuid"], "left").withColumn("_bad", F.coalesce(F.col("ordinal") >= F.col("_bad_from"), F.lit(False)))
    # Of repeated records the first counts; those without a message id can't be told to be repeated.
    same = F.coalesce("uuid", F.concat(F.lit("\x00"), F.col("byte_offset").cast("string")))
    once = marked.groupBy("source_id", same.alias("_message"), "response_id", "_digest", "_usage", "stop_reason").agg(F.min(F.struct("ordinal", "byte_offset", "session_id", "uuid", "counts", "count_status", "_bad")).alias("r"))
    group = F.coalesce("response_id", F.concat(F.lit("\x00"), F.col("_message")))
    last = once.groupBy("source_id", group.alias("_response"), "response_id").agg(F.max(F.struct("r.ordinal", "r.counts", "r.count_status", "stop_reason", "r.session_id")).alias("w"), F.bool_or("r._bad").alias("conflicted"), F.min("r.byte_offset").alias("byte_offset"), F.count(F.lit(1)).alias("records"))
    selection = F.when(F.col("conflicted"), "conflicted").when((F.col("w.count_status") == "invalid") | F.col("response_id").isNull(), "invalid").otherwise("provisional")
    return last.select("source_id", "w.session_id", "response_id", F.when(~F.col("conflicted"), F.col("w.counts")).alias("counts"), "w.count_status", selection.alias("selection"), "conflicted", "w.stop_reason", "byte_offset", "records")


def codex_usage(records: DataFrame) -> DataFrame:
    """One row for each response of each source: copies that differ in counts or turn are conflicted and no one wins.

    Counts are of a known kind, and final, where the log's program is a verified version
    and no other session had begun when the record was written.
    """
    # A record is read once: what it says of its session or of a response is saved.
    rows = once(parsed(records), {"_type": _text("$.type"), "response_id": _text("$.payload.response_id")}).where((F.col("_type") == "session_meta") | ((F.col("_type") == "token_usage_record") & F.col("response_id").isNotNull()))
    head = {"session": _text("$.payload.id"), "verified": _text("$.payload.cli_version").isin(*VERIFIED), "forked": _text("$.payload.forked_from_id").isNotNull(), "_turn": F.coalesce(_text("$.payload.turn_id"), F.lit("\x00"))}
    rows = components(rows.select("source_id", "ordinal", "byte_offset", "_type", "response_id", "v", *[c.alias(n) for n, c in head.items()]), "$.payload.usage", _CODEX)
    rows = saved(rows.drop("v"))
    meta = rows.where("_type = 'session_meta'")
    first = meta.groupBy("source_id").agg(F.min_by("session", "ordinal").alias("session_id"), F.min_by("verified", "ordinal").alias("verified"))
    strange = meta.join(first.select("source_id", "session_id"), "source_id").where(F.col("forked") | ~F.col("session").eqNullSafe(F.col("session_id"))).groupBy("source_id").agg(F.min("ordinal").alias("_strange"))
    used = rows.where("_type = 'token_usage_record'").drop("verified").join(first, "source_id", "left").join(strange, "source_id", "left")
    used = _codex_judged(used, F.col("verified")).withColumn("ambiguous", F.coalesce(F.col("ordinal") >= F.col("_strange"), F.lit(False)))
    used = used.withColumn("final", F.coalesce("verified", F.lit(False)) & ~F.col("ambiguous"))
    used = used.select("source_id", "session_id", "response_id", "ordinal", "byte_offset", "_turn", F.coalesce(F.to_json("counts"), F.lit("")).alias("_same"), "counts", "count_status", "final", "ambiguous")
    found = used.groupBy("source_id", "response_id").agg(
        F.min(F.struct("ordinal", "byte_offset", "session_id", "_turn", "counts", "count_status", "ambiguous")).alias("w"), F.bool_or("final").alias("final"),
        ((F.min("_same") != F.max("_same")) | (F.min("_turn") != F.max("_turn"))).alias("conflicted"), F.count(F.lit(1)).alias("records"),
    )
    lacking = F.col("w.counts.input").isNull() | F.col("w.counts.output").isNull()
    selection = F.when(F.col("conflicted"), "conflicted").when(F.col("w.count_status") == "invalid", "invalid").when(F.col("final") & ~lacking & ~F.col("w.ambiguous"), "eligible").otherwise("provisional")
    return found.select(
        "source_id", "w.session_id", "response_id", F.when(F.col("w._turn") != "\x00", F.col("w._turn")).alias("turn_id"), F.when(~F.col("conflicted"), F.col("w.counts")).alias("counts"), "w.count_status", selection.alias("selection"), "conflicted", "final", "w.byte_offset", "records",
    )
