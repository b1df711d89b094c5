"""Rules over the order of actions in a session, only where nothing blocks that order.

Actions have the columns of ``native`` and op_key, error_class, error_key, lookup_key,
lookup_range, content_key, content_state, change_state, validation_scope. A session that
``native.session_blockers`` gives a reason for is left out of every rule here and
reported as blocked. What holds along a session is worked on in blocks of its order, with
what a block takes over from those before it, so that a session of any length is many
tasks and the results are the same for any width of the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.expr import fraction
from traceloom.functions.saved import saved
from traceloom.operators import native
from traceloom.operators.blocks import WIDTH, hashed, numbered, running

SESSION = ["source_id", "session_id"]
#: Milliseconds of a block of time.
SPAN = 1 << 24
#: Members and milliseconds of a window of each rule, and of the crowded window of lookups.
RETRY, CHURN, THRASH = (3, 600_000), (4, 600_000), (3, 900_000)
#: Columns of actions that rules over usable sessions read; the others aren't written and sorted for them.
_READ = (
    "id", "source_id", "session_id", "turn_id", "byte_offset", "end_ms", "kind", "category", "tool_name", "status", "outcome", "op_key", "error_class", "error_key", "lookup_key", "lookup_range", "content_key",
    "content_state", "change_state", "validation_scope",
)
CROWD = {"window_ms": 600_000, "lookups": 20, "same": 5, "mutations": 1}


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def edits() -> Column:
    return F.col("kind").isin("file_edit", "file_write")


def validations() -> Column:
    return _is((F.col("kind") == "shell") & F.col("category").isin("test", "build"))


def usable(rows: DataFrame, blockers: DataFrame) -> DataFrame:
    """The placed actions of the sessions without blockers, with the columns that rules read."""
    placed = _is((F.col("kind") != "model") & (F.col("category") != "model") & F.col("admitted")) & F.col("position_reason").isNull()
    return saved(rows.where(placed).select(*[c for c in _READ if c in rows.columns]).join(blockers.where(F.size("reasons") == 0).select(*SESSION), SESSION, "left_semi"))


def witnesses(rows: DataFrame, keys: list[str], least: int, window_ms: int, at: str = "end_ms", tie: str = "id", span: int = SPAN, width: int = WIDTH) -> DataFrame:
    """Trailing windows with ``least`` members or more, one row each, and the episode of each.

    A row's window holds it and what ended at most ``window_ms`` before it and comes no
    later in the order of (``at``, ``tie``). Windows that share a member are one episode.
    Adds rank (place in the partition, from 0), members, first_ms, first_id and episode
    (rank of its first window). A block of time sees the last ``window_ms`` of the one before, so
    each row is in two blocks at most.
    """
    span = max(span, window_ms + 1)
    home = F.floor(F.col(at) / F.lit(float(span))).cast("long")
    # One struct names partition and block: structs compare null-safe.
    key = lambda block: F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], block.alias("block"))
    late = F.col(at) >= (home + 1) * span - window_ms
    seen = rows.withColumn("_w_block", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home)))).withColumn("_w_key", key(F.col("_w_block"))).withColumn("_w_hash", hashed("_w_key"))
    block = W.partitionBy("_w_hash", "_w_key")
    placed = seen.withColumns({
        "_w_own": F.sum((home == F.col("_w_block")).cast("long")).over(block.orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)),
        "members": F.row_number().over(block.orderBy(at, tie)) - F.coalesce(F.count(F.lit(1)).over(block.orderBy(at).rangeBetween(W.unboundedPreceding, -window_ms - 1)), F.lit(0)),
        "_w_first": F.min(F.struct(F.col(at).alias("ms"), F.col(tie).alias("id"))).over(block.orderBy(at).rangeBetween(-window_ms, 0)),
    }).where(home == F.col("_w_block"))
    sizes = rows.groupBy(key(home).alias("_w_key")).agg(F.count(F.lit(1)).alias("_w_size")).withColumn("_w_hash", hashed("_w_key"))
    across = W.partitionBy(*[F.col("_w_key")[f"k{i}"] for i in range(len(keys))]).orderBy(F.col("_w_key")["block"])
    before = sizes.select("_w_hash", "_w_key", F.coalesce(F.sum("_w_size").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_w_before"))
    ranked = placed.join(before, ["_w_hash", "_w_key"]).withColumn("rank", F.col("_w_before") + F.col("_w_own") - 1)
    full = ranked.where(F.col("members") >= least).select(*[F.col(f"`{c}`") for c in rows.columns], "rank", "members", F.col("_w_first.ms").alias("first_ms"), F.col("_w_first.id").alias("first_id"))
    reach = F.struct("rank", (F.col("rank") - F.col("members") + 1).alias("left"))
    return numbered(full, keys, "rank", reach, lambda before, now: now["left"] > before["rank"], "episode", width)


def episodes(rows: DataFrame, keys: list[str], least: int, window_ms: int, at: str = "end_ms", tie: str = "id", span: int = SPAN, width: int = WIDTH) -> DataFrame:
    """Merged windows: keys, first and last instant and id, members, number of windows."""
    found = witnesses(rows, keys, least, window_ms, at, tie, span, width)
    low = F.min(F.struct("rank", (F.col("rank") - F.col("members") + 1).alias("left"), F.col("first_ms").alias("ms"), F.col("first_id").alias("id")))
    high = F.max(F.struct("rank", F.col(at).alias("ms"), F.col(tie).alias("id")))
    merged = found.groupBy(*keys, "episode").agg(low.alias("_a"), high.alias("_b"), F.count(F.lit(1)).alias("windows"))
    return merged.select(*keys, F.col("_a.ms").alias("first_ms"), F.col("_a.id").alias("first_id"), F.col("_b.ms").alias("last_ms"), F.col("_b.id").alias("last_id"), (F.col("_b.rank") - F.col("_a.left") + 1).alias("members"), "windows")


def _retries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts of sessions in which each has an operation and a turn, with ``mixed`` (operations of several classes); and the other sessions."""
    attempts = rows.where(F.col("kind").isin("shell", "mcp"))
    # Both are saved, so that their size is known and the attempts needn't be shuffled for a few sessions and operations.
    lacking = saved(attempts.where(F.col("op_key").isNull() | F.col("turn_id").isNull()).select(*SESSION).distinct())
    known = attempts.join(lacking, SESSION, "left_anti")
    label = F.struct("kind", "category", "tool_name")
    operation = [*SESSION, "turn_id", "op_key"]
    mixed = saved(known.groupBy(*operation).agg((F.min(label) != F.max(label)).alias("mixed")).where("mixed"))
    return known.join(mixed, operation, "left").withColumn("mixed", _is(F.col("mixed"))), lacking


def retry_loops(rows: DataFrame, span: int = SPAN, width: int = WIDTH) -> DataFrame:
    """Three failures or more of one operation of a turn within ten minutes, all with the same error and nothing else of the operation between.

    Takes the actions of ``usable``. A session with an attempt that no operation or turn
    is known of has none; nor has an operation whose attempts are of several classes.
    """
    return _loops(_retries(rows)[0], span, width)


def _loops(known: DataFrame, span: int, width: int) -> DataFrame:
    keys = [*SESSION, "turn_id", "op_key"]
    failed = (F.col("status") == "failed") & (F.col("outcome") == "error") & F.col("error_key").isNotNull()
    marked = known.where("NOT mixed").withColumn("_error", F.when(failed, F.struct(F.col("error_class").alias("kind"), F.col("error_key").alias("key"))))
    runs = numbered(marked, keys, "byte_offset", F.struct("_error"), lambda before, now: ~before["_error"].eqNullSafe(now["_error"]), "run", width)
    return episodes(runs.where("_error IS NOT NULL"), [*keys, "run"], *RETRY, span=span, width=width).drop("run")


def context_churns(rows: DataFrame, span: int = SPAN, width: int = WIDTH) -> DataFrame:
    """Four lookups or more of the same unchanged content within ten minutes of a turn, without an edit or an unproven lookup between."""
    lookup = F.col("kind").isin("file_read", "search")
    proven = _is(
        (F.col("status") == "completed") & (F.col("outcome") == "success") & F.col("lookup_key").isNotNull() & F.col("content_key").isNotNull()
        & (F.col("content_state") == "complete") & (F.col("change_state") == "unchanged") & ((F.col("kind") != "file_read") | F.col("lookup_range").isNotNull())
    )
    cut = edits() | (lookup & ~proven)
    placed = running(rows, SESSION, "byte_offset", width, sums={"epoch": cut.cast("long")})
    keys = [*SESSION, "epoch", "turn_id", "lookup_key", "lookup_range", "content_key"]
    return episodes(placed.where(lookup & proven), keys, *CHURN, span=span, width=width).drop("epoch")


def _associated(rows: DataFrame, width: int) -> DataFrame:
    """Edits and validations with their stretch of turn, and of each validation the cycle it belongs to, if any.

    A cycle is edits in a row, the validation right after them, and the validations that
    follow at once and have the operation of the first. A change of turn ends everything.
    """
    ended = ((F.col("status") == "completed") & (F.col("outcome") == "success")) | ((F.col("status") == "failed") & (F.col("outcome") == "error"))
    step = F.when(edits(), "edit").when(validations() & ended, "validation").when(validations(), "unclear")
    mine = rows.select(*SESSION, "id", "byte_offset", "turn_id", "end_ms", "status", "outcome", "op_key", "validation_scope", step.alias("step"))
    turns = numbered(mine, SESSION, "byte_offset", F.struct("turn_id"), lambda before, now: ~before["turn_id"].eqNullSafe(now["turn_id"]), "_stretch", width)
    some = turns.where("step IS NOT NULL")
    keys = [*SESSION, "_stretch"]
    met = running(some, keys, "byte_offset", width, previous={"_step0": "step"}, sums={"_run": (F.col("step") != "validation").cast("long"), "_checks": (F.col("step") != "edit").cast("long")})
    met = saved(met.withColumn("_checks", F.col("_checks") - (F.col("step") != "edit").cast("long")))  # before the row
    first = met.where("step = 'validation'").groupBy(*keys, "_run").agg(F.min(F.struct("byte_offset", "op_key", (F.col("_step0") == "edit").alias("starts"), F.col("_checks").alias("checks"))).alias("head"))
    out = met.join(first, [*keys, "_run"], "left").withColumn("head", F.when(F.col("step") == "validation", F.col("head")))
    other = (F.col("byte_offset") != F.col("head.byte_offset")) & ~_is(F.col("op_key") == F.col("head.op_key"))
    counted = running(out, [*keys, "_run"], "byte_offset", width, sums={"_others": _is(other).cast("long")})
    member = _is(F.col("head.starts")) & (F.col("_others") == 0)
    return saved(counted.withColumn("member", (F.col("step") == "validation") & member).drop("_step0", "_others"))


def cycles(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Cycles of edits and validations in order, without a claim of cause. Takes the actions of ``usable``."""
    return _cycles(_associated(rows, width))


def _cycles(met: DataFrame) -> DataFrame:
    keys = [*SESSION, "_stretch"]
    good = (F.col("status") == "completed") & (F.col("outcome") == "success")
    made = met.where("member").groupBy(*keys, F.col("head.checks").alias("_checks")).agg(
        F.count(F.lit(1)).alias("validations"), F.min(F.struct("byte_offset", "id", "turn_id", "status", "validation_scope", "end_ms")).alias("_f"), F.min(F.when(good, F.struct("byte_offset", "id"))).alias("_ok"),
    )
    edited = met.where("step = 'edit'").groupBy(*keys, "_checks").agg(F.count(F.lit(1)).alias("edits"), F.min(F.struct("byte_offset", "id")).alias("_e"))
    out = made.join(edited, [*keys, "_checks"])
    return out.select(
        *SESSION, F.col("_f.turn_id").alias("turn_id"), F.col("_e.id").alias("first_edit_id"), "edits", F.col("_f.id").alias("first_validation_id"), F.col("_f.end_ms").alias("first_validation_ms"), "validations",
        F.when(F.col("_f.status") == "completed", "success").otherwise("failure").alias("first_result"), F.col("_f.validation_scope").alias("first_scope"), F.col("_ok").isNotNull().alias("resolved"), F.col("_ok.id").alias("success_id"),
    )


def cycle_sessions(rows: DataFrame, blockers: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per session: its cycles and rates; null figures and the reasons where the session is blocked."""
    met = _associated(rows, width)
    made = _cycles(met).groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("cycle_n"), F.count_if(F.col("first_result") == "success").alias("first_pass_n"), F.count_if(F.col("first_scope") != "unknown").alias("scope_known_n"),
        F.count_if(F.col("first_scope") == "full").alias("full_scope_n"), F.sum("edits").alias("_used"),
    )
    loose = met.groupBy(*SESSION).agg(F.count_if((F.col("step") != "edit") & ~F.col("member")).alias("without_edit_n"), F.count_if(F.col("step") == "edit").alias("_edits"))
    out = blockers.join(made, SESSION, "left").join(loose, SESSION, "left")
    open_ = F.size("reasons") == 0
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    counts = {c: n(c) for c in ("cycle_n", "first_pass_n", "scope_known_n", "full_scope_n", "without_edit_n")}
    counts["awaiting_edit_n"] = n("_edits") - n("_used")
    shown = out.select(*SESSION, "reasons", *[F.when(open_, v).alias(c) for c, v in counts.items()])
    return shown.withColumns({"first_pass_rate": fraction(F.col("first_pass_n"), F.col("cycle_n")), "full_scope_rate": fraction(F.col("full_scope_n"), F.col("scope_known_n"))})


def validation_thrashes(rows: DataFrame, span: int = SPAN, width: int = WIDTH) -> DataFrame:
    """Three validations or more of cycles of one turn and known scope within a quarter of an hour."""
    return _thrashes(_associated(rows, width), span, width)


def _thrashes(met: DataFrame, span: int, width: int) -> DataFrame:
    known = met.where(F.col("member") & (F.col("validation_scope") != "unknown"))
    return episodes(known, [*SESSION, "turn_id", "validation_scope"], *THRASH, span=span, width=width)


def assessments(rows: DataFrame, blockers: DataFrame, span: int = SPAN, width: int = WIDTH) -> DataFrame:
    """Per source and rule: status, candidates, blocked sessions, events that are eligible or lack evidence.

    ``rows`` are all actions with suppressed, coverage, unsupported_records and
    partition_status; null where the whole source is suppressed.
    """
    mine = usable(rows, blockers)
    known, lacking = _retries(mine)
    failed = (F.col("status") == "failed") & (F.col("outcome") == "error")
    lookup = F.col("kind").isin("file_read", "search")
    proven = _is((F.col("status") == "completed") & (F.col("outcome") == "success") & F.col("lookup_key").isNotNull() & F.col("content_key").isNotNull() & (F.col("content_state") == "complete") & (F.col("change_state") == "unchanged") & ((F.col("kind") != "file_read") | F.col("lookup_range").isNotNull()))
    bad = F.col("op_key").isNull() | F.col("turn_id").isNull()
    associated = _associated(mine, width)
    member = associated.where("member")
    parts = [
        ("retry-loop", known.select("source_id", (~F.col("mixed") & failed & F.col("error_key").isNotNull()).alias("e"), (F.col("mixed") | (failed & F.col("error_key").isNull())).alias("m"))),
        ("retry-loop", mine.where(F.col("kind").isin("shell", "mcp") & bad).select("source_id", F.lit(False).alias("e"), F.lit(True).alias("m"))),
        ("context-churn", mine.where(lookup).select("source_id", proven.alias("e"), (~proven).alias("m"))),
        ("validation-thrashing", member.select("source_id", (F.col("validation_scope") != "unknown").alias("e"), (F.col("validation_scope") == "unknown").alias("m"))),
    ]
    counted = None
    for rule, part in parts:
        part = part.groupBy("source_id").agg(F.count_if("e").alias("eligible_n"), F.count_if("m").alias("missing_n")).withColumn("rule", F.lit(rule))
        counted = part if counted is None else counted.unionByName(part)
    counted = counted.groupBy("source_id", "rule").agg(F.sum("eligible_n").alias("eligible_n"), F.sum("missing_n").alias("missing_n"))
    found = None
    for rule, made in (("retry-loop", _loops(known, span, width)), ("context-churn", context_churns(mine, span, width)), ("validation-thrashing", _thrashes(associated, span, width))):
        part = made.groupBy("source_id").agg(F.count(F.lit(1)).alias("candidate_n")).withColumn("rule", F.lit(rule))
        found = part if found is None else found.unionByName(part)
    partial = (F.col("coverage") != "recognized_shapes") | (F.col("unsupported_records") > 0) | (F.col("partition_status") == "provenance_unresolved")
    whole = rows.groupBy("source_id").agg(F.max("suppressed").alias("suppressed"), F.bool_or(_is(partial)).alias("partial"))
    spine = whole.withColumn("rule", F.explode(F.array(*[F.lit(x) for x in ("retry-loop", "context-churn", "validation-thrashing")])))
    blocked = blockers.where(F.size("reasons") > 0).select(*SESSION).withColumn("rule", F.explode(F.array(*[F.lit(x) for x in ("retry-loop", "context-churn", "validation-thrashing")]))).unionByName(lacking.withColumn("rule", F.lit("retry-loop")))
    shut = blocked.groupBy("source_id", "rule").agg(F.count(F.lit(1)).alias("blocked_n"))
    out = spine.join(counted, ["source_id", "rule"], "left").join(found, ["source_id", "rule"], "left").join(shut, ["source_id", "rule"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    silent = F.col("suppressed").isNotNull()
    counts = {c: F.when(silent, F.lit(0)).otherwise(n(c)).cast("long") for c in ("eligible_n", "missing_n", "candidate_n", "blocked_n")}
    shown = out.select("source_id", "rule", "suppressed", "partial", *[v.alias(c) for c, v in counts.items()])
    incomplete = (F.col("missing_n") > 0) | (F.col("blocked_n") > 0) | F.col("partial")
    status = F.when(silent, "suppressed").when(incomplete, F.when(F.col("eligible_n") > 0, "partial").otherwise("not_evaluable")).when(F.col("candidate_n") > 0, "candidates").otherwise("no_candidate")
    return shown.select("source_id", "rule", status.alias("status"), "eligible_n", "missing_n", "candidate_n", "blocked_n")


def exploration(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per session: the first closed window of ten minutes, ending at a lookup, that is crowded with lookups and repeats one search.

    Lookups count by their end, edits and other actions if their closed interval meets the
    window. Each row gives two changes, one where it enters the windows and one after it
    has left them: of its kind, and of the number of its search key, which counts while it
    has enough. Running sums over the instants of a session then tell everything at once,
    so a crowded session costs no more than its rows.
    """
    span = CROWD["window_ms"]
    model = _is((F.col("kind") == "model") & (F.col("category") == "model")) & F.col("tool_name").isNull()
    silent = F.coalesce(F.col("suppressed"), F.when(F.col("provider") != "claude", "unsupported_metric_contract"), F.when(F.col("unsupported_records") > 0, "unsupported_records"))
    search = _is((F.col("kind") == "search") & (F.col("category") == "search") & F.col("tool_name").isin("Grep", "Glob"))
    read = _is((F.col("kind") == "file_read") & (F.col("category") == "read") & (F.col("tool_name") == "Read"))
    mutation = _is(((F.col("kind") == "file_edit") & (F.col("category") == "edit") & (F.col("tool_name") == "Edit")) | ((F.col("kind") == "file_write") & (F.col("category") == "write") & (F.col("tool_name") == "Write")))
    lookup = search | read
    alike = _is(F.col("kind").isin("file_read", "search") | F.col("tool_name").isin("Read", "Grep", "Glob"))
    role = F.when(lookup, "lookup").when(mutation, "mutation").otherwise("opaque")
    done = F.col("status") == "completed"
    counted = rows.where(~model).withColumns({"_role": role, "_open": lookup & ~_is(done)})
    ok = _is(F.col("admitted") & F.col("position_reason").isNull() & F.col("status").isin("completed", "failed"))
    bad = F.when(F.col("_open"), None).when(~ok, F.concat(F.lit("incomplete_"), F.col("_role"))).when(search & F.col("lookup_key").isNull(), "missing_search_identity")
    kept = ("id", "lookup_key", "start_ms", "end_ms", "partition_status", "_role", "_open")
    marked = saved(counted.select(*SESSION, *kept, bad.alias("_bad"), (alike & ~lookup).alias("_odd"), search.alias("_search"), silent.alias("suppressed")))
    whole = marked.groupBy(*SESSION).agg(
        F.max("suppressed").alias("suppressed"), F.bool_or(_is(F.col("partition_status") == "provenance_unresolved")).alias("_unproven"), F.bool_or("_odd").alias("_odd"), F.array_sort(F.collect_set("_bad")).alias("_bad"),
        F.count_if((F.col("_role") == "lookup") & ~F.col("_open")).alias("completed_n"), F.count_if(F.col("_open")).alias("excluded_n"), F.count_if((F.col("_role") == "lookup") & ~F.col("_open") & F.col("_bad").isNull()).alias("positioned_n"),
        F.count_if(F.col("_role") == "mutation").alias("mutation_n"), F.count_if(F.col("_role") == "opaque").alias("opaque_n"),
    )
    reasons = F.array_sort(F.array_compact(F.concat("_bad", F.array(F.when(F.col("_odd"), F.lit("inconsistent_lookup_class")), F.when(F.col("_unproven"), F.lit("provenance_unresolved")), F.when(F.col("suppressed").isNotNull(), F.lit("source_suppressed"))))))
    whole = whole.withColumn("reasons", reasons)

    clean = saved(marked.where(F.col("_bad").isNull() & ~F.col("_open")).join(whole.where(F.size("reasons") == 0).select(*SESSION), SESSION, "left_semi"))
    arrive, leave = F.when(F.col("_role") == "lookup", F.col("end_ms")).otherwise(F.col("start_ms")), F.col("end_ms") + span + 1
    both = clean.select(*SESSION, F.when(F.col("_search"), F.col("lookup_key")).alias("_key"), "_role", F.explode(F.array(*[F.struct(at.alias("ms"), F.lit(n).alias("n")) for at, n in ((arrive, 1), (leave, -1))])).alias("c")).select(*SESSION, "_key", "_role", "c.ms", "c.n")
    by_key = both.where("_key IS NOT NULL").groupBy(*SESSION, "_key", "ms").agg(F.sum("n").cast("long").alias("n"))
    keyed = running(by_key, [*SESSION, "_key"], "ms", width, sums={"now": F.col("n")})
    crowd = (F.col("now") >= CROWD["same"]).cast("long") - (F.col("now") - F.col("n") >= CROWD["same"]).cast("long")
    zero = F.lit(0).cast("long")
    of = lambda kind: F.when(F.col("_role") == kind, F.col("n")).otherwise(0).cast("long")
    steps = both.select(*SESSION, "ms", of("lookup").alias("looks"), zero.alias("crowds"), of("mutation").alias("mutations"), of("opaque").alias("opaques"), ((F.col("_role") == "lookup") & (F.col("n") == 1)).alias("here"))
    steps = steps.unionByName(keyed.select(*SESSION, "ms", zero.alias("looks"), crowd.alias("crowds"), zero.alias("mutations"), zero.alias("opaques"), F.lit(False).alias("here")))
    instants = steps.groupBy(*SESSION, "ms").agg(*[F.sum(c).alias(c) for c in ("looks", "crowds", "mutations", "opaques")], F.bool_or("here").alias("here"))
    now = running(instants, SESSION, "ms", width, sums={f"{c}_now": F.col(c) for c in ("looks", "crowds", "mutations", "opaques")}).where("here")
    fit = (F.col("looks_now") >= CROWD["lookups"]) & (F.col("crowds_now") > 0) & (F.col("mutations_now") <= CROWD["mutations"])
    now = saved(now).withColumns({"_fit": fit, "_free": fit & (F.col("opaques_now") == 0)})
    chosen = now.groupBy(*SESSION).agg(F.min(F.when(F.col("_free"), F.struct("ms", F.col("looks_now").alias("looks"), F.col("mutations_now").alias("mutations")))).alias("w"))
    # What was looked at before the window that is chosen: all, if none is.
    upto = now.join(chosen.select(*SESSION, F.col("w.ms").alias("_at")), SESSION).where(F.col("_at").isNull() | (F.col("ms") <= F.col("_at")))
    tried = upto.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("endpoints"), F.count_if("_fit").alias("qualified"), F.count_if(F.col("_fit") & ~F.col("_free")).alias("blocked"))
    most = both.where("_key IS NOT NULL AND n = 1").join(chosen.select(*SESSION, F.col("w.ms").alias("_at")).where("_at IS NOT NULL"), SESSION).where(F.col("ms").between(F.col("_at") - span, F.col("_at")))
    most = most.groupBy(*SESSION, "_key").agg(F.count(F.lit(1)).alias("n")).groupBy(*SESSION).agg(F.max("n").alias("most_same"))
    out = whole.join(chosen.select(*SESSION, "w"), SESSION, "left").join(tried, SESSION, "left").join(most, SESSION, "left")
    unusable, enough = F.size("reasons") > 0, F.col("positioned_n") >= CROWD["lookups"]
    status = F.when(unusable, F.when(F.col("suppressed").isNotNull(), "suppressed").otherwise("unavailable")).when(F.col("positioned_n") == 0, "empty").when(~enough, "insufficient")
    status = F.coalesce(status, F.when(F.col("w").isNotNull(), "candidate").when(F.col("blocked") > 0, "blocked").otherwise("no_candidate"))
    figures = {c: F.when(unusable, None).when(enough, F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in ("endpoints", "qualified", "blocked")}
    shown = {"last_ms": F.col("w.ms"), "lookups": F.col("w.looks"), "mutations": F.col("w.mutations"), "most_same": F.col("most_same")}
    return out.select(
        *SESSION, status.alias("status"), F.array_join("reasons", ",").alias("reasons"), "completed_n", "positioned_n", "excluded_n", "mutation_n", "opaque_n",
        *[v.alias(c) for c, v in figures.items()], *[F.when(enough & ~unusable, v).alias(c) for c, v in shown.items()],
    )


def blockers(rows: DataFrame) -> DataFrame:
    """Reasons of each session, over actions that carry what their source and proofs say."""
    return saved(native.session_blockers(rows))
