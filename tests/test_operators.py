"""Interval, sequence, cohort and gate operators against hand calculations and brute force."""

import math

import pytest
from pyspark.sql import functions as F

from traceloom.functions import expr, identity
from traceloom.operators import blocks, cohorts, gates, history, intervals, sequences
from traceloom.sources import results, snapshots


def numbers(seed):
    x = seed
    while True:
        x = (x * 1664525 + 1013904223) % (1 << 32)
        yield x >> 8


def rows_of(spark, rows, ddl="id long, k long, start_ms long, end_ms long, kind string"):
    return spark.createDataFrame(rows, ddl)


def population(seed, groups=60):
    draw = numbers(seed)
    rows = []
    for k in range(groups):
        for _ in range(next(draw) % 9):
            start = next(draw) % 40
            rows.append((len(rows), k, start, start + next(draw) % 12, "abc"[next(draw) % 3]))
    return rows


def test_union_and_sweep_equal_unit_cells(spark):
    rows = population(7)
    df = rows_of(spark, rows)
    union = {r.k: (r.n, r.sum_ms, r.union_ms, r.excess_ms) for r in intervals.union_length(df, ["k"]).collect()}
    segments = intervals.sweep(df, ["k"], "kind")
    busy = {r.k: (r.busy_ms, r.concurrent_ms, r.multi_kind_ms) for r in intervals.concurrency(segments, ["k"]).collect()}
    alone = {(r.k, r.kind): r.exclusive_ms for r in intervals.exclusive(segments, ["k"]).collect()}
    for k in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == k]
        cells = [[r for r in mine if r[2] <= t < r[3]] for t in range(60)]
        covered = sum(bool(c) for c in cells)
        total = sum(r[3] - r[2] for r in mine)
        assert union[k] == (len(mine), total, covered, total - covered)
        if total:
            assert busy[k] == (covered, sum(len(c) > 1 for c in cells), sum(len({r[4] for r in c}) > 1 for c in cells))
        for kind in "abc":
            assert alone.get((k, kind), 0) == sum({r[4] for r in c} == {kind} for c in cells)


def test_result_does_not_depend_on_row_order(spark):
    rows = population(11)
    a = intervals.union_length(rows_of(spark, rows), ["k"]).orderBy("k").collect()
    b = intervals.union_length(rows_of(spark, rows[::-1]).repartition(3), ["k"]).orderBy("k").collect()
    assert a == b


def test_clip_and_days(spark):
    df = rows_of(spark, [(1, 1, 0, 10, "a"), (2, 1, 10, 15, "a"), (3, 1, 5, 5, "a")])
    assert intervals.union_length(intervals.clip(df, 5, 12), ["k"]).first().union_ms == 7
    day = intervals.DAY
    one = spark.createDataFrame([(1, 1, day - 10, 2 * day + 5)], "id long, session_id long, start_ms long, end_ms long")
    assert {r.day: r.busy_ms for r in history.days(one, 0, 10 * day).collect()} == {0: 10, 1: day, 2: 5}
    early = spark.createDataFrame([(1, 1, -5, 3)], "id long, session_id long, start_ms long, end_ms long")
    assert {r.day: r.busy_ms for r in history.days(early, -100, 100).collect()} == {-1: 5, 0: 3}


@pytest.mark.parametrize(("text", "minutes"), [("+05:30", 330), ("-14:00", -840), ("+00:00", 0)])
def test_offsets(text, minutes):
    assert history.parse_offset(text) == minutes


@pytest.mark.parametrize("text", ["-00:00", "+14:01", "05:30", "+5:30", "+01:60"])
def test_bad_offsets(text):
    with pytest.raises(ValueError):
        history.parse_offset(text)


def test_episodes_equal_brute_force(spark):
    draw, rows = numbers(3), []
    for k in range(50):
        for _ in range(next(draw) % 12):
            rows.append((len(rows), k, 0, next(draw) % 40, "a"))
    got = {(r.k, r.first_ms): (r.last_ms, r.members) for r in sequences.episodes(rows_of(spark, rows), ["k"], 3, 6).collect()}
    want = {}
    for k in {r[1] for r in rows}:
        mine = sorted((r[3], r[0]) for r in rows if r[1] == k)
        spans, left = [], 0
        for right, (t, _) in enumerate(mine):
            while t - mine[left][0] > 6:
                left += 1
            if right - left + 1 >= 3:
                if spans and left <= spans[-1][1]:
                    spans[-1][1] = right
                else:
                    spans.append([left, right])
        want |= {(k, mine[a][0]): (mine[b][0], b - a + 1) for a, b in spans}
    assert got == want


def test_chains(spark):
    rows = [(1, 1, 0, 2000, "f"), (2, 1, 3000, 6000, "f"), (3, 1, 7000, 11000, "f"), (4, 1, 12000, 13000, "s"), (5, 1, 14000, 15000, "f"), (6, 2, 0, 1, "s")]
    got = sequences.recovery_chains(rows_of(spark, rows), ["k"], F.col("kind") == "f", F.col("kind") == "s").orderBy("chain").collect()
    assert [(r.chain, r.failures, r.resolved, r.elapsed_ms) for r in got] == [(0, 3, True, 11000), (1, 1, False, None)]


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21):
        df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "v long")
        got = df.agg(cohorts.nearest_rank("v", 0.5).alias("a"), cohorts.nearest_rank("v", 0.95).alias("b")).first()
        assert (got.a, got.b) == (math.ceil(0.5 * n), math.ceil(0.95 * n))


def test_unknown_is_not_zero(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 6, 2), (2, 1, 1)], "k long, a long, b long")
    got = {r.k: (r.a, r.b) for r in cohorts.component_sums(df, ["k"], ["a", "b"]).collect()}
    assert got == {1: (11, None), 2: (1, 1)}
    ratio = spark.createDataFrame([(0, 0), (1, 2), (3, 2)], "a long, b long").select(expr.fraction(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in ratio] == [None, 0.5, None]
    seen = spark.createDataFrame([(1, "x"), (1, None), (2, "x"), (2, "y")], "k long, f string")
    assert {r.k: (r.distinct_keys, r.repeat_share) for r in cohorts.revisits(seen, ["k"], "f").collect()} == {1: (None, None), 2: (2, 0.0)}


def test_conflicting_copies_are_withheld(spark):
    df = spark.createDataFrame([(1, 7, "a"), (1, 5, "a"), (2, 3, "a"), (2, 4, "b")], "r long, id long, p string")
    assert {r.r: (r.representative, r.copies, r.conflicted) for r in cohorts.dedup_responses(df, ["r"], "id", ["p"]).collect()} == {1: (5, 2, False), 2: (3, 2, True)}


def test_timestamps_are_strict(spark):
    df = spark.createDataFrame([("2026-01-02T03:04:05.678Z",), ("2026-02-30T00:00:00Z",), ("2026-01-02T03:04:05",), ("2026-01-02T03:04:05.1234Z",), (None,)], "t string")
    assert [r.t for r in df.select(expr.utc_ms(F.col("t")).alias("t")).collect()] == [1767323045678, None, None, None, None]


def test_key_text_orders_null_last(spark):
    df = spark.createDataFrame([("npm test",), ("npm test <args>",), (None,)], "p string").orderBy(expr.key_text(F.col("p")))
    assert [r.p for r in df.collect()] == ["npm test <args>", "npm test", None]


def test_gates(spark):
    flags = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False)], "k long, n long, f boolean")
    assert {(r.k, r.n): r.ambiguous for r in gates.propagate(flags, ["k"], F.col("f"), "n").collect()} == {(1, 1): False, (1, 2): True, (1, 3): True, (2, 1): False}


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("hello",)], "m string").select(identity.hmac_sha256(key, F.col("m")).alias("h")).first().h
        assert got == hmac.new(key, b"hello", hashlib.sha256).hexdigest()


@pytest.mark.parametrize(
    ("command", "words"),
    [("rg -n 'a b' src", ["rg", "-n", "a b", "src"]), ("echo \"x\"", ["echo", "x"]), ("a | b", None), ("echo $HOME", None), ("X=1 make", None), ("a\\ b c", ["a b", "c"]), ("'open", None), ("", None), (None, None), ("a''", ["a"])],
)
def test_shell_words(command, words):
    assert identity.shell_words(command) == words


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("rg -n 'a b' src", ("rg -n <args>", "search", "rg", True)), ("find . -name x", ("find <args>", "search", "unknown", True)), ("grep x", ("other <args>", "other", "unknown", True)),
        ("cat a", ("cat <args>", "read", "unknown", True)), ("ls", ("ls", "other", "unknown", True)), ("pytest", ("pytest", "test", "unknown", True)), ("npm test", ("npm test", "test", "unknown", True)),
        ("npm test -- unit", ("npm test <target>", "test", "unknown", True)), ("npm run test", ("npm run <args>", "other", "unknown", True)), ("cargo build --workspace", ("cargo build --workspace", "build", "unknown", True)),
        ("make build", ("other <args>", "other", "unknown", True)), ("xcodebuild -scheme A test", ("xcodebuild <args>", "test", "unknown", True)), ("git diff --exit-code -- a", ("git diff --exit-code <args>", "other", "git_diff", True)),
        ("git diff --stat --exit-code", ("git diff --exit-code <args>", "other", "unknown", True)), ("git diff -- --exit-code", ("git diff <args>", "other", "unknown", True)), ("git diff", ("git diff", "other", "unknown", True)),
        ("/usr/bin/python3 -c x", identity.COMPLEX), ("node --eval=1", identity.COMPLEX), ("python -m x", ("python <args>", "other", "unknown", True)), ("bash -c x", identity.COMPLEX), ("eval x", identity.COMPLEX), ("a | b", identity.COMPLEX),
        (["rg", "a|b"], ("rg <args>", "search", "rg", True)), (["rg", "a\nb"], identity.COMPLEX), ([], identity.COMPLEX), (None, identity.COMPLEX),
    ],
)
def test_commands(command, want):
    assert identity.classify(command) == want


def test_commands_in_batches(spark):
    df = spark.createDataFrame([("rg x",), (None,), ("rg x",), ("a | b",)], "c string").coalesce(1).select("c", identity.command_class("c").alias("k"))
    assert [(r.c, r.k.policy, r.k.plain) for r in df.collect()] == [("rg x", "rg", True), (None, "unknown", False), ("rg x", "rg", True), ("a | b", "unknown", False)]


@pytest.mark.parametrize(("code", "policy", "want"), [(0, "unknown", ("completed", "success")), (1, "rg", ("completed", "no_match")), (1, "git_diff", ("completed", "change_detected")), (2, "rg", ("failed", "error")), (2, "unknown", ("unknown", "unknown")), (1, "unknown", ("unknown", "unknown")), (-1, "rg", ("unknown", "unknown")), (None, "rg", ("unknown", "unknown"))])
def test_exit_codes(code, policy, want):
    assert identity.exit_meaning(code, policy) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"b":1,"a":[2,{"d":1,"c":2}]}', '{"a":[2,{"c":2,"d":1}],"b":1}'), ("{", None), (None, None), ('{"a":NaN}', None), ("[Infinity]", None), ('{"a":1e999}', None), ('{"a":1,"a":2}', '{"a":2}'), ("[" * 33 + "]" * 33, "[" * 33 + "]" * 33), ("[" * 34 + "]" * 34, None),
        ("[" + ",".join("1" * 8191) + "]", "[" + ",".join("1" * 8191) + "]"), ("[" + ",".join("1" * 8192) + "]", None), ('"' + "x" * (1 << 20) + '"', None), ("[" * 100_000, None),
    ],
)
def test_canonical(text, want):
    assert identity.canonical(text) == want


def test_history_states(spark):
    rows = [(1, "a", True, 1, 2), (1, "a", True, None, None), (2, "a", True, 1, 2), (2, "a", True, 1, 3), (3, "a", True, 1, 2), (3, "b", True, 1, 2), (4, "a", True, 1, 2), (4, "a", False, 1, 2), (5, "a", False, 1, 2), (5, "a", False, 9, 9), (6, "a", True, 1, 2), (6, "a", True, 1, 2), (7, None, True, 1, 2), (7, "a", True, 1, 2)]
    df = spark.createDataFrame(rows, "id long, sig string, admitted boolean, start_ms long, end_ms long")
    got = {r.id: r.state for r in history.reconcile(df, ["id"], ["sig"], "admitted", ["start_ms", "end_ms"]).collect()}
    assert got == {1: "unpositioned", 2: "conflict", 3: "conflict", 4: "conflict", 5: "excluded", 6: "admitted", 7: "conflict"}


def test_timing_conflicts(spark):
    reported, paired = "source_reported", "paired_timestamps"
    rows = [(1, "completed", 0, 10, "a", reported, 50, "a", reported), (2, "completed", 0, 10, "a", paired, 50, "a", reported), (3, "completed", 0, 10, "a", reported, 50, "a", paired), (4, "completed", 0, 10, "unknown", paired, 50, "unknown", paired), (5, "completed", 10, 0, "a", paired, 5, "b", paired), (6, "pending", 0, 10, "a", paired, 10, "a", paired), (7, "completed", 0, 10, "a", paired, 11, "a", paired)]
    df = spark.createDataFrame(rows, "id long, status string, start_ms long, end_ms long, interval_scope string, interval_evidence string, duration_ms long, duration_scope string, timing_evidence string")
    got = {r.id: (r.timing_conflict, r.start_ms, r.end_ms, r.interval_scope, r.duration_ms, r.duration_scope) for r in gates.resolve_timing(df).collect()}
    assert got == {
        1: (True, 0, 10, "unknown", None, "unknown"), 2: (True, 0, 10, "unknown", 50, "a"), 3: (True, 0, 10, "a", None, "unknown"), 4: (False, 0, 10, "unknown", None, "unknown"),
        5: (False, None, None, "unknown", 5, "b"), 6: (False, 0, None, "unknown", None, "unknown"), 7: (False, 0, 10, "a", 11, "a"),
    }


def test_two_writers_and_failed_writes(spark, tmp_path):
    table, other = (snapshots.SnapshotTable(spark, str(tmp_path / "t")) for _ in range(2))
    one = spark.createDataFrame([(1,)], "a long")
    bad = one.select(F.raise_error(F.lit("no")).cast("long").alias("a"))
    with pytest.raises(Exception, match="no"):
        table.replace(bad, 0)
    assert table.revision() == 0
    assert table.replace(one, 0) == 1
    other.revision = lambda: 0  # looked before the first one published
    with pytest.raises(snapshots.StaleRevision):
        other.replace(one.union(one), 0)
    assert table.read().count() == 1
    assert table.replace(one.union(one), 1) == 2
    with pytest.raises(FileNotFoundError):
        table.read(7)


def test_retired_sources(spark):
    sources = spark.createDataFrame([("a", "available", 3, "x"), ("b", "available", 1, "y"), ("c", "unavailable", 2, "z"), ("d", "available", 1, "w")], "source_id string, availability string, revision long, payload string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id string")
    got = {r.source_id: (r.availability, r.revision, r.payload) for r in snapshots.retire(sources, ids("a", "b", "c", "a"), ids("b")).collect()}
    assert got == {"a": ("unavailable", 4, "x"), "b": ("available", 1, "y"), "c": ("unavailable", 2, "z"), "d": ("available", 1, "w")}


def test_snapshots(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1,)], "a long")
    assert table.revision() == 0
    assert table.replace(one, 0) == 1
    with pytest.raises(snapshots.StaleRevision):
        table.replace(one, 0)
    table.replace(one.union(one), 1)
    assert (table.read().count(), table.read(1).count()) == (2, 1)
    assert snapshots.same_census(one, one)
    assert not snapshots.same_census(one, one.union(one))
    assert results.lines(one, "s", "c").first().value == '{"schema":"s","ok":true,"command":"c","result":{"a":1}}'


def test_paged_scan_stops_after_the_page_of_the_first_incomplete_source(spark):
    from traceloom.operators import selected

    for bad in (0, 3, 4, 9, None):
        listed = spark.createDataFrame([(f"p{i:02d}", i, i, i == bad) for i in range(10)], "path string, source_id long, digest long, rejected boolean")
        stored = spark.createDataFrame([(i, 3, 3, i, True) for i in (1, 2, 5)] + [(6, 3, 4, 6, True), (7, 3, 3, 0, True)], "source_id long, expected long, actual long, stored_digest long, current boolean")
        got = {r.source_id: r for r in selected.scan_outcomes(listed.unionByName(listed.where("source_id < 2")), stored, page=4).collect()}
        assert [got[i].listings for i in (0, 1, 2)] == [2, 2, 1]
        want = {i: "unchanged" if i in (1, 2, 5) else "committed" for i in range(10)} | {6: "stale"} | ({bad: "rejected"} if bad is not None else {})
        assert {i: r.status for i, r in got.items()} == want
        assert [got[1].reused, got[1].revision, got[7].revision] == [3, None, 4]
        first = min(i for i, status in want.items() if status in ("rejected", "stale"))
        assert sorted(i for i, r in got.items() if r.in_pages) == [i for i in range(10) if i // 4 <= first // 4]


def test_session_filter_comes_after_reconciliation(spark):
    rows = [("codex", 1, 7, "completed", 10, 20, True), ("codex", 1, 8, "completed", 10, 20, True), ("codex", 2, 7, "failed", 10, 25, True), ("codex", 3, 8, "completed", None, 30, True), ("codex", 4, 7, "completed", 5, 9, False)]
    copies = spark.createDataFrame(rows, "provider string, id long, session_id long, status string, start_ms long, end_ms long, admitted boolean").withColumns({"interval_scope": F.lit("a"), "interval_evidence": F.lit("b")})
    found = history.reconcile(copies, ["provider", "id"], ["session_id", "status", "interval_scope", "interval_evidence"], "admitted", ["start_ms", "end_ms"], carry=True)
    assert {r.id: r.state for r in found.collect()} == {1: "conflict", 2: "admitted", 3: "unpositioned", 4: "excluded"}
    assert [tuple(r) for r in history.session_days(found, 0, 100, session=7).collect()] == [(0, "codex", 7, 0, 1)]
    assert history.session_days(found, 0, 100, session=8).count() == 0
    assert [r.busy_ms for r in history.busy_days(found, 0, 100, session=7).collect()] == [15]


def test_usage_history_keeps_unknown_and_conflicting_responses_apart(spark):
    from traceloom.operators import selected

    copies = [(1, 1, 5, 1, "response", "eligible", "source_terminal", 4), (2, 1, 5, 1, "response", "eligible", "source_terminal", 4), (1, 2, 5, 2, "response", "eligible", "source_terminal", 4), (2, 2, 5, 2, "response", "eligible", "source_terminal", 5),
              (1, 3, 5, 3, "response", "provisional", "streaming", None), (1, 4, 5, 4, "response", "eligible", "source_terminal", 4), (1, 5, 5, None, "response", "eligible", "source_terminal", 4), (1, 6, 5, 6, "cumulative", "eligible", "source_terminal", 4), (1, 7, 5, 7, "response", "eligible", "source_terminal", 4)]
    seen = [(1, 1, "ordinary", "source_terminal", 4, 50), (2, 1, "ordinary", "source_terminal", 4, 40), (1, 3, "ordinary", "streaming", None, None), (1, 4, "ambiguous", "source_terminal", 4, 10), (1, 7, "ordinary", "source_terminal", 9, 10), (1, 7, "ordinary", "source_terminal", 4, 10)]
    out = selected.usage_history(
        spark.createDataFrame(copies, "source_id long, usage_id long, session_id long, response_id long, scope string, selection string, finality string, n long"),
        spark.createDataFrame(seen, "source_id long, usage_id long, origin string, o_finality string, o_n long, seen_ms long"), ["n"], 0, 100,
    )
    got = {r.response_id: (r.copies, r.state, r.reason, r.selection, r.first_seen_ms, r.n) for r in out.collect()}
    assert got == {
        1: (2, "dated", None, "final", 40, 4), 2: (2, "excluded", "response_conflict", None, None, None), 3: (1, "undated", None, "provisional", None, None),
        4: (1, "excluded", "missing_usage_proof", None, None, None), 7: (1, "excluded", "terminal_observation_conflict", None, None, None),
    }


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_union_in_blocks_equals_unit_cells(spark, block):
    rows = [(i, k if k % 5 else None, s - 15, e - 15, t) for i, k, s, e, t in population(11)]
    cells: dict = {}
    for _, k, s, e, _ in rows:
        cells.setdefault(k, set()).update(range(s, e))
    got = {r.k: r for r in intervals.union_length(rows_of(spark, rows), ["k"], block).collect()}
    assert {k: r.union_ms for k, r in got.items()} == {k: len(c) for k, c in cells.items()}
    assert {k: r.excess_ms + r.union_ms for k, r in got.items()} == {k: sum(e - s for _, j, s, e, _ in rows if j == k) for k in cells}


@pytest.mark.parametrize("block", [1, 4, 9])
def test_sweep_in_blocks_equals_one_block(spark, block):
    df = rows_of(spark, [(i, k if k % 5 else None, s - 15, e - 15, t) for i, k, s, e, t in population(13)])
    for of in (intervals.concurrency, intervals.exclusive):
        want, got = (sorted(map(str, of(intervals.sweep(df, ["k"], "kind", b), ["k"]).collect())) for b in (1000, block))
        assert want and got == want


@pytest.mark.parametrize("width", [1, 3, 64, 1 << 20])
def test_running_values_equal_a_pass_in_order(spark, width):
    draw = numbers(width)
    rows = [(i * (1 + i % 3 * 50) - 100, next(draw) % 3 or None, next(draw) % 4 or None) for i in range(1, 90)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "at long, k long, v long")
    got = blocks.running(df, ["k"], "at", width, sums={"upto": F.col("v")}, previous={"before": "v"}, following={"after": "v", "next_at": "at"})
    got = blocks.running(got, ["k"], "at", width, sums={"earlier": F.col("v")}, inclusive=False)
    want = []
    for k in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: r[0])
        for i, (at, _, v) in enumerate(mine):
            earlier = sum(r[2] or 0 for r in mine[:i])
            after = mine[i + 1] if i + 1 < len(mine) else (None, k, None)
            want.append((at, k, v, earlier + (v or 0), mine[i - 1][2] if i else None, after[2], after[0], earlier))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert blocks.running(df.where("false"), ["k"], "at", width, sums={"upto": F.col("v")}, previous={"before": "v"}).collect() == []


def test_chains_runs_and_flags_in_blocks_equal_one_block(spark):
    draw = numbers(3)
    df = rows_of(spark, [(i * 3, next(draw) % 4 or None, i, i + 5, "fsx"[next(draw) % 3]) for i in range(200)])
    failed, success = F.col("kind") == "f", F.col("kind") == "s"
    for of in (
        lambda w: sequences.recovery_chains(df, ["k"], failed, success, "id", w), lambda w: sequences.runs(df, ["k"], ["kind"], "id", w), lambda w: gates.propagate(df, ["k"], F.col("id") % 17 == 0, "id", w),
    ):
        want = sorted(map(str, of(1 << 20).collect()))
        assert want and sorted(map(str, of(7).collect())) == want


def test_periods():
    assert history.parse_period("2024-01-15T00:00:00Z", "2024-01-15T00:00:00.5Z") == (1_705_276_800_000, 1_705_276_800_500)
    assert history.parse_period("2024-01-01T00:00:00Z", "2025-01-01T00:00:00Z")[1] - 366 * history.DAY == history.parse_period("2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00Z")[0]
    for pair in (("2024-01-01", "2024-01-02"), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), ("2023-02-30T00:00:00Z", "2023-03-02T00:00:00Z"), ("2024-01-01T00:00:00+00:00", "2024-01-02T00:00:00Z"), ("2024-01-01T00:00:00.1234Z", "2024-01-02T00:00:00Z"), ("2024-01-01T00:00:00Z", "2025-01-01T00:00:00.001Z"), (None, "2024-01-02T00:00:00Z"), ("2024-01-01T24:01:00Z", "2024-01-02T00:00:00Z")):
        with pytest.raises(ValueError):
            history.parse_period(*pair)


def test_rule_overlap_sweeps_united_intervals_once(spark):
    """Equal to a count of milliseconds, over borders of days; no union of copies and no decimal codes in the plan."""
    import random

    from traceloom.operators import intervals, relations

    rng = random.Random(4)
    rows = []
    for k in range(300):
        at = intervals.DAY * rng.randrange(3) + rng.choice((-60, 20)) + rng.randrange(60)
        rows.append((k, k % 3, rng.choice("xyz"), at, at + rng.randrange(25)))
    found = relations.rule_overlap(spark.createDataFrame(rows, "id long, session_id long, rule string, start_ms long, end_ms long"), ["session_id"], "rule")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "decimal" not in plan
    for r in found.collect():
        busy = {}
        for _, s, rule, a, b in rows:
            if s == r.session_id:
                for t in range(a, b):
                    busy.setdefault(t, set()).add(rule)
        sums = [sum(map(len, busy.values())), len(busy), sum(len(x) > 1 for x in busy.values())]
        assert [r.rule_ms, r.union_ms, r.overlap_ms, r.excess_ms] == [*sums, sums[0] - sums[1]]
