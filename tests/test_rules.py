"""Rules over the order of sessions against plain loops, for any width of the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import blocks, rules

DDL = """id long, source_id long, session_id long, byte_offset long, turn_id long, kind string, category string, tool_name string, status string, outcome string, op_key string, validation_scope string,
start_ms long, end_ms long, lookup_key string, admitted boolean, position_reason string, partition_status string, suppressed string, provider string, unsupported_records int, error_class string, error_key string"""


def made(seed, sessions=8, n=90):
    """Sessions in order; times never go back."""
    rng, out, k = random.Random(seed), [], 0
    for s in range(sessions):
        ms = rng.randrange(10**6)
        for _ in range(rng.randrange(n)):
            k += 1
            what = rng.choice(["edit", "test", "test", "test", "read", "search", "search", "search", "other"] if s % 2 else ["search"] * 8 + ["read", "edit" if rng.random() < 0.2 else "search"])
            kind = {"edit": "file_edit", "test": "shell", "read": "file_read", "search": "search", "other": "mcp" if rng.random() < 0.2 else "file_read"}[what]
            good = rng.random() < 0.6
            start = ms + rng.randrange(1, 40_000)
            ms = start + rng.randrange(1, 9000)
            out.append((k, s % 3, s, k * 7, rng.choice([1, 1, 1, 2, None]) if s == 3 else k // 17, kind, "read" if what == "other" and kind != "mcp" else "mcp" if kind == "mcp" else what,
                        {"file_edit": "Edit", "file_read": "Read", "search": "Grep"}.get(kind, "Bash"), "completed" if good or what != "test" else "failed", ("success" if good or what != "test" else "error") if rng.random() < 0.95 else "unknown",
                        rng.choice(["a", "a", "a", "b", None]), rng.choice(["full", "full", "unknown"]), start, ms, rng.choice("xy"), True, None, "evaluated", None, "claude", 0, "exit", rng.choice(["e", "e", "f", None])))
    return out


FIELDS = [x.split()[0] for x in DDL.replace("\n", " ").split(", ")]


def sessions_of(rows):
    out = {}
    for r in (dict(zip(FIELDS, x, strict=True)) for x in rows):
        out.setdefault((r["source_id"], r["session_id"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["byte_offset"]) for k, v in out.items()}


@pytest.fixture(scope="module")
def table(spark):
    rows = made(4, sessions=14, n=140)
    return rows, spark.createDataFrame(random.sample(rows, len(rows)), DDL)


def windows_by_hand(points, least, window):
    """Merged trailing windows of (ms, id) in order: first, last, members, windows."""
    points, out = sorted(points), []
    for r in range(len(points)):
        left = next(k for k in range(r + 1) if points[r][0] - points[k][0] <= window)
        if r - left + 1 >= least:
            if out and left <= out[-1][1]:
                out[-1][1], out[-1][2] = r, out[-1][2] + 1
            else:
                out.append([left, r, 1])
    return sorted((*points[a], *points[b], b - a + 1, n) for a, b, n in out)


@pytest.mark.parametrize(("span", "width"), [(1, 3), (50, 1000), (1 << 24, 1 << 20)])
def test_episodes_with_ties(spark, span, width):
    rng = random.Random(span)
    rows = [(g, rng.randrange(700) if g else 5, k) for k, g in enumerate(rng.choices([0, 1, 2, None], k=160))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g long, end_ms long, id long, rank string")
    got = rules.episodes(df.drop("rank"), ["g"], 4, 30, span=span, width=width).collect()
    for g in (0, 1, 2, None):
        assert sorted((r.first_ms, r.first_id, r.last_ms, r.last_id, r.members, r.windows) for r in got if r.g == g) == windows_by_hand([(ms, k) for h, ms, k in rows if h == g], 4, 30)


def cycles_by_hand(rows):
    """The steps of one session, one after the other."""
    out, edits, active, loose, waiting, turn = [], [], None, 0, 0, ()
    for r in rows:
        if turn not in ((), r["turn_id"]):
            active, waiting, edits = None, waiting + len(edits), []
        turn = r["turn_id"]
        ended = (r["status"], r["outcome"]) in (("completed", "success"), ("failed", "error"))
        if r["kind"] == "file_edit":
            active = None
            edits.append(r)
        elif r["kind"] == "shell" and r["category"] in ("test", "build"):
            if not ended:
                active, waiting, edits, loose = None, waiting + len(edits), [], loose + 1
            elif edits:
                active = {"edits": edits, "checks": [r]}
                out.append(active)
                edits = []
            elif active and r["op_key"] is not None and r["op_key"] == active["checks"][0]["op_key"]:
                active["checks"].append(r)
            else:
                active, loose = None, loose + 1
    return out, loose, waiting + len(edits)


@pytest.mark.parametrize("width", [7, 200, 1 << 20])
def test_cycles_by_hand(table, width):
    rows, df = table
    got = {(r.source_id, r.session_id, r.first_validation_id): r for r in rules.cycles(df, width).collect()}
    want = {(*key, c["checks"][0]["id"]): c for key, mine in sessions_of(rows).items() for c in cycles_by_hand(mine)[0]}
    assert set(got) == set(want) and len(want) > 8
    for k, c in want.items():
        good = [r["id"] for r in c["checks"] if r["status"] == "completed"]
        assert (got[k].edits, got[k].validations, got[k].first_edit_id, got[k].success_id, got[k].resolved) == (len(c["edits"]), len(c["checks"]), c["edits"][0]["id"], good[0] if good else None, bool(good))


def test_sessions_of_cycles(spark, table):
    rows, df = table
    why = spark.createDataFrame([(*k, ["overlapping_actions"] if k[1] == 1 else []) for k in sessions_of(rows)], "source_id long, session_id long, reasons array<string>")
    got = {(r.source_id, r.session_id): r for r in rules.cycle_sessions(rules.usable(df, why), why, 40).collect()}
    for key, mine in sessions_of(rows).items():
        found, loose, waiting = cycles_by_hand(mine)
        r = got[key]
        assert (r.cycle_n, r.without_edit_n, r.awaiting_edit_n) == ((None,) * 3 if key[1] == 1 else (len(found), loose, waiting))
        if found and key[1] != 1:
            assert r.first_pass_rate == sum(c["checks"][0]["status"] == "completed" for c in found) / len(found)
        elif key[1] == 1:
            assert r.first_pass_rate is None and r.reasons == ["overlapping_actions"]


def crowded_by_hand(mine):
    look = [r for r in mine if r["kind"] in ("search", "file_read")]
    if len(look) < 20:
        return None
    for at in sorted({r["end_ms"] for r in look}):
        near = [r for r in look if at - 600_000 <= r["end_ms"] <= at]
        keys = [r["lookup_key"] for r in near if r["kind"] == "search"]
        most = max((keys.count(k) for k in keys), default=0)
        meets = lambda kind: sum(r["kind"] == kind and r["start_ms"] <= at and r["end_ms"] >= at - 600_000 for r in mine)  # noqa: B023, E731
        opaque = sum(r["kind"] not in ("search", "file_read", "file_edit") and r["start_ms"] <= at and r["end_ms"] >= at - 600_000 for r in mine)
        if len(near) >= 20 and most >= 5 and meets("file_edit") <= 1 and opaque == 0:
            return at, len(near), most
    return None


@pytest.mark.parametrize("width", [5000, 1 << 20])
def test_exploration_by_hand(spark, width):
    rows = [tuple("completed" if f == "status" and r[FIELDS.index("kind")] in ("search", "file_read") else v for f, v in zip(FIELDS, r, strict=True)) for r in made(9, sessions=10, n=120)]
    got = {(r.source_id, r.session_id): r for r in rules.exploration(spark.createDataFrame(rows, DDL), width).collect()}
    found = 0
    for key, mine in sessions_of(rows).items():
        want = crowded_by_hand(mine)
        assert ((got[key].last_ms, got[key].lookups, got[key].most_same) if got[key].status == "candidate" else None) == want
        found += want is not None
    assert found > 2


def test_blocked_sessions_have_nothing(spark, table):
    rows, df = table
    why = df.select("source_id", "session_id").distinct().withColumn("reasons", F.array(F.lit("overlapping_actions")))
    shut = rules.usable(df, why)
    assert shut.count() == 0
    for rule in (rules.retry_loops, rules.validation_thrashes, rules.cycles):
        assert rule(shut).count() == 0


def test_empty_and_any_width_of_numbered(spark):
    rows = [(g, k, v) for g in (1, None) for k, v in enumerate([None, None, 3, 3, None, 4, 4, 4, 3])]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    want = [1, 1, 2, 2, 3, 4, 4, 4, 5]
    for width in (1, 2, 4, 100):
        got = blocks.numbered(df, ["g"], "k", F.struct("v"), lambda a, b: ~a["v"].eqNullSafe(b["v"]), "n", width)
        for g in (1, None):
            assert [r.n for r in sorted(got.collect(), key=lambda r: r.k) if r.g == g] == want
    assert rules.episodes(df.where("false").withColumnRenamed("v", "end_ms").withColumnRenamed("k", "id"), ["g"], 3, 10).count() == 0


def test_attempts_are_not_shuffled_for_a_few_mixed_operations(spark, table, tmp_path):
    """Nor are columns written that no rule reads."""
    rows, df = table
    why = spark.createDataFrame([(*k, []) for k in sessions_of(rows)], "source_id long, session_id long, reasons array<string>")
    mine = rules.usable(df, why)
    assert "provider" not in mine.columns and {"op_key", "turn_id", "end_ms"} <= set(mine.columns)
    known, lacking = rules._retries(mine)
    assert "Exchange hashpartitioning" not in known._jdf.queryExecution().executedPlan().toString()
    shut = {k for k, mine in sessions_of(rows).items() if any(r["kind"] in ("shell", "mcp") and (r["op_key"] is None or r["turn_id"] is None) for r in mine)}
    assert {tuple(r) for r in lacking.collect()} == shut
    classes = {}
    for k, mine in sessions_of(rows).items():
        for r in mine if k not in shut else []:
            if r["kind"] in ("shell", "mcp"):
                classes.setdefault((*k, r["turn_id"], r["op_key"]), set()).add((r["kind"], r["category"], r["tool_name"]))
    got = known.select("source_id", "session_id", "turn_id", "op_key", "mixed").distinct().collect()
    assert {tuple(r)[:4]: r.mixed for r in got} == {k: len(v) > 1 for k, v in classes.items()}
