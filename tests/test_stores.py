"""Message graphs, roots of paths, membership over revisions, bounded results."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import graphs
from traceloom.sources import membership, results, roots


def climbed(parents):
    """Root, depth and state of each node, by walking up."""
    out = {}
    for node in parents:
        at, depth, seen = node, 0, {node}
        while parents[at] is not None and parents[at] in parents:
            at, depth = parents[at], depth + 1
            if at in seen:
                at = None
                break
            seen.add(at)
        kind = "root" if parents[node] is None else "missing_parent" if parents[node] not in parents else "linked" if at is not None else "cycle"
        out[node] = (at, depth if at is not None else None, kind)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_roots_by_walking(spark, seed):
    rng = random.Random(seed)
    parents = {k: rng.choice([None, k, 9999, rng.randrange(300), k - 1, k - 1, k - 1]) for k in range(300)}
    nodes = spark.createDataFrame([(s, k, p) for s in (1, None) for k, p in parents.items() if s == 1], "stream long, id long, parent long")
    got = {r.id: (r.root, r.depth, r.state) for r in graphs.roots(nodes, ["stream"]).collect()}
    assert got == climbed(parents)
    assert {s for _, _, s in got.values()} == {"root", "missing_parent", "linked", "cycle"}


def test_a_long_chain_takes_few_rounds(spark):
    n = 50_000
    nodes = spark.range(n).select(F.lit("s").alias("stream"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = graphs.roots(nodes, ["stream"])
    assert got.where("root = 0 AND depth = id").count() == n
    assert graphs.roots(nodes.where("false"), ["stream"]).count() == 0


def test_copies_of_messages(spark):
    rows = spark.createDataFrame([("s", "a", None, "x", 1), ("s", "a", "b", "x", 2), ("s", "b", "a", "y", 3), ("s", "b", "a", "z", 4)], "stream string, id string, parent string, digest string, at long")
    got = {r.id: (r.parent, r.copies, r.conflicted) for r in graphs.messages(rows, ["stream"], "digest", "at").collect()}
    assert got == {"a": (None, 2, False), "b": ("a", 2, True)}


def test_paths_and_roots(spark):
    held = [("/a", "codex"), ("/a/b/", "codex"), ("/a/c", "claude"), ("/a/cc.jsonl", "codex"), ("/", "codex"), ("/a", "codex")]
    paths = {
        "/a/x.jsonl": ("/a", "codex", "source"), "/a/b/x.jsonl": ("/a/b", "codex", "source"), "/a/bb/x.jsonl": ("/a", "codex", "source"), "/a/c/x.jsonl": (None, None, "ambiguous_provider"), "/a/cc.jsonl": ("/a/cc.jsonl", "codex", "source"),
        "/z.jsonl": ("/", "codex", "source"), "/a/x.jsonl.Zst": (None, None, "unsupported_compression"), "/a/x.json": (None, None, "not_a_log"), "/a/link.jsonl": (None, None, "symlink_skipped"), "rel/x.jsonl": (None, None, "outside"),
    }
    rows = [(p, "link" in p) for p in paths] + [("/a/x.jsonl", False)]
    got = {r.path: (r.root, r.provider, r.outcome) for r in roots.owned(spark.createDataFrame(rows, "path string, is_link boolean"), spark.createDataFrame(held, "root string, provider string")).collect()}
    assert got == paths


def test_membership_by_revision(spark):
    rng = random.Random(3)
    censuses = [(r, v) for r in "ab" for v in range(1, 9) if (r, v) != ("b", 5)]
    seen = {(r, s, v) for r in "ab" for s in range(6) for v in range(1, 9) if rng.random() < 0.5}
    held = membership.intervals(spark.createDataFrame(censuses, "root string, revision long"), spark.createDataFrame([*seen] * 2, "root string, source_id long, revision long"))
    for v in range(1, 9):
        at = {r: max(x for q, x in censuses if q == r and x <= v) for r in "ab"}  # the last complete listing tells
        assert {(r.root, r.source_id) for r in membership.as_of(held, v).collect()} == {(r, s) for r, s, x in seen if x == at[r]}
    one = lambda ddl, *values: spark.createDataFrame([values], ddl)
    cut = membership.reset(held, one("root string, revision long", "b", 5), spark.createDataFrame(censuses, "root string, revision long"))
    assert not [r for r in membership.as_of(cut, 5).collect() if r.root == "b"]  # no complete listing yet
    assert {(r.root, r.source_id) for r in membership.as_of(cut, 6).collect()} == {(r.root, r.source_id) for r in membership.as_of(held, 6).collect()}
    moved = membership.rebind(held, one("root string, to_root string, revision long", "a", "c", 4))
    was = {r.source_id for r in membership.as_of(held, 3).collect() if r.root == "a"} & {r.source_id for r in membership.as_of(held, 4).collect() if r.root == "a"}
    assert {r.source_id for r in membership.as_of(moved, 4).collect() if r.root == "c"} == was


def test_results_are_whole_or_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", None), (2, "x" * 50, "y")], "a long, b string, c string")
    told = [r.value for r in results.lines(rows, "s/v1", "list").collect()]
    assert told[0] == '{"schema":"s/v1","ok":true,"command":"list","result":{"a":1,"b":"é","c":null}}'
    size = sum(len(t.encode()) + 1 for t in told)
    with pytest.raises(results.TooLarge):
        results.publish(rows, str(tmp_path / "no"), "s/v1", "list", limit=size - 1)
    assert not (tmp_path / "no").exists()
    assert results.publish(rows, str(tmp_path / "yes"), "s/v1", "list", limit=size) == size
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "yes")).collect()) == sorted(told)
