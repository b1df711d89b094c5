"""Message graphs, roots, membership over revisions and bounded results, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import graphs
from traceloom.sources import membership, results, roots
from traceloom.sources.driver_tables import EVENTS_SQL, events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_MESSAGES = {"stream": "CAST(floor(id / 2000) AS bigint)", "parent": "CASE WHEN id % 2000 = 0 OR id % 97 = 0 THEN NULL WHEN id % 211 = 3 THEN -id WHEN id % 389 = 7 THEN id + 3 ELSE id - 1 END", "digest": "tool"}
_COPIES = {"parent": "CASE WHEN id % 302 = 1 THEN id - 2 ELSE NULL END", "digest": "CASE WHEN id % 453 = 1 THEN 'other' ELSE tool END"}


@query(f"""WITH RECURSIVE {EVENTS_SQL}, m AS (SELECT id, {', '.join(f'{e} AS {n}' for n, e in _MESSAGES.items())} FROM ev), k AS (SELECT a.*, CASE WHEN id % 151 = 1 THEN 2 ELSE 1 END AS copies, id % 151 = 1 AND id % 453 = 1 AS conflicted, EXISTS (FROM m b WHERE b.stream = a.stream AND b.id = a.parent) AS there FROM m a),
w AS (SELECT stream, id, id AS root, CAST(0 AS BIGINT) AS depth FROM k WHERE parent IS NULL OR NOT there UNION ALL SELECT k.stream, k.id, w.root, w.depth + 1 FROM w JOIN k ON k.stream = w.stream AND k.parent = w.id AND k.there)
SELECT k.stream, k.id, k.parent, w.root, w.depth, CASE WHEN k.parent IS NULL THEN 'root' WHEN NOT there THEN 'missing_parent' WHEN w.id IS NULL THEN 'cycle' ELSE 'linked' END AS state, CAST(k.copies AS BIGINT) AS copies, conflicted FROM k LEFT JOIN w ON w.stream = k.stream AND w.id = k.id""")
def message_depths(spark, sf_dir):
    """Chains of up to two thousand messages; some parents are missing, some lead into a circle, some messages come twice."""
    rows = events(spark, sf_dir)
    first = rows.selectExpr("id", *[f"{e} AS {n}" for n, e in _MESSAGES.items()], "0 AS copy")
    again = first.withColumnRenamed("digest", "tool").where("id % 151 = 1").selectExpr("id", "stream", *[f"{e} AS {n}" for n, e in _COPIES.items()], "1 AS copy")
    nodes = graphs.messages(first.unionByName(again), ["stream"], "digest", "copy")
    return graphs.roots(nodes, ["stream"]).select("stream", "id", "parent", "root", "depth", "state", "copies", "conflicted")


_PATH = "concat('/logs/u', CAST(session_id AS varchar(20)), '/', tool, '/', CAST(id AS varchar(20)), CASE WHEN id % 31 = 4 THEN '.jsonl.GZ' WHEN id % 37 = 5 THEN '.txt' ELSE '.jsonl' END)"
_ROOTS = """SELECT '/logs/' AS root, 'codex' AS provider UNION SELECT concat('/logs/u', CAST(session_id AS varchar(20))), CASE WHEN session_id % 10 = 3 THEN 'claude' ELSE 'codex' END FROM {ev} WHERE session_id % 10 IN (3, 4)
UNION SELECT concat('/logs/u', CAST(session_id AS varchar(20)), '/view//'), 'codex' FROM {ev} WHERE session_id % 10 = 4 UNION SELECT concat('/logs/u', CAST(session_id AS varchar(20)), '/cl'), 'claude' FROM {ev} WHERE session_id % 10 = 5"""


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT {_PATH} AS path, id % 41 = 6 AS is_link FROM ev), r AS (SELECT rtrim(root, '/') AS root, provider FROM ({_ROOTS.format(ev='ev')})),
j AS (SELECT path, arg_max(root, length(root)) AS root, arg_max(provider, length(root)) AS provider, count(DISTINCT provider) AS n FROM p JOIN r ON starts_with(path, root || '/') OR path = root GROUP BY path),
o AS (SELECT p.path, j.root, j.provider, CASE WHEN is_link THEN 'symlink_skipped' WHEN lower(p.path) LIKE '%.jsonl.gz' THEN 'unsupported_compression' WHEN NOT ends_with(p.path, '.jsonl') THEN 'not_a_log' WHEN n IS NULL THEN 'outside' WHEN n > 1 THEN 'ambiguous_provider' ELSE 'source' END AS outcome FROM p LEFT JOIN j USING (path))
SELECT path, CASE WHEN outcome = 'source' THEN root END AS root, CASE WHEN outcome = 'source' THEN provider END AS provider, outcome FROM o""")
def owned_paths(spark, sf_dir):
    """Paths under several roots, of which some are inside others."""
    rows = events(spark, sf_dir)
    rows.createOrReplaceTempView("traceloom_paths")
    return roots.owned(rows.selectExpr(f"{_PATH} AS path", "id % 41 = 6 AS is_link"), spark.sql(_ROOTS.format(ev="traceloom_paths")))


_SEEN = """sl AS (SELECT session_id AS source_id, id, 1 + id * 8 // (SELECT max(id) + 1 FROM ev) AS revision FROM ev), se AS (SELECT DISTINCT source_id % 4 AS root, source_id, revision FROM sl WHERE id % 11 = 0 UNION SELECT DISTINCT 9, source_id, revision FROM sl WHERE source_id % 10 = 0 AND id % 13 = 0),
ce AS (SELECT root, revision FROM (SELECT DISTINCT root FROM se), (SELECT unnest(range(1, 9)) AS revision) WHERE NOT (root = 2 AND revision = 4)), sc AS (SELECT se.* FROM se JOIN ce USING (root, revision)),
st AS (SELECT sc.* FROM sc LEFT JOIN (SELECT root, revision, lag(revision) OVER (PARTITION BY root ORDER BY revision) AS before FROM ce) p USING (root, revision) WHERE NOT EXISTS (FROM sc s WHERE s.root = sc.root AND s.source_id = sc.source_id AND s.revision = p.before)),
iv AS (SELECT st.root, st.source_id, st.revision AS from_revision, min(ce.revision) AS to_revision FROM st LEFT JOIN ce ON ce.root = st.root AND ce.revision > st.revision AND NOT EXISTS (FROM sc s WHERE s.root = st.root AND s.source_id = st.source_id AND s.revision = ce.revision) GROUP BY ALL)"""


def _held(spark, sf_dir):
    rows = events(spark, sf_dir)
    most = rows.agg(F.max("id")).first()[0] or 0
    slices = rows.select(F.col("session_id").alias("source_id"), "id", (1 + F.expr(f"id * 8 div {most + 1}")).alias("revision"))
    own = slices.where("id % 11 = 0").select(F.pmod("source_id", F.lit(4)).cast("long").alias("root"), "source_id", "revision")
    seen = own.unionByName(slices.where("source_id % 10 = 0 AND id % 13 = 0").select(F.lit(9).cast("long").alias("root"), "source_id", "revision")).distinct()
    censuses = seen.select("root").distinct().select("root", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("revision")).where("NOT (root = 2 AND revision = 4)")
    return membership.intervals(censuses, seen), censuses


@query(f"WITH {EVENTS_SQL}, {_SEEN} SELECT * FROM iv")
def membership_intervals(spark, sf_dir):
    """From when to when each root held each source, over eight listings, one of them incomplete."""
    return _held(spark, sf_dir)[0]


@query(f"""WITH {EVENTS_SQL}, {_SEEN}, a AS (SELECT root, source_id, from_revision, CASE WHEN root = 1 AND from_revision < 5 AND coalesce(to_revision > 5, true) THEN 5 ELSE to_revision END AS to_revision FROM iv UNION ALL SELECT root, source_id, 5, to_revision FROM iv WHERE root = 1 AND from_revision < 5 AND coalesce(to_revision > 5, true)),
b AS (SELECT root, source_id, from_revision, CASE WHEN root = 3 AND from_revision < 6 AND coalesce(to_revision > 6, true) THEN 6 ELSE to_revision END AS to_revision FROM a UNION ALL SELECT 8, source_id, 6, to_revision FROM a WHERE root = 3 AND from_revision < 6 AND coalesce(to_revision > 6, true))
SELECT root, source_id, from_revision, to_revision FROM b WHERE NOT (root = 0 AND coalesce(to_revision <= 7, false) AND source_id % 3 = 0)""")
def membership_maintenance(spark, sf_dir):
    """One root is reset, one goes on under another name, one forgets what is gone for good."""
    held, censuses = _held(spark, sf_dir)
    one = lambda ddl, *values: spark.createDataFrame([values], ddl)
    held = membership.reset(held, one("root long, revision long", 1, 5), censuses)
    held = membership.rebind(held, one("root long, to_root long, revision long", 3, 8, 6))
    return membership.prune(held, one("root long, revision long", 0, 7), events(spark, sf_dir).select(F.col("session_id").alias("source_id")).where("source_id % 3 = 0"))


@query(f"""WITH {EVENTS_SQL}, {_SEEN}, nw AS (SELECT * FROM iv WHERE from_revision <= 8 AND coalesce(to_revision > 8, true)), mi AS (SELECT DISTINCT source_id FROM iv WHERE root = 0 EXCEPT SELECT source_id FROM nw WHERE root = 0),
so AS (SELECT DISTINCT session_id AS source_id, session_id % 6 AS revision, session_id % 6 + CASE WHEN session_id % 7 = 2 THEN 1 ELSE 0 END AS last_revision, CASE WHEN session_id % 5 = 1 THEN 'unavailable' ELSE 'available' END AS availability FROM ev WHERE session_id % 16 <> 8),
j AS (SELECT mi.source_id, (SELECT count(*) FROM nw WHERE nw.source_id = mi.source_id AND root <> 0) AS blocking_roots, so.revision, so.last_revision, so.availability FROM mi LEFT JOIN so USING (source_id)),
k AS (SELECT *, CASE WHEN blocking_roots > 0 THEN 'other_root_observed' WHEN availability IS NULL THEN 'not_stored' WHEN availability = 'unavailable' THEN NULL WHEN revision <> last_revision THEN 'source_changed' END AS reason FROM j)
SELECT source_id, CASE WHEN reason IS NOT NULL THEN 'retained' WHEN availability = 'unavailable' THEN 'already_unavailable' ELSE 'marked_unavailable' END AS status, reason, blocking_roots, revision + CASE WHEN reason IS NULL AND availability <> 'unavailable' THEN 1 ELSE 0 END AS revision_after FROM k""")
def membership_retirement(spark, sf_dir):
    """What becomes of sources that the first root no longer holds; another root's observation keeps one."""
    held, _ = _held(spark, sf_dir)
    stored = events(spark, sf_dir).where("session_id % 16 <> 8").selectExpr("session_id AS source_id", "session_id % 6 AS revision", "session_id % 6 + CASE WHEN session_id % 7 = 2 THEN 1 ELSE 0 END AS last_revision", "CASE WHEN session_id % 5 = 1 THEN 'unavailable' ELSE 'available' END AS availability").distinct()
    return membership.retirement(held, stored, 0, 8)


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT session_id, strlen(CAST(json_object('schema', 'timeline/v1', 'ok', true, 'command', 'timeline', 'result', json_object('session_id', session_id, 'id', id, 'tool', tool, 'op_key', CASE WHEN id % 9 <> 0 THEN op_key END, 'end_ms', end_ms)) AS VARCHAR)) + 1 AS b FROM ev)
SELECT session_id, count(*) AS lines, CAST(sum(b) AS BIGINT) AS bytes, sum(b) > 10000 AS refused FROM r GROUP BY session_id""")
def bounded_results(spark, sf_dir):
    """The size of each session's result, and whether it is refused whole, before a line of it is written."""
    rows = events(spark, sf_dir).select("session_id", "id", "tool", F.when(F.col("id") % 9 != 0, F.col("op_key")).alias("op_key"), "end_ms")
    return results.measured(rows, ["session_id"], "timeline/v1", "timeline", limit=10_000)
