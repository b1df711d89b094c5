"""Rules over sessions whose order nothing blocks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import rules
from traceloom.sources.action_tables import ACTIONS_SQL, actions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_USABLE = f"""WITH {ACTIONS_SQL}, re AS (SELECT *, kind <> 'model' AND category <> 'model' AS rel FROM ac), pl AS (SELECT * FROM re WHERE rel AND admitted AND position_reason IS NULL),
wn AS (SELECT source_id, session_id, byte_offset = lag(byte_offset) OVER x AS tie, start_ms < lag(end_ms) OVER x AS over_, start_ms <= lag(start_ms) OVER x OR end_ms <= lag(end_ms) OVER x AS back_ FROM pl WINDOW x AS (PARTITION BY source_id, session_id ORDER BY byte_offset, id)),
why AS (SELECT source_id, session_id, suppressed AS reason FROM ac WHERE suppressed IS NOT NULL
  UNION SELECT source_id, session_id, 'provenance_unresolved' FROM ac WHERE partition_status = 'provenance_unresolved' UNION SELECT source_id, session_id, 'incomplete_temporal_context' FROM ac WHERE coverage <> 'recognized_shapes' OR unsupported_records > 0
  UNION SELECT source_id, session_id, 'opaque_action_in_stream' FROM re WHERE rel AND (kind IN ('other', 'skill', 'subagent', 'mcp', 'browser') OR (kind = 'shell' AND category NOT IN ('test', 'build', 'search', 'read')))
  UNION SELECT source_id, session_id, 'nonterminal_or_unadmitted_action' FROM re WHERE rel AND NOT admitted UNION SELECT source_id, session_id, 'unpositioned_action' FROM re WHERE rel AND admitted AND position_reason IS NOT NULL
  UNION SELECT source_id, session_id, 'unconfirmed_edit_effect' FROM re WHERE rel AND kind IN ('file_edit', 'file_write') AND (status <> 'completed' OR outcome <> 'success') UNION SELECT source_id, session_id, 'missing_turn_identity' FROM re WHERE rel AND provider = 'codex' AND turn_id IS NULL
  UNION SELECT source_id, session_id, 'inconsistent_source_file' FROM pl GROUP BY 1, 2 HAVING count(DISTINCT file_id) > 1 UNION SELECT source_id, session_id, 'mixed_interval_contracts' FROM pl GROUP BY 1, 2 HAVING count(DISTINCT interval_scope || interval_evidence) > 1
  UNION SELECT source_id, session_id, 'ambiguous_source_order' FROM wn WHERE tie UNION SELECT source_id, session_id, 'overlapping_actions' FROM wn WHERE over_ UNION SELECT source_id, session_id, 'tied_or_contradictory_boundaries' FROM wn WHERE back_),
bl AS (SELECT s.source_id, s.session_id, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM (SELECT DISTINCT source_id, session_id FROM ac) s LEFT JOIN why USING (source_id, session_id) GROUP BY ALL),
us AS (SELECT pl.* FROM pl JOIN bl USING (source_id, session_id) WHERE reasons = '')"""
_SESSION = "source_id, session_id"


def _episodes(name: str, rows: str, keys: str, least: int, window: int) -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY end_ms, id) - 1 AS r, count(*) OVER (PARTITION BY {keys} ORDER BY end_ms RANGE BETWEEN UNBOUNDED PRECEDING AND {window + 1} PRECEDING) AS l FROM {rows}),
{name}1 AS (SELECT f.*, g.end_ms AS left_ms, g.id AS left_id FROM {name}0 f JOIN {name}0 g ON {' AND '.join(f'f.{k.strip()} IS NOT DISTINCT FROM g.{k.strip()}' for k in keys.split(','))} AND g.r = f.l WHERE f.r - f.l + 1 >= {least}),
{name}2 AS (SELECT *, CASE WHEN l > lag(r) OVER w THEN 1 ELSE 0 END AS fresh FROM {name}1 WINDOW w AS (PARTITION BY {keys} ORDER BY r)),
{name}3 AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY r) AS e FROM {name}2),
{name} AS (SELECT {keys}, arg_min(left_ms, r) AS first_ms, arg_min(left_id, r) AS first_id, max(end_ms) AS last_ms, arg_max(id, r) AS last_id, max(r) - min(l) + 1 AS members, count(*) AS windows FROM {name}3 GROUP BY {keys}, e)"""


_FOUND = "first_ms, first_id, last_ms, last_id, members, windows"
_RETRY = f"""att AS (SELECT * FROM us WHERE kind IN ('shell', 'mcp')), lck AS (SELECT DISTINCT {_SESSION} FROM att WHERE op_key IS NULL OR turn_id IS NULL), kno AS (SELECT * FROM att ANTI JOIN lck USING ({_SESSION})),
mix AS (SELECT {_SESSION}, turn_id, op_key, count(DISTINCT kind || '/' || category || '/' || tool_name) > 1 AS mixed FROM kno GROUP BY ALL),
fai AS (SELECT kno.*, mixed, CASE WHEN status = 'failed' AND outcome = 'error' AND error_key IS NOT NULL THEN error_class || '/' || error_key END AS err FROM kno JOIN mix USING ({_SESSION}, turn_id, op_key)),
rn0 AS (SELECT *, CASE WHEN err IS DISTINCT FROM lag(err) OVER w THEN 1 ELSE 0 END AS fresh_run FROM fai WHERE NOT mixed WINDOW w AS (PARTITION BY {_SESSION}, turn_id, op_key ORDER BY byte_offset)),
rn1 AS (SELECT *, sum(fresh_run) OVER (PARTITION BY {_SESSION}, turn_id, op_key ORDER BY byte_offset) AS run FROM rn0), rn AS (SELECT * FROM rn1 WHERE err IS NOT NULL),
{_episodes('rl', 'rn', f'{_SESSION}, turn_id, op_key, run', 3, 600_000)}"""
_PROVEN = "coalesce(status = 'completed' AND outcome = 'success' AND lookup_key IS NOT NULL AND content_key IS NOT NULL AND content_state = 'complete' AND change_state = 'unchanged' AND (kind <> 'file_read' OR lookup_range IS NOT NULL), false)"
_CHURN = f"""lk0 AS (SELECT *, kind IN ('file_read', 'search') AS look, {_PROVEN} AS good FROM us), lk1 AS (SELECT *, count(*) FILTER (kind IN ('file_edit', 'file_write') OR (look AND NOT good)) OVER (PARTITION BY {_SESSION} ORDER BY byte_offset) AS epoch FROM lk0),
lk AS (SELECT * FROM lk1 WHERE look AND good), {_episodes('cc', 'lk', f'{_SESSION}, epoch, turn_id, lookup_key, lookup_range, content_key', 4, 600_000)}"""
_CYCLES = f"""st AS (SELECT *, sum(ch) OVER (PARTITION BY {_SESSION} ORDER BY byte_offset) AS stretch FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(turn_id) OVER w IS DISTINCT FROM turn_id THEN 1 ELSE 0 END AS ch FROM us WINDOW w AS (PARTITION BY {_SESSION} ORDER BY byte_offset))),
sp AS (SELECT *, CASE WHEN kind IN ('file_edit', 'file_write') THEN 'edit' WHEN kind = 'shell' AND category IN ('test', 'build') THEN CASE WHEN (status = 'completed' AND outcome = 'success') OR (status = 'failed' AND outcome = 'error') THEN 'validation' ELSE 'unclear' END END AS step FROM st),
s1 AS (SELECT *, lag(step) OVER w AS step0, count(*) FILTER (step <> 'validation') OVER w AS brk, count(*) FILTER (step <> 'edit') OVER w - CASE WHEN step <> 'edit' THEN 1 ELSE 0 END AS checks FROM sp WHERE step IS NOT NULL WINDOW w AS (PARTITION BY {_SESSION}, stretch ORDER BY byte_offset)),
s2 AS (SELECT *, first_value(step0) OVER v AS head0, first_value(op_key) OVER v AS head_op, first_value(checks) OVER v AS head_checks, row_number() OVER v AS nr FROM s1 WHERE step = 'validation' WINDOW v AS (PARTITION BY {_SESSION}, stretch, brk ORDER BY byte_offset)),
s3 AS (SELECT *, coalesce(head0 = 'edit', false) AND count(*) FILTER (nr > 1 AND NOT coalesce(op_key = head_op, false)) OVER (PARTITION BY {_SESSION}, stretch, brk ORDER BY byte_offset) = 0 AS member FROM s2),
ed AS (SELECT {_SESSION}, stretch, checks, count(*) AS edits, arg_min(id, byte_offset) AS first_edit_id FROM s1 WHERE step = 'edit' GROUP BY ALL),
cy AS (SELECT {_SESSION}, arg_min(turn_id, byte_offset) AS turn_id, first_edit_id, edits, arg_min(id, byte_offset) AS first_validation_id, arg_min(end_ms, byte_offset) AS first_validation_ms, count(*) AS validations, CASE WHEN arg_min(status, byte_offset) = 'completed' THEN 'success' ELSE 'failure' END AS first_result,
  arg_min(validation_scope, byte_offset) AS first_scope, count(*) FILTER (status = 'completed') > 0 AS resolved, arg_min(id, byte_offset) FILTER (status = 'completed') AS success_id
  FROM (SELECT * FROM s3 WHERE member) m JOIN (SELECT {_SESSION}, stretch, checks AS head_checks, edits, first_edit_id FROM ed) USING ({_SESSION}, stretch, head_checks) GROUP BY {_SESSION}, stretch, head_checks, first_edit_id, edits)"""
_THRASH = f"{_CYCLES}, vk AS (SELECT * FROM s3 WHERE member AND validation_scope <> 'unknown'), {_episodes('vt', 'vk', f'{_SESSION}, turn_id, validation_scope', 3, 900_000)}"


def _usable(spark, sf_dir):
    rows = actions(spark, sf_dir)
    return rules.usable(rows, rules.blockers(rows))


@query(f"{_USABLE} SELECT * FROM bl")
def action_blockers(spark, sf_dir):
    """What keeps the order of each session from being used."""
    return rules.blockers(actions(spark, sf_dir)).select("source_id", "session_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"{_USABLE}, {_RETRY} SELECT {_SESSION}, turn_id, op_key, {_FOUND} FROM rl")
def gated_retry_loops(spark, sf_dir):
    return rules.retry_loops(_usable(spark, sf_dir))


@query(f"{_USABLE}, {_CHURN} SELECT {_SESSION}, turn_id, lookup_key, lookup_range, content_key, {_FOUND} FROM cc")
def gated_context_churns(spark, sf_dir):
    return rules.context_churns(_usable(spark, sf_dir))


@query(f"{_USABLE}, {_THRASH} SELECT {_SESSION}, turn_id, validation_scope, {_FOUND} FROM vt")
def gated_validation_thrashes(spark, sf_dir):
    return rules.validation_thrashes(_usable(spark, sf_dir))


@query(f"{_USABLE}, {_CYCLES} SELECT * FROM cy")
def edit_cycles(spark, sf_dir):
    return rules.cycles(_usable(spark, sf_dir))


@query(f"""{_USABLE}, {_CYCLES}, cn AS (SELECT {_SESSION}, count(*) AS cycle_n, count(*) FILTER (first_result = 'success') AS first_pass_n, count(*) FILTER (first_scope <> 'unknown') AS scope_known_n, count(*) FILTER (first_scope = 'full') AS full_scope_n, sum(edits) AS used FROM cy GROUP BY ALL),
lo AS (SELECT {_SESSION}, count(*) FILTER (step <> 'edit') AS checks_n, count(*) FILTER (step = 'edit') AS edits_n FROM s1 GROUP BY ALL), me AS (SELECT {_SESSION}, count(*) AS member_n FROM s3 WHERE member GROUP BY ALL),
al AS (SELECT bl.*, coalesce(cycle_n, 0) AS c, coalesce(first_pass_n, 0) AS f, coalesce(scope_known_n, 0) AS k, coalesce(full_scope_n, 0) AS g, coalesce(checks_n, 0) - coalesce(member_n, 0) AS w, CAST(coalesce(edits_n, 0) - coalesce(used, 0) AS BIGINT) AS a FROM bl LEFT JOIN cn USING ({_SESSION}) LEFT JOIN lo USING ({_SESSION}) LEFT JOIN me USING ({_SESSION}))
SELECT {_SESSION}, reasons, CASE WHEN reasons = '' THEN c END AS cycle_n, CASE WHEN reasons = '' THEN f END AS first_pass_n, CASE WHEN reasons = '' THEN k END AS scope_known_n, CASE WHEN reasons = '' THEN g END AS full_scope_n, CASE WHEN reasons = '' THEN w END AS without_edit_n, CASE WHEN reasons = '' THEN a END AS awaiting_edit_n,
CASE WHEN reasons = '' AND c > 0 THEN f / c END AS first_pass_rate, CASE WHEN reasons = '' AND k > 0 THEN g / k END AS full_scope_rate FROM al""")
def edit_cycle_sessions(spark, sf_dir):
    """Blocked sessions have reasons and no figures."""
    rows = actions(spark, sf_dir)
    why = rules.blockers(rows)
    return rules.cycle_sessions(rules.usable(rows, why), why).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""{_USABLE}, {_RETRY}, {_CHURN}, {_THRASH}, ev_ AS (
  SELECT source_id, 'retry-loop' AS rule, NOT mixed AND err IS NOT NULL AS e, mixed OR (status = 'failed' AND outcome = 'error' AND error_key IS NULL) AS m FROM fai UNION ALL SELECT source_id, 'retry-loop', false, true FROM att WHERE op_key IS NULL OR turn_id IS NULL
  UNION ALL SELECT source_id, 'context-churn', good, NOT good FROM lk0 WHERE look UNION ALL SELECT source_id, 'validation-thrashing', validation_scope <> 'unknown', validation_scope = 'unknown' FROM s3 WHERE member),
ec AS (SELECT source_id, rule, count(*) FILTER (e) AS eligible_n, count(*) FILTER (m) AS missing_n FROM ev_ GROUP BY ALL),
fc AS (SELECT source_id, rule, count(*) AS candidate_n FROM (SELECT source_id, 'retry-loop' AS rule FROM rl UNION ALL SELECT source_id, 'context-churn' FROM cc UNION ALL SELECT source_id, 'validation-thrashing' FROM vt) GROUP BY ALL),
ru AS (SELECT * FROM (VALUES ('retry-loop'), ('context-churn'), ('validation-thrashing')) AS t(rule)),
bc AS (SELECT source_id, rule, count(*) AS blocked_n FROM (SELECT source_id, rule FROM bl, ru WHERE reasons <> '' UNION ALL SELECT source_id, 'retry-loop' FROM lck) GROUP BY ALL),
sc AS (SELECT source_id, max(suppressed) AS suppressed, bool_or(coverage <> 'recognized_shapes' OR unsupported_records > 0 OR partition_status = 'provenance_unresolved') AS partial_ FROM ac GROUP BY source_id),
jn AS (SELECT source_id, rule, suppressed, partial_, CASE WHEN suppressed IS NULL THEN coalesce(eligible_n, 0) ELSE 0 END AS eligible_n, CASE WHEN suppressed IS NULL THEN coalesce(missing_n, 0) ELSE 0 END AS missing_n, CASE WHEN suppressed IS NULL THEN coalesce(candidate_n, 0) ELSE 0 END AS candidate_n, CASE WHEN suppressed IS NULL THEN coalesce(blocked_n, 0) ELSE 0 END AS blocked_n
  FROM sc CROSS JOIN ru LEFT JOIN ec USING (source_id, rule) LEFT JOIN fc USING (source_id, rule) LEFT JOIN bc USING (source_id, rule))
SELECT source_id, rule, CASE WHEN suppressed IS NOT NULL THEN 'suppressed' WHEN missing_n > 0 OR blocked_n > 0 OR partial_ THEN CASE WHEN eligible_n > 0 THEN 'partial' ELSE 'not_evaluable' END WHEN candidate_n > 0 THEN 'candidates' ELSE 'no_candidate' END AS status, eligible_n, missing_n, candidate_n, blocked_n FROM jn""")
def rule_assessments(spark, sf_dir):
    """Of each source and rule: whether what it found is all, some or nothing that can be told."""
    rows = actions(spark, sf_dir)
    return rules.assessments(rows, rules.blockers(rows))


@query(f"""WITH {ACTIONS_SQL}, x0 AS (SELECT *, kind = 'search' AND category = 'search' AND coalesce(tool_name IN ('Grep', 'Glob'), false) AS sea, kind = 'file_read' AND category = 'read' AND coalesce(tool_name = 'Read', false) AS rea,
  (kind = 'file_edit' AND category = 'edit' AND coalesce(tool_name = 'Edit', false)) OR (kind = 'file_write' AND category = 'write' AND coalesce(tool_name = 'Write', false)) AS mut,
  coalesce(suppressed, CASE WHEN provider <> 'claude' THEN 'unsupported_metric_contract' WHEN unsupported_records > 0 THEN 'unsupported_records' END) AS silent FROM ac WHERE NOT (kind = 'model' AND category = 'model' AND tool_name IS NULL)),
x1 AS (SELECT *, CASE WHEN sea OR rea THEN 'lookup' WHEN mut THEN 'mutation' ELSE 'opaque' END AS role, (sea OR rea) AND status <> 'completed' AS open_, NOT (sea OR rea) AND (kind IN ('file_read', 'search') OR coalesce(tool_name IN ('Read', 'Grep', 'Glob'), false)) AS odd FROM x0),
x2 AS (SELECT *, CASE WHEN open_ THEN NULL WHEN NOT admitted OR position_reason IS NOT NULL THEN 'incomplete_' || role WHEN sea AND lookup_key IS NULL THEN 'missing_search_identity' END AS bad FROM x1),
xr AS (SELECT {_SESSION}, bad AS reason FROM x2 WHERE bad IS NOT NULL UNION SELECT {_SESSION}, 'inconsistent_lookup_class' FROM x2 WHERE odd UNION SELECT {_SESSION}, 'provenance_unresolved' FROM x2 WHERE partition_status = 'provenance_unresolved' UNION SELECT {_SESSION}, 'source_suppressed' FROM x2 WHERE silent IS NOT NULL),
xs AS (SELECT {_SESSION}, max(silent) AS silent, count(*) FILTER (role = 'lookup' AND NOT open_) AS completed_n, count(*) FILTER (role = 'lookup' AND NOT open_ AND bad IS NULL) AS positioned_n, count(*) FILTER (open_) AS excluded_n, count(*) FILTER (role = 'mutation') AS mutation_n, count(*) FILTER (role = 'opaque') AS opaque_n FROM x2 GROUP BY ALL),
xa AS (SELECT xs.*, coalesce(w.reasons, '') AS reasons FROM xs LEFT JOIN (SELECT {_SESSION}, string_agg(reason, ',' ORDER BY reason) AS reasons FROM xr GROUP BY ALL) w USING ({_SESSION})),
xc AS (SELECT x2.* FROM x2 JOIN xa USING ({_SESSION}) WHERE reasons = '' AND bad IS NULL AND NOT open_),
xi AS (SELECT DISTINCT {_SESSION}, end_ms AS at_ms FROM xc WHERE role = 'lookup'),
xk AS (SELECT {_SESSION}, at_ms, key_, count(*) AS n FROM xi JOIN (SELECT {_SESSION}, end_ms, CASE WHEN sea THEN lookup_key END AS key_ FROM xc WHERE role = 'lookup') l USING ({_SESSION}) WHERE end_ms BETWEEN at_ms - 600000 AND at_ms GROUP BY ALL),
xw AS (SELECT {_SESSION}, at_ms, CAST(sum(n) AS BIGINT) AS looks, coalesce(max(n) FILTER (key_ IS NOT NULL), 0) AS most FROM xk GROUP BY ALL),
xm AS (SELECT {_SESSION}, at_ms, count(*) FILTER (role = 'mutation') AS muts, count(*) FILTER (role = 'opaque') AS opqs FROM xi JOIN (SELECT {_SESSION}, role, start_ms, end_ms FROM xc WHERE role <> 'lookup') m USING ({_SESSION}) WHERE start_ms <= at_ms AND end_ms >= at_ms - 600000 GROUP BY ALL),
xq AS (SELECT *, looks >= 20 AND most >= 5 AND coalesce(muts, 0) <= 1 AS fit, looks >= 20 AND most >= 5 AND coalesce(muts, 0) <= 1 AND coalesce(opqs, 0) = 0 AS free FROM xw LEFT JOIN xm USING ({_SESSION}, at_ms)),
xt AS (SELECT *, min(CASE WHEN free THEN at_ms END) OVER (PARTITION BY {_SESSION}) AS chosen FROM xq),
xe AS (SELECT {_SESSION}, min(chosen) AS last_ms, count(*) AS endpoints, count(*) FILTER (fit) AS qualified, count(*) FILTER (fit AND NOT free) AS blocked, max(CASE WHEN at_ms = chosen THEN looks END) AS lookups, max(CASE WHEN at_ms = chosen THEN coalesce(muts, 0) END) AS mutations, max(CASE WHEN at_ms = chosen THEN most END) AS most_same FROM xt WHERE chosen IS NULL OR at_ms <= chosen GROUP BY ALL)
SELECT {_SESSION}, CASE WHEN reasons <> '' THEN CASE WHEN silent IS NOT NULL THEN 'suppressed' ELSE 'unavailable' END WHEN positioned_n = 0 THEN 'empty' WHEN positioned_n < 20 THEN 'insufficient' WHEN last_ms IS NOT NULL THEN 'candidate' WHEN blocked > 0 THEN 'blocked' ELSE 'no_candidate' END AS status, reasons, completed_n, positioned_n, excluded_n, mutation_n, opaque_n,
CASE WHEN reasons = '' THEN CASE WHEN positioned_n >= 20 THEN endpoints ELSE 0 END END AS endpoints, CASE WHEN reasons = '' THEN CASE WHEN positioned_n >= 20 THEN qualified ELSE 0 END END AS qualified, CASE WHEN reasons = '' THEN CASE WHEN positioned_n >= 20 THEN blocked ELSE 0 END END AS blocked,
CASE WHEN reasons = '' AND positioned_n >= 20 THEN last_ms END AS last_ms, CASE WHEN reasons = '' AND positioned_n >= 20 THEN lookups END AS lookups, CASE WHEN reasons = '' AND positioned_n >= 20 THEN mutations END AS mutations, CASE WHEN reasons = '' AND positioned_n >= 20 THEN most_same END AS most_same FROM xa LEFT JOIN xe USING ({_SESSION})""")
def exploration_windows(spark, sf_dir):
    return rules.exploration(actions(spark, sf_dir))
