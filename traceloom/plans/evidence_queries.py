"""Failures by class with their measured times, and what part of each population evidence covers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.expr import fraction
from traceloom.functions.saved import saved
from traceloom.operators import native
from traceloom.plans import native_queries
from traceloom.plans.native_queries import _POSITIONS
from traceloom.sources.agent_tables import observations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Admitted executions with the reason against their time, as in ``admitted_timing``.
_TIMED = native_queries.ORACLES["admitted_timing"].split("SELECT source_id, coalesce(why")[0]
_CLASS = ["source_id", "session_id", "kind", "category", "tool_name"]


@query(f"""{_TIMED}, f AS (SELECT * FROM tr WHERE status = 'failed'), c AS (SELECT {', '.join(_CLASS)}, count(*) AS failed_n, count(*) FILTER (id % 13 = 3) AS missing_operation_n, count(*) FILTER (why IS NULL) AS measured_n FROM f GROUP BY ALL),
m AS (SELECT {', '.join(_CLASS)}, duration_scope, timing_evidence, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_ms, max(duration_ms) AS max_ms FROM f WHERE why IS NULL GROUP BY ALL)
SELECT {', '.join(f'c.{k}' for k in _CLASS)}, failed_n, missing_operation_n, measured_n, duration_scope, timing_evidence, n, sum_ms, p50_ms, p95_ms, max_ms FROM c LEFT JOIN m USING ({', '.join(_CLASS)})""")
def failure_measures(spark, sf_dir):
    """Proven failures of a class, and below it their durations by scope and evidence, which are never mixed; a class without a measured one has one row."""
    failed = native_queries._admitted(spark, sf_dir).where("admitted AND status = 'failed'").withColumn("why", native.timing_reason())
    failed = saved(failed.select(*_CLASS, "id", "why", "duration_ms", "duration_scope", "timing_evidence"))
    cohorts = failed.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("failed_n"), F.count_if(F.col("id") % 13 == 3).alias("missing_operation_n"), F.count_if(F.col("why").isNull()).alias("measured_n"))
    quantile = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration_ms)").cast("long")
    measures = failed.where("why IS NULL").groupBy(*_CLASS, "duration_scope", "timing_evidence").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("sum_ms"), quantile(0.5).alias("p50_ms"), quantile(0.95).alias("p95_ms"), F.max("duration_ms").alias("max_ms"))
    return cohorts.join(measures, _CLASS, "left")


_VIEWS = {
    "failure-admission": ("terminal", "tentative"), "failure-timing": ("measured", "failed"), "boundary-coverage": ("positioned", "terminal"), "read-identity": ("reads_known", "reads"), "search-identity": ("searches_known", "searches"),
}
_LOOKS = "admitted AND status = 'completed' AND provider = 'claude' AND kind = "
_COUNTS = {
    "tentative": "exclusion IS NULL", "terminal": "admitted", "failed": "admitted AND status = 'failed'", "measured": "admitted AND status = 'failed' AND why IS NULL", "positioned": "admitted AND position_reason IS NULL",
    "reads": f"{_LOOKS}'file_read'", "reads_known": f"{_LOOKS}'file_read' AND id % 13 <> 3", "searches": f"{_LOOKS}'search'", "searches_known": f"{_LOOKS}'search' AND id % 13 <> 3",
}


@query(f"""{_TIMED}, {_POSITIONS}, j AS (SELECT ad.*, tr.why, po.position_reason FROM ad LEFT JOIN (SELECT id, why FROM tr) tr USING (id) JOIN po USING (id)),
g AS (SELECT source_id, session_id, partition_status AS state, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _COUNTS.items())} FROM j GROUP BY ALL)
{' UNION ALL '.join(f"SELECT '{v}' AS view, source_id, session_id, state, {p} AS part, {w} AS whole, CASE WHEN state = 'evaluated' AND {w} > 0 THEN {p} / {w} END AS share FROM g" for v, (p, w) in _VIEWS.items())}""")
def evidence_fractions(spark, sf_dir):
    """Five views in one shape: what part of a session's population is admitted, timed, placed or identified; null where the session isn't evaluated or has none."""
    rows = native.positions(native_queries._admitted(spark, sf_dir), observations(spark, sf_dir)).withColumn("why", native.timing_reason())
    found = rows.groupBy("source_id", "session_id", F.col("partition_status").alias("state")).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTS.items()])
    views = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(p).alias("part"), F.col(w).alias("whole")) for v, (p, w) in _VIEWS.items()])).alias("v")
    out = found.select("source_id", "session_id", "state", views).select("v.view", "source_id", "session_id", "state", "v.part", "v.whole")
    return out.withColumn("share", F.when(F.col("state") == "evaluated", fraction(F.col("part"), F.col("whole"))))
