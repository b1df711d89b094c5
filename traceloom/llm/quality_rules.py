"""Quality rules with risk-controlled cutoffs (operator 10). DataFrame functions only.

Each rule rejects a document whose value is above a cutoff. A cutoff is certified for
a stratum if an exact binomial test on the labelled good documents of that stratum
shows that it rejects less than ``alpha`` of the good ones. Cutoffs form one fixed
list from lenient to strict, tested in that order until one fails, so the list itself
needs no correction; over rules and strata the level is divided (Bonferroni). The sum
of all rules' ``alpha`` bounds the false rejections of a stratum. Among certified
cutoffs the one that parts labelled good and bad documents best is used.

A rule's share of ``alpha`` takes several hundred labels to certify. So all rules
together are tested as well, at the whole ``alpha``: step k of that list sets each rule
to its k-th cutoff. Half of ``delta`` goes to either way; a stratum uses the better of
the two, so its false rejections are below ``alpha`` in both cases. A stratum with too
few labels for both certifies nothing and so rejects nothing but by the base rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Rule -> its cutoffs from lenient to strict. They don't depend on data.
RULES: dict[str, list[float]] = {
    "symbols_per_char": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "upper_per_char": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "repeat_words": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "dup_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "chars_per_word": [100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0],
}
#: Cutoffs of the longest list, and the name of all rules together.
STEPS = max(map(len, RULES.values()))
TOGETHER = "all rules"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and, as struct column ``_q``, the counts of each whole text. Null text has no words."""
    # Each step's arrays are used more than once, so Spark keeps the steps apart and computes each array once.
    step = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")))
    step = step.withColumn("_s", F.when(F.size("_w") >= 3, F.sort_array(windows)))
    again = F.transform("_s", lambda x, i: F.when(x["h"].eqNullSafe(F.get("_s", i - 1)["h"]) | x["h"].eqNullSafe(F.get("_s", i + 1)["h"]), x["p"]))
    step = step.withColumn("_r", F.sort_array(F.array_compact(again)))
    covered = F.aggregate(F.transform("_r", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_r", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counts = F.struct(
        # A column that isn't deterministic keeps Spark from pushing a filter on the counts below them, where it would compute all arrays anew for each use.
        (F.size("_w") + F.monotonically_increasing_id() * 0).alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    return step.withColumn("_q", counts).drop("_t", "_w", "_l", "_s", "_r")


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def _values(q: str = "_q") -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(f"{q}.{a}") / F.when(F.col(f"{q}.{b}") > 0, F.col(f"{q}.{b}")), F.lit(0.0))

    return {
        "symbols_per_char": share("n_symbols", "word_chars"), "upper_per_char": share("n_upper", "word_chars"), "repeat_words": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"), "chars_per_word": share("word_chars", "n_words"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exact up to rounding; 1 from k >= n * p on, where no test passes."""
    if p >= 1:  # any count below n is certain to be no more than the limit
        return F.when(k >= n, F.lit(1.0)).otherwise(F.lit(0.0))
    odds = math.log(p) - math.log1p(-p)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_last = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i)) + k * F.lit(odds) + n * F.lit(math.log1p(-p))
    # Terms from k downwards, each relative to the one at k.
    down = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i + 1) / (n - k + i) * F.lit(math.exp(-odds))).alias("term"), (a["sum"] + a["term"] * (k - i + 1) / (n - k + i) * F.lit(math.exp(-odds))).alias("sum")),
    )["sum"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_last) * down)


def certified_cutoffs(labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """``labelled`` has _id, _stratum, good (boolean) and _q. Returns _stratum, rule, cutoff for certified pairs.

    A labelled id is one trial in a stratum, however many rows share it, as an exact test
    needs: of a good one the row that is rejected first counts, of a bad one the last.
    """
    def first_above(name: str, value: Column) -> Column:
        """The first cutoff of the list that the value is above; STEPS if there is none."""
        cuts = RULES[name]
        below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value <= c))
        return F.when(below < len(cuts), below).otherwise(F.lit(STEPS))

    places = {name: first_above(name, value) for name, value in _values().items()}
    places[TOGETHER] = F.least(*places.values())
    once = labelled.select("_stratum", "_id", "good", *[at.alias(f"_at_{name}") for name, at in places.items()])
    once = once.groupBy("_stratum", "_id", "good").agg(*[F.when(F.col("good"), F.min(f"_at_{name}")).otherwise(F.max(f"_at_{name}")).alias(f"_at_{name}") for name in places])
    rows = once.select("_stratum", "good", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_at_{name}").alias("from")) for name in places])).alias("r"))
    counts = rows.groupBy("_stratum", "r.rule", "r.from").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    whole = W.partitionBy("_stratum", "rule")
    counts = counts.groupBy("_stratum", "rule").agg(F.sort_array(F.collect_list(F.struct("from", "g", "b"))).alias("c"), F.sum("g").alias("n"), F.sum("b").alias("m"))  # at most one entry for each cutoff
    steps = F.create_map(*[x for name, n in ([(name, len(cuts)) for name, cuts in RULES.items()] + [(TOGETHER, STEPS)]) for x in (F.lit(name), F.lit(n))])
    tests = counts.select("_stratum", "rule", "n", "m", "c", F.explode(F.sequence(F.lit(0), steps[F.col("rule")] - 1)).alias("at"))

    def above(which: str) -> Column:
        return F.aggregate(F.filter("c", lambda x: x["from"] <= F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x[which])

    tests = tests.select("_stratum", "rule", "at", "n", "m", above("g").alias("k"), above("b").alias("caught"))
    strata = max(1, labelled.select("_stratum").distinct().count())
    together = F.col("rule") == TOGETHER
    p = F.when(together, binomial_tail(F.col("k"), F.col("n"), alpha)).otherwise(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)))
    tests = tests.where(p <= F.when(together, F.lit(delta / (2 * strata))).otherwise(F.lit(delta / (2 * strata * len(RULES)))))
    # k grows with strictness, so the tests that pass are the first ones of the list.
    gain = F.round(F.coalesce(F.col("caught") / F.when(F.col("m") > 0, F.col("m")), F.lit(0.0)) - F.lit(20.0) * F.col("k") / F.col("n"), 9)
    best = tests.withColumn("gain", gain).withColumn("best", F.row_number().over(whole.orderBy(F.desc("gain"), "at"))).where("best = 1 AND caught > 0")
    by_stratum = W.partitionBy("_stratum")
    single, joint = (F.sum(F.when(x, F.col("gain"))).over(by_stratum) for x in (~together, together))
    used = best.withColumn("joint", F.coalesce(F.round(joint - single, 9) > 0, joint.isNotNull())).where(together == F.col("joint"))
    cut_of = F.create_map(*[x for name, cuts in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, cuts)))])
    names = F.when(together, F.array(*map(F.lit, RULES))).otherwise(F.array("rule"))
    rules = used.select("_stratum", "at", F.explode(names).alias("rule")).withColumn("cuts", cut_of[F.col("rule")])
    return rules.select("_stratum", "rule", F.get("cuts", F.least("at", F.size("cuts") - 1)).alias("cutoff"))


def judge_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality",
    alpha: float = 0.05, delta: float = 0.05, most_strata: int = 10_000, scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts on whole rows, and on ids.

    Both frames have a row for each document with counts (``_q``), ``_stratum``,
    ``_base_failed``, ``_broken`` (names of the rules it breaks) and ``_kept``: the first
    with all columns of ``docs`` in the struct ``_doc``, the second with the id only, from
    counts that are saved. A null text has no words and fails the base rule; a null stratum
    is a stratum of its own; labels that are null, repeated or without document don't
    count (of repeated ones the smallest does), and of documents that share a labelled id
    one in each stratum does. Without labels only the base rule holds.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    keyed = keyed.select("_doc", F.col(f"_doc.{doc_id}").alias("_id"), F.col(f"_doc.{text}").alias("_text"), F.coalesce(F.col(f"_doc.{stratum}").cast("string"), F.lit("\x00")).alias("_stratum"))
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.min(label) == 1).alias("good"))
    counted = with_features(keyed.select("_id", "_text", "_stratum"), "_text").select("_id", "_stratum", "_q")
    counted = scratch.save(counted, "quality-counts")
    cutoffs = scratch.save(certified_cutoffs(counted.join(known, "_id"), alpha, delta), "quality-cutoffs")
    return (apply_cutoffs(with_features(keyed, "_text").drop("_text"), cutoffs, most_strata), apply_cutoffs(counted.withColumnRenamed("_id", doc_id), cutoffs, most_strata))


def apply_cutoffs(counted: DataFrame, cutoffs: DataFrame, most_strata: int = 10_000) -> DataFrame:
    """Adds _base_failed, _broken and _kept. The cutoffs are broadcast if their strata are few, as checked here."""
    by_stratum = cutoffs.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    few = by_stratum.limit(most_strata + 1).count() <= most_strata
    joined = counted.join(F.broadcast(by_stratum) if few else by_stratum, "_stratum", "left")
    broken = F.array_compact(F.array(*[F.when(value > F.col("_cut")[name], F.lit(name)) for name, value in _values().items()]))
    out = joined.withColumn("_base_failed", base_failed()).withColumn("_broken", broken).drop("_cut")
    return out.withColumn("_kept", ~F.col("_base_failed") & (F.size("_broken") == 0))


def _oracle(alpha: float = 0.05, delta: float = 0.05) -> str:
    """The same definition in SQL; the binomial tail is summed with lgamma."""
    rules = ", ".join(f"('{name}', {at}, {cut})" for name, cuts in RULES.items() for at, cut in enumerate(cuts))
    p, share = alpha / len(RULES), {"symbols_per_char": ("n_symbols", "word_chars"), "upper_per_char": ("n_upper", "word_chars"), "repeat_words": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "chars_per_word": ("word_chars", "n_words")}
    values = " UNION ALL ".join(f"SELECT r, doc_id, s, '{name}' AS rule, CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS v FROM q" for name, (a, b) in share.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS s, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT r, g FROM k GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT k.r, unnest(range(i, i + 3)) AS j FROM k JOIN again a ON a.r = k.r AND a.g = k.g) GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT x) AS m FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
q AS (SELECT d.r, doc_id, s, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(l.n - l.m, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper FROM d LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
v AS ({values}),
b AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
lab AS (SELECT v.*, good FROM v JOIN b USING (doc_id)),
c AS (SELECT * FROM (VALUES {rules}) AS c(rule, pos, cutoff)),
broken AS (SELECT v.r, v.rule, min(pos) AS pos FROM v JOIN c ON c.rule = v.rule AND v > cutoff GROUP BY ALL),
each AS (SELECT lab.s, lab.doc_id, lab.good, lab.rule, broken.pos FROM lab LEFT JOIN broken ON broken.r = lab.r AND broken.rule = lab.rule
  UNION ALL SELECT lab.s, lab.doc_id, lab.good, '{TOGETHER}', min(broken.pos) FROM lab LEFT JOIN broken ON broken.r = lab.r AND broken.rule = lab.rule GROUP BY lab.r, lab.s, lab.doc_id, lab.good),
seen AS (SELECT s, good, rule, CASE WHEN good THEN min(pos) ELSE nullif(max(coalesce(pos, {STEPS})), {STEPS}) END AS pos FROM each GROUP BY s, doc_id, good, rule),
steps AS (SELECT rule, pos FROM c UNION ALL SELECT '{TOGETHER}', unnest(range({STEPS}))),
t AS (SELECT s, seen.rule, steps.pos, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS m, count(*) FILTER (good AND seen.pos <= steps.pos) AS k, count(*) FILTER (NOT good AND seen.pos <= steps.pos) AS caught FROM seen JOIN steps ON steps.rule = seen.rule GROUP BY ALL),
lim AS (SELECT *, CASE WHEN rule = '{TOGETHER}' THEN {min(alpha, 1.0)} ELSE {p} END AS p, (SELECT count(DISTINCT s) FROM lab) * CASE WHEN rule = '{TOGETHER}' THEN 2 ELSE {2 * len(RULES)} END AS ways FROM t),
x AS (SELECT *, CASE WHEN k >= n * p THEN 1.0 WHEN p >= 1 THEN 0.0 ELSE list_sum([exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(p) + (n - i) * ln(1 - p)) FOR i IN range(0, k + 1)]) END AS tail FROM lim),
ok AS (SELECT *, round(coalesce(caught / nullif(m, 0), 0) - 20.0 * k / n, 9) AS gain FROM x WHERE tail <= {delta} / ways),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY s, rule ORDER BY gain DESC, pos) = 1 AND caught > 0),
gains AS (SELECT s, sum(gain) FILTER (rule = '{TOGETHER}') AS joint, sum(gain) FILTER (rule <> '{TOGETHER}') AS single FROM best GROUP BY s),
used AS (SELECT best.*, coalesce(round(joint - single, 9) > 0, joint IS NOT NULL) AS all_rules FROM best JOIN gains USING (s)),
cut AS (SELECT used.s, c.rule, c.cutoff FROM used JOIN c ON used.rule = c.rule AND used.pos = c.pos WHERE NOT all_rules
  UNION ALL SELECT used.s, c.rule, min(c.cutoff) FROM used JOIN c ON c.pos <= used.pos WHERE used.rule = '{TOGETHER}' AND all_rules GROUP BY used.s, c.rule),
bad AS (SELECT DISTINCT r FROM v JOIN cut ON cut.s = v.s AND cut.rule = v.rule AND v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f AS base_failed, NOT f AND bad.r IS NULL AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f FROM q) LEFT JOIN bad USING (r)
"""


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    _, verdicts = judge_quality(docs.select("doc_id", "text", "lang"), labels)
    return verdicts.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in BASE], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


_ORACLE = _oracle()
QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _ORACLE}
