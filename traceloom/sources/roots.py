"""Which root a log belongs to, if several roots are read: its longest, unless roots of two providers hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of logs that are compressed, which no provider writes.
COMPRESSED = r"(?i)\.jsonl\.(gz|zst|zip|bz2|xz)$"


def _clean(path):
    """Without a slash at the end, so that a root and a folder on a path compare equal."""
    return F.regexp_replace(path, "(?<=.)/+$", "")


def owned(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root, provider and ``outcome`` to paths (path, is_link); one row for each path.

    roots: root, provider. A path belongs to the roots among its ancestors and itself. They
    are found by an equal join: a path gives one key for each of its ancestors, so the work is
    paths times depth whatever the number of roots. outcome: ``symlink_skipped``,
    ``unsupported_compression``, ``not_a_log``, ``ambiguous_provider``, ``outside`` or ``source``.
    A path that is listed more than once counts once; one that any listing calls a link is one.
    """
    files = paths.groupBy(F.col("path")).agg(F.bool_or("is_link").alias("is_link"))
    names = F.split(F.col("path"), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.coalesce(F.nullif(F.array_join(F.slice(names, F.lit(1), n), "/"), F.lit("")), F.lit("/")))
    outcome = F.when(F.col("is_link"), "symlink_skipped").when(F.col("path").rlike(COMPRESSED), "unsupported_compression").when(~F.col("path").endswith(".jsonl"), "not_a_log")
    told = files.withColumn("outcome", outcome)
    known = roots.select(_clean(F.col("root")).alias("root"), "provider").distinct()
    met = told.where("outcome IS NULL").select("path", F.explode(ancestors).alias("root")).join(known, "root")
    owner = met.groupBy("path").agg(F.max(F.struct(F.length("root"), "root", "provider")).alias("w"), (F.min("provider") != F.max("provider")).alias("several"))
    out = told.join(owner, "path", "left")
    final = F.coalesce("outcome", F.when(F.col("w").isNull(), "outside").when(F.col("several"), "ambiguous_provider").otherwise("source"))
    good = final == "source"
    return out.select("path", F.when(good, F.col("w.root")).alias("root"), F.when(good, F.col("w.provider")).alias("provider"), final.alias("outcome"))
