"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, written as Parquet and read again. All but
the last return the columns of ``documents``. Rows with null ids, null or empty texts,
repeated rows and additional columns pass through every stage; what becomes of them is
said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import decontamination, jaccard_join, packing, quality_rules, secret_scan
from traceloom.llm.scratch import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or a certified cutoff; texts without words fail."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, _ = quality_rules.judge_quality(docs, labels)
    return judged.where("_kept").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row with the smallest id; of rows that share id and text the first by its other columns; texts without words all.

    Near copies share 80 % or more of their 5-word shingles; operator 6's own query has other values.
    Rows that share id and text stay all or but one, so no window has to put them in order:
    where all stay they are let through by a join, and the one is found by an aggregation
    that begins before the shuffle.
    """
    found = jaccard_join.jaccard_components(docs, n=5, percent=80)
    kept = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha").alias("_sha")).agg(F.count_if("keeper").alias("_kept"), F.count(F.lit(1)).alias("_all")).where("_kept > 0")
    kept = Scratch(spark).save(kept, "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = rows.withColumn("_i", F.col("_doc.doc_id").cast("long")).withColumn("_s", F.substring(F.sha2(F.coalesce("_doc.text", F.lit("")), 256), 1, 16))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha"))
    every = rows.join(kept.where("_kept = _all"), same, "left_semi")
    first = rows.join(kept.where("_kept < _all"), same, "left_semi").groupBy("_i", "_s").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
    return every.select("_doc.*").unionByName(first.select("_doc.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, edited or not; those without words stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.find_leaks(docs, benchmark, keys=True).select(F.col("doc_id").alias("_id"), "doc_key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    same = F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("doc_key"))
    return rows.join(leaks, same, "left_anti").select("_doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts and brings n_chars up to date; keeps every document, null texts as they are."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence for each piece of each document; an empty text is a piece of one token."""
    import public_tokenizers

    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(Scratch(spark).save(pieces, "pieces"))


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Set similarity, alignment, checksums and bin packing have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
