"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm.common import small, stage
from starwright.llm.registry import query, table

PREFIX_CHARS = 64
GROUP_ROWS = 100_000  # groups, some 150 bytes each, that may be broadcast


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict | None = None,
) -> DataFrame:
    """Which rows have equal texts, and which one of each group stays.

    Rows are refined in three steps, and each step sees only what the one before could not tell
    apart: byte length; (length, hash of the first 64 characters); SHA-256 of the whole
    text. Only rows that share length and prefix with another row have their full text hashed.

    Returns one row per row: ``id, keep_id, group_size, kept`` and the columns of ``carry``
    (``{name: expression over df}``). The row with the largest id stays; NULL text counts as
    empty; NULL ids are the smallest. A row given twice, id and text alike, counts twice in
    ``group_size`` and is kept twice or not at all. Other columns of ``df`` are ignored, so
    their names cannot clash. An empty table gives no rows.

    Copies are counted before they are shuffled, so a group holding a third of all rows costs
    one row per task. The groups are staged, so that the join back to the rows is between two tables read
    for it, which Spark splits by skew, or a broadcast when their count is small. The surviving
    (length, prefix) keys are joined likewise.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(
        F.col(id_col).alias("__id"), body.alias("__text"), F.octet_length(body).alias("__len"),
        F.xxhash64(F.substring(body, 1, PREFIX_CHARS)).alias("__prefix"),
        *[e.alias(n) for n, e in (carry or {}).items()])
    first = keyed.groupBy("__len", "__prefix").agg(F.count("*").alias("__n"))
    # the length step works on the counts per (length, prefix), one row each
    first = stage(first, "dedup-prefixes")
    lengths = first.groupBy("__len").agg(F.sum("__n").alias("__m")).where("__m > 1").select("__len")
    again = stage(
        first.join(lengths, "__len", "left_semi").where("__n > 1").select("__len", "__prefix"),
        "dedup-survivors")
    flagged = keyed.join(
        small(again.withColumn("__again", F.lit(True))), ["__len", "__prefix"], "left")
    hashed = stage(
        flagged.select(
            "__id", "__len", F.when(F.col("__again"), F.sha2("__text", 256)).alias("__hash"),
            *(carry or {})),
        "dedup-hashes")
    groups = hashed.where(F.col("__hash").isNotNull()).groupBy("__len", "__hash").agg(
        F.max("__id").alias("__keep"), F.count("*").alias("__size")).where("__size > 1")
    groups = small(stage(groups, "dedup-groups"), GROUP_ROWS)
    return hashed.join(groups, ["__len", "__hash"], "left").select(
        F.col("__id").alias(id_col),
        F.coalesce("__keep", "__id").alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("__keep", "__id").eqNullSafe(F.col("__id")).alias("kept"),
        *(carry or {}))


@query("op7_exact_dedup", sql="""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY body)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})
