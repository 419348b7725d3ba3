"""A training corpus from raw documents: each stage is one operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm.bpe import encode_decode, vocabulary_path
from starwright.llm.common import small, stage
from starwright.llm.exact_dedup import exact_dedup
from starwright.llm.mil_quality import score_quality
from starwright.llm.pivotal_mix import pivotal_mix
from starwright.llm.setsketch import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, taught by the ``labels`` table, predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = score_quality(docs, labels, carry=["text", "lang", "source", "n_chars"])
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, once if it was given twice."""
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    kept = exact_dedup(docs, carry={**{c: docs[c] for c in ["text", "lang", "source", "n_chars"]}, "digest": digest})
    return kept.where("kept").dropDuplicates(["keep_id", "digest"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts (five words, similarity 0.8 or more) the smallest id stays."""
    gone = stage(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "near-gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows of one id take the most that one of them does."""
    taken = pivotal_mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("id")).agg(
        F.max("copies").alias("copies"))
    joined = docs.join(small(stage(taken, "mix-taken")), F.col("doc_id").eqNullSafe(F.col("id")))
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text the mix holds, one row per copy."""
    return encode_decode(docs, vocabulary_path(), keep_ids=False)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # a learned classifier has no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
