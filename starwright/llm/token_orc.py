"""Token ids in ORC: stripes of run-length integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.llm.bpe import BatchEncoder, vocabulary_path
from starwright.llm.common import stage
from starwright.llm.registry import query, table
from starwright.session import scratch_path

END_ID = 2
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
PART_BYTES = 1 << 20  # of texts encoded together, at some forty times the memory; a longer text is one part


@lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    return BatchEncoder(path)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut to about PART_BYTES of its second column, so that long texts do not pile up."""
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // PART_BYTES)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def encode_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
) -> DataFrame:
    """``doc_id, n_tokens, tokens`` of every row, the end id appended; NULL text counts as empty."""
    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in source:
            for part in parts(batch):
                counts, ids = bpe.encode_all([v or "" for v in part.column(1).to_pylist()], end)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(counts), tokens],
                    ["doc_id", "n_tokens", "tokens"])

    return df.select(id_col, text_col).mapInArrow(
        batches, "doc_id long, n_tokens long, tokens array<int>")


def write_token_orc(
    df: DataFrame, target: str, path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, partitions: int | None = None,
) -> None:
    """Write the ids of all texts to ORC files at ``target``, in ascending document id order.

    Each task takes a range of document ids, sorts it and writes one file of several stripes.
    ORC stores the ids by integer run-length encoding, keeps minimum and maximum per stripe and
    per ``INDEX_ROWS`` rows, and a Bloom filter of document ids for the same rows, so that a
    reader can take stripes in parallel and skip what it does not need. The texts are
    shuffled, not the ids, which are larger; a write that fails leaves no finished files. NULL
    ids come first; repeated rows are stored as often as they come; other columns are ignored;
    an empty table gives a readable folder without rows.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = (source.repartitionByRange(partitions, "doc_id") if partitions
              else source.repartitionByRange("doc_id"))
    coded = encode_documents(ranged.sortWithinPartitions("doc_id"), path, "doc_id", "text", end_id)
    (coded.write.mode("errorifexists")
     .option("orc.compress", "ZSTD")
     .option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.row.index.stride", INDEX_ROWS)
     .option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", 0.01)
     .orc(target))


def read_token_orc(spark: SparkSession, target: str, ids: list[int] | None = None) -> DataFrame:
    """Stored documents; with ``ids`` the filter goes down to file, stripe and row group metadata."""
    stored = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").orc(target)
    return stored.where(F.col("doc_id").isin(list(ids))) if ids is not None else stored


def token_digests(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the files.

    ``start`` is summed inside each file and carried over from the files before, of which there
    is one row each.
    """
    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(), "<i4")
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.array(crcs, pa.int64()), batch.column(2)],
                ["doc_id", "n_tokens", "ids_crc32", "file"])

    # staged, since the files are read for the totals and again for the rows
    rows = stage(read_token_orc(spark, target).select(
        "doc_id", "tokens", F.col("_metadata.file_path").alias("file")).mapInArrow(
        batches, "doc_id long, n_tokens long, ids_crc32 long, file string"), "token-digests")
    files = rows.groupBy("file").agg(
        F.sum("n_tokens").alias("sum"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # one row per file
    before = Window.orderBy(F.col("low").asc_nulls_first(), "high", "file").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file").orderBy(
        F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, "file")
        .select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


@query("op10_token_orc")
def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), target, vocabulary_path())
    return token_digests(spark, target)
