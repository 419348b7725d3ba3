"""Structured Streaming loads into the tables of :mod:`starwright.sinks.tables`.

Every batch write is idempotent, so a batch repeated after a failure changes nothing: keys
decide for append and upsert, the batch id for the plain load.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from starwright.sinks import tables

BATCH = "load_batch"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
    files_per_trigger: int | None = None, **options: str,
) -> DataFrame:
    """Stream of the files arriving under a path."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def _writer(stream: DataFrame, checkpoint: str, each) -> DataStreamWriter:
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(each))


def append_stream(
    stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str,
    partitions: Sequence[str] | None = None, date_column: str | None = None,
    order: Sequence[str] = (),
) -> DataStreamWriter:
    """Append-immutable load: each key is stored once, whatever is repeated."""
    return _writer(stream, checkpoint, lambda df, _: tables.append_immutable(
        df, path, keys, partitions, date_column, order))


def upsert_stream(
    stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str,
    partitions: Sequence[str] | None = None, order: Sequence[str] = (),
) -> DataStreamWriter:
    """Upsert load: the last row of a key by ``order`` wins, in whatever batch it comes."""
    return _writer(stream, checkpoint, lambda df, _: tables.upsert(
        df, path, keys, partitions, True, order))


def refill_stream(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Plain load: the first batch replaces the table, later ones add to it.

    Each batch owns one ``load_batch`` partition, so a repeated batch overwrites itself.
    """
    def load(df: DataFrame, batch_id: int) -> None:
        mode = "static" if batch_id == 0 else "dynamic"
        (df.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", mode).partitionBy(BATCH).parquet(path))

    return _writer(stream, checkpoint, load)


def loaded_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows per batch of a table filled by :func:`refill_stream`."""
    return spark.read.parquet(path).groupBy(BATCH).agg(F.count(F.lit(1)).alias("rows"))


def dedup_stream(stream: DataFrame, keys: Sequence[str], event_time: str,
                 delay: str = "1 day") -> DataFrame:
    """One row per key among events at most ``delay`` apart; older state is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
