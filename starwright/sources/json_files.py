"""Raw API responses kept as JSON files, one response per file.

A response is at most a few MB, so reading a file in one task is fine; the files of an
endpoint are read in parallel. The entity comes from ``_meta`` or from the file name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.operators.setops import union

# Entity in the file name, and the wrapper fields around a response.
ENTITY_IN_FILE = r"/([A-Z0-9\-\.]+)\.json$"
META_FIELDS = ("ticker", "endpoint_id", "fetched_at", "provider")

META = T.StructType([T.StructField(n, T.StringType()) for n in META_FIELDS])


def wrapped(response: T.DataType) -> T.StructType:
    """File schema of a response with its ``_meta`` wrapper."""
    return T.StructType([T.StructField("_meta", META), T.StructField("response", response)])


def raw_files(spark: SparkSession, path: str, schema: T.StructType | None,
              entity_pattern: str, lines: bool = False) -> DataFrame:
    """One row per response with ``entity`` and the parsed file; schema inferred if None."""
    reader = spark.read.option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    in_name = F.nullif(
        F.regexp_extract(F.input_file_name(), entity_pattern, 1), F.lit(""))
    has_meta = "_meta" in df.columns and "ticker" in df.schema["_meta"].dataType.names
    entity = F.coalesce(F.col("_meta.ticker"), in_name) if has_meta else in_name
    return df.withColumn("__entity", entity)


def payload(df: DataFrame) -> Column:
    """The response, be it wrapped or the file itself."""
    if "response" in df.columns:
        return F.col("response")
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("_meta", "__entity")])


def flattened(df: DataFrame, lead: Sequence[str], record: str, skip: Sequence[str] = ()) -> DataFrame:
    """``lead`` columns followed by the fields of a struct column."""
    names = [n for n in df.schema[record].dataType.names
             if n.lower() not in {s.lower() for s in skip}]
    return df.select(*lead, *[F.col(f"`{record}`.`{n}`").alias(n) for n in names])


def read_nested_map(
    spark: SparkSession, path: str, response_key: str | None,
    value_schema: T.StructType | None = None, entity: str = "ticker", key: str = "trade_date",
    entity_pattern: str = ENTITY_IN_FILE, lines: bool = False,
) -> DataFrame:
    """``{key: {date: {…}}}`` responses to one row per entity and date.

    Without a schema the values are read as text, with the fields of all records in the order of
    their names; finding them takes a pass of its own, which a schema saves. The dates are
    never inferred as struct fields: a response with 5,000 days would become a schema of 5,000
    columns.
    """
    text_map = T.MapType(T.StringType(), T.StringType())
    dates = T.MapType(T.StringType(), text_map if value_schema is None else value_schema)
    body = T.StructType([T.StructField(response_key, dates)]) if response_key else dates
    df = raw_files(spark, path, wrapped(body), entity_pattern, lines)
    at = f"response.`{response_key}`" if response_key else "response"
    rows = df.select(F.col("__entity").alias(entity), F.explode(at).alias(key, "__value"))
    if value_schema is not None:
        return flattened(rows, [entity, key], "__value")
    # one row of field names, as few as the result has columns
    fields = rows.select(F.explode(F.map_keys("__value")).alias("f"))
    names = fields.agg(F.sort_array(F.collect_set("f"))).first()[0]
    return rows.select(entity, key, *[
        F.try_element_at("__value", F.lit(n)).alias(n) for n in names])


def read_objects(
    spark: SparkSession, path: str, schema: T.StructType | None = None, entity: str = "ticker",
    entity_pattern: str = ENTITY_IN_FILE, lines: bool = False,
) -> DataFrame:
    """One record per file; the entity is added unless the record names its symbol."""
    df = raw_files(spark, path, wrapped(schema) if schema else None, entity_pattern, lines)
    one = df.select(F.col("__entity").alias(entity), payload(df).alias("__body"))
    names = one.schema["__body"].dataType.names
    lead = [] if {"Symbol", entity} & set(names) else [entity]
    return flattened(one, lead, "__body")


def read_arrays(
    spark: SparkSession, path: str, schema: T.StructType | None = None, entity: str = "ticker",
    entity_pattern: str = ENTITY_IN_FILE, lines: bool = False,
) -> DataFrame:
    """Array responses (``response`` or ``response.data``) to one row per element."""
    df = raw_files(spark, path, wrapped(T.ArrayType(schema)) if schema else None,
                   entity_pattern, lines)
    items = payload(df)
    kind = df.select(items.alias("x")).schema["x"].dataType
    if isinstance(kind, T.StructType):
        if "data" not in kind.names:
            raise ValueError(f"no array in the response: {kind.names}")
        items = F.col("response.data")
    rows = df.filter(F.size(items) > 0).select(
        F.col("__entity").alias(entity), F.explode(items).alias("__item"))
    return flattened(rows, [entity], "__item", skip=[entity])


def read_reports(
    spark: SparkSession, path: str, schema: T.StructType | None = None,
    annual: str = "annualReports", quarterly: str = "quarterlyReports", entity: str = "ticker",
    entity_pattern: str = ENTITY_IN_FILE, lines: bool = False,
) -> DataFrame:
    """Annual and quarterly report arrays, tagged with ``report_type`` and united."""
    body_schema = None
    if schema is not None:
        reports = T.ArrayType(schema)
        body_schema = wrapped(T.StructType([
            T.StructField("symbol", T.StringType()),
            T.StructField(annual, reports), T.StructField(quarterly, reports)]))
    df = raw_files(spark, path, body_schema, entity_pattern, lines)
    body = df.select(F.col("__entity").alias(entity), payload(df).alias("__body"))
    have = body.schema["__body"].dataType.names
    parts = []
    for name, kind in ((annual, "annual"), (quarterly, "quarterly")):
        if name in have:
            rows = body.select(entity, F.explode(f"__body.{name}").alias("__report"))
            tagged = rows.withColumn("report_type", F.lit(kind))
            parts.append(flattened(tagged, [entity, "report_type"], "__report", skip=[entity]))
    if not parts:
        raise ValueError(f"neither {annual} nor {quarterly} found")
    return union(parts)
