"""Columnar tables, inline rows and the calendar dimension."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.functions import clean
from starwright.operators.projection import derive, struct_of
from starwright.operators.setops import union


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def scan(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Delta when the path holds a transaction log, else Parquet."""
    if path_exists(spark, f"{path.rstrip('/')}/_delta_log"):
        return spark.read.format("delta").load(path)
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


def read_many(
    paths: Sequence[str], reader: Callable[[str], DataFrame],
) -> DataFrame:
    """Union by name of several files or tables, e.g. one per year."""
    return union([reader(p) for p in paths])


def empty(spark: SparkSession, columns: Sequence[Sequence]) -> DataFrame:
    """Empty table of the declared types."""
    return spark.createDataFrame([], struct_of(columns, keep_nullability=False))


def seed(
    spark: SparkSession, rows: Sequence[Mapping[str, object]], columns: Sequence[Sequence],
) -> DataFrame:
    """Table of inline rows; columns declared ``derived`` are computed from the others."""
    if not rows:
        return empty(spark, columns)
    formulas = {c[0]: c[4]["derived"] for c in columns
                if len(c) > 4 and c[4] and "derived" in c[4]}
    schema = struct_of(columns)
    values = [tuple(None if f.name in formulas else row.get(f.name) for f in schema) for row in rows]
    out = derive(spark.createDataFrame(values, schema), formulas)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def calendar_columns(date: Column, fiscal_start: int = 1) -> dict[str, Column]:
    """The 28 columns of the calendar dimension, Sunday being day 1 of the week."""
    month, day, year = F.month(date), F.dayofmonth(date), F.year(date)
    quarter, weekday, month_end = F.quarter(date), F.dayofweek(date), F.last_day(date)
    weekend = weekday.isin(1, 7)
    fiscal_month = F.pmod(month - F.lit(fiscal_start), F.lit(12)) + 1
    return {
        "date_id": clean.date_key(date),
        "date": date,
        "year": year,
        "quarter": quarter,
        "month": month,
        "month_name": F.date_format(date, "MMMM"),
        "month_abbr": F.date_format(date, "MMM"),
        "week_of_year": F.weekofyear(date),
        "day_of_month": day,
        "day_of_week": weekday,
        "day_of_week_name": F.date_format(date, "EEEE"),
        "day_of_week_abbr": F.date_format(date, "EEE"),
        "day_of_year": F.dayofyear(date),
        "is_weekend": weekend,
        "is_weekday": ~weekend,
        "is_month_start": day == 1,
        "is_month_end": date == month_end,
        "is_quarter_start": (day == 1) & (month % 3 == 1),
        "is_quarter_end": (date == month_end) & (month % 3 == 0),
        "is_year_start": (day == 1) & (month == 1),
        "is_year_end": (day == 31) & (month == 12),
        "fiscal_year": F.when(month >= fiscal_start, year).otherwise(year - 1),
        "fiscal_quarter": (F.floor((fiscal_month - 1) / 3) + 1).cast("int"),
        "fiscal_month": fiscal_month,
        "days_in_month": F.dayofmonth(month_end),
        "year_month": F.date_format(date, "yyyy-MM"),
        "year_quarter": F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string")),
        "date_str": F.date_format(date, "yyyy-MM-dd"),
    }


def calendar_of(days: DataFrame, date: str = "date", fiscal_start: int = 1) -> DataFrame:
    """Calendar rows of the dates a table holds."""
    cols = calendar_columns(F.col(date), fiscal_start)
    return days.select(*[c.alias(n) for n, c in cols.items()])


def calendar(
    spark: SparkSession, start: str, end: str, fiscal_start: int = 1,
) -> DataFrame:
    """Calendar dimension over a date range, both ends included."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day")
    )).alias("date"))
    return calendar_of(days, "date", fiscal_start)
