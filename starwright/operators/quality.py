"""Data-quality reports computed in single passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Checks:
    """What a table must satisfy. Ranges may be open on either side (None)."""

    required: Sequence[str] = ()
    optional: Sequence[str] = ()
    numeric: Sequence[str] = ()
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    null_shares: Mapping[str, float] = field(default_factory=dict)
    min_rows: int = 1
    date: str | None = None
    entity: str | None = None
    min_dates: int = 5


def missing_columns(df: DataFrame, checks: Checks) -> tuple[list[str], list[str]]:
    """Missing required and missing optional columns."""
    have = set(df.columns)
    return sorted(set(checks.required) - have), sorted(set(checks.optional) - have)


def non_numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns
            if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType)]


def summary(df: DataFrame, checks: Checks) -> DataFrame:
    """All figures the checks need, as one row from one pass over the data."""
    have = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for c in checks.required:
        if c in have:
            aggs.append(F.count(c).alias(f"{c}__set"))
    numeric = [n for n in checks.numeric if n in have and not non_numeric(df, [n])]
    for c in [n for n in dict.fromkeys([*numeric, *checks.ranges]) if n in have]:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    for c in numeric:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    if checks.date in have:
        aggs += [F.min(checks.date).alias("min_date"), F.max(checks.date).alias("max_date"),
                 F.count_distinct(checks.date).alias("unique_dates")]
    if checks.entity in have:
        aggs.append(F.count_distinct(checks.entity).alias("entity_count"))
    return df.agg(*aggs)


def report(df: DataFrame, checks: Checks) -> DataFrame:
    """Issues and metrics as rows ``(kind, level, category, item, message, value)``.

    The data checks are Columns over the one-row summary, so nothing is collected; they are
    left out when required columns are missing.
    """
    required, optional = missing_columns(df, checks)
    one = summary(df, checks)
    rows: list[Column] = []

    def issue(when: Column, level: Column | str, category: str, item: str, message: Column,
              value: Column) -> None:
        level_col = F.lit(level) if isinstance(level, str) else level
        rows.append(F.when(when, F.struct(
            F.lit("issue").alias("kind"), level_col.alias("level"),
            F.lit(category).alias("category"), F.lit(item).alias("item"),
            message.alias("message"), value.cast("double").alias("value"))))

    none = F.lit(None)
    for c in required:
        issue(F.lit(True), "error", "column", c, F.lit(f"missing required column {c}"), none)
    for c in optional:
        issue(F.lit(True), "warning", "column", c, F.lit(f"missing optional column {c}"), none)
    n = F.col("row_count")
    issue(n < checks.min_rows, "error", "coverage", "rows",
          F.concat(F.lit("only "), n.cast("string"), F.lit(f" rows, {checks.min_rows} required")), n)
    if not required:
        for c in non_numeric(df, checks.numeric):
            issue(F.lit(True), "error", "type", c,
                  F.lit(f"{c} should be numeric but is {df.schema[c].dataType.simpleString()}"), none)
        for c, (low, high) in checks.ranges.items():
            if c not in df.columns:
                continue
            if low is not None:
                issue(F.col(f"{c}__min") < low, "warning", "range", c,
                      F.lit(f"{c} has values below {low:g}"), F.col(f"{c}__min"))
            if high is not None:
                issue(F.col(f"{c}__max") > high, "warning", "range", c,
                      F.lit(f"{c} has values above {high:g}"), F.col(f"{c}__max"))
        for c in checks.required:
            limit = checks.null_shares.get(c, 0.0)
            share = 1 - F.try_divide(F.col(f"{c}__set").cast("double"), F.nullif(n, F.lit(0)))
            issue(share > limit, "error" if limit == 0 else "warning", "quality", c,
                  F.lit(f"{c} has more than {limit:.1%} nulls"), share)
        if checks.date in df.columns:
            issue(F.col("unique_dates") < checks.min_dates, "warning", "coverage", checks.date,
                  F.lit(f"fewer than {checks.min_dates} distinct dates"), F.col("unique_dates"))

    def metric(name: str, value: Column, text: Column | None = None) -> None:
        rows.append(F.struct(
            F.lit("metric").alias("kind"), F.lit("info").alias("level"),
            F.lit("metric").alias("category"), F.lit(name).alias("item"),
            (text if text is not None else F.lit(None).cast("string")).alias("message"),
            value.cast("double").alias("value")))

    metric("row_count", n)
    metric("column_count", F.lit(len(df.columns)))
    for c in one.columns:
        if c.endswith(("__mean", "__std", "__min", "__max")):
            metric(c.replace("__", "_"), F.col(c).try_cast("double")
                   if dict(one.dtypes)[c] == "string" else F.col(c))
        elif c in ("unique_dates", "entity_count"):
            metric(c, F.col(c))
    if "min_date" in one.columns:
        metric("date_range", F.lit(None), F.concat_ws(
            " to ", F.col("min_date").cast("string"), F.col("max_date").cast("string")))
    exploded = one.select(F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return exploded.select("r.*")


def is_valid(report_df: DataFrame) -> DataFrame:
    """One row: error and warning counts, and whether there is no error."""
    return report_df.agg(
        F.sum(F.when(F.col("level") == "error", 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("level") == "warning", 1).otherwise(0)).alias("warnings"),
    ).withColumn("valid", F.col("errors") == 0)


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, NULL rows and their share."""
    names = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("column"), F.col("__n").alias("rows"),
                      (F.col("__n") - F.col(c)).alias("null_rows")) for c in names]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*").withColumn(
        "null_share", F.try_divide(F.col("null_rows").cast("double"),
                                   F.nullif(F.col("rows"), F.lit(0))))


def time_coverage(df: DataFrame, date: str, entity: str | None = None) -> DataFrame:
    """Range, distinct dates and entities."""
    aggs = [F.min(date).alias("min_date"), F.max(date).alias("max_date"),
            F.count_distinct(date).alias("unique_dates")]
    if entity:
        aggs.append(F.count_distinct(entity).alias("entity_count"))
    return df.agg(*aggs)


def duplicate_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys with more than one row, most rows first; the limit is that of the report."""
    out = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
           .filter(F.col("copies") > 1).orderBy(F.desc("copies"), *keys))
    return out if limit is None else out.limit(limit)


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    from starwright.operators.setops import union

    return union([
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in tables.items()
    ])


def population(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: all rows, and rows with each column set."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"with_{c}") for c in columns])
