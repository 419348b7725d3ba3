"""Views over star tables: derived columns on assumptions, rollups, wide subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.operators import joins, projection, setops


def derived_view(
    base: DataFrame, derived: Mapping[str, str], lookup: DataFrame | None = None,
    keys: Sequence[str] = (), assumptions: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Base table, assumed values (looked up, else their default), derived columns.

    Assumptions are ``{name: default}``; without a lookup the default holds for all rows.
    """
    defaults = dict(assumptions or {})
    out = base
    if lookup is not None:
        fields = [n for n in defaults if n in lookup.columns] or [
            c for c in lookup.columns if c not in keys]
        out = joins.enrich(base, lookup, keys, fields)
    for name, default in defaults.items():
        if name in out.columns:
            if default is not None:
                out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
        else:
            out = out.withColumn(name, F.lit(default))
    out = projection.derive(out, derived)
    return out.select(*columns) if columns else out


def rollup_view(base: DataFrame, grain: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """One row per grain with SQL aggregate columns."""
    return base.groupBy(*grain).agg(*[F.expr(e).alias(n) for n, e in columns.items()])


def wide_subsets(
    parts: Mapping[str, DataFrame], discriminator: str,
) -> DataFrame:
    """One wide table of several kinds; columns of other kinds are NULL."""
    return setops.federated_union(parts, discriminator)


def subset(
    wide: DataFrame, discriminator: str, value: object, common: Sequence[str],
    own: Sequence[str],
) -> DataFrame:
    """Rows of one kind with the common columns and its own."""
    return wide.filter(F.col(discriminator) == F.lit(value)).select(*common, *own)


def subset_violations(
    wide: DataFrame, discriminator: str, own: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Per kind: rows where a column of another kind is set."""
    foreign = F.lit(False)
    for kind, columns in own.items():
        for c in columns:
            foreign = foreign | (F.col(c).isNotNull() & (F.col(discriminator) != F.lit(kind)))
    return wide.groupBy(discriminator).agg(
        F.sum(F.when(foreign, 1).otherwise(0)).cast("long").alias("violations"))
