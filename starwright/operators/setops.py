"""Union, dedup, distinct dimensions, value lists, sort and limits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.operators import projection


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_one(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), latest: bool = False,
) -> DataFrame:
    """One row per key: the first (or last) by ``order``, ties by the whole row.

    Done as min/max of a struct, not as row_number: copies are dropped before the shuffle,
    so a key holding a third of all rows is one row per task.
    """
    if not keys:
        return df
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    lead = [c for c in order if c not in keys]
    row = F.struct(*lead, *[c for c in rest if c not in lead])
    pick = (F.max if latest else F.min)(row)
    unordered = [c for c in rest if isinstance(df.schema[c].dataType, T.MapType)]
    if unordered:  # maps have no order of their own, so their text decides
        rank = F.struct(*[F.to_json(c) if c in unordered else F.col(c)
                          for c in [*lead, *[c for c in rest if c not in lead]]])
        pick = (F.max_by if latest else F.min_by)(row, rank)
    return df.groupBy(*keys).agg(pick.alias("__row")).select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )


def distinct_dimension(
    frames: DataFrame | Sequence[DataFrame], group_by: Sequence[str],
    carry: Sequence[str] = (), derived: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Distinct values of the group columns with carried columns and derived ones.

    Several frames are united first. The carried values are those of the smallest carried
    row, so the result does not depend on the order rows arrive in.
    """
    df = union(list(frames)) if isinstance(frames, (list, tuple)) else frames
    out = keep_one(df.select(*group_by, *[c for c in carry if c not in group_by]), group_by)
    return projection.derive(out, derived or {})


def aggregate_dimension(
    df: DataFrame, group_by: Sequence[str], columns: Mapping[str, str],
) -> DataFrame:
    """Dimension of one row per group; each column is SQL over aggregates and keys."""
    out = df.groupBy(*group_by).agg(*[
        F.expr(e).alias(n) for n, e in columns.items() if n not in group_by
    ])
    return out.select(*[g for g in group_by if g not in columns], *columns)


def unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str],
    variable: str = "variable", value: str = "value",
) -> DataFrame:
    """Plain melt; values must share a type."""
    return df.unpivot(list(ids), list(values), variable, value)


def unpivot_coded(
    df: DataFrame, codes: Mapping[str, str],
    variable: str = "line_item_code", value: str = "value",
) -> DataFrame:
    """Wide to long with a code per column; values as double, NULLs dropped."""
    ids = [c for c in df.columns if c not in codes]
    wide = df.select(*ids, *[F.col(c).try_cast("double").alias(code) for c, code in codes.items()])
    return wide.unpivot(ids, list(codes.values()), variable, value).filter(
        F.col(value).isNotNull())


def union_sources(
    sources: Sequence[Mapping[str, object]],
    derived: Mapping[str, str] | None = None,
    dedup_keys: Sequence[str] = (),
    skip_unreadable: bool = True,
) -> DataFrame:
    """Union of sources, each unpivoted, mapped and tagged on its own first.

    A source is ``{df, unpivot?, select?, domain_source?, entry_type?, event_type?, where?}``;
    ``df`` may be a callable that reads it. With ``skip_unreadable`` a source whose path is
    missing is left out. Derived columns and the dedup key apply to the union.
    """
    frames = []
    for source in sources:
        try:
            df = source["df"]() if callable(source["df"]) else source["df"]
        except AnalysisException:
            if skip_unreadable:
                continue
            raise
        if source.get("where"):
            df = df.filter(source["where"])
        if source.get("unpivot"):
            df = unpivot_coded(df, source["unpivot"])
        if source.get("select"):
            df = projection.select_map(df, source["select"])
        tags = {k: source[k] for k in ("domain_source", "entry_type", "event_type")
                if source.get(k)}
        frames.append(projection.with_constants(df, tags) if tags else df)
    if not frames:
        raise ValueError("no readable source")
    out = projection.derive(union(frames), derived or {})
    return keep_one(out, dedup_keys) if dedup_keys else out


def federated_union(models: Mapping[str, DataFrame], key: str = "domain_source") -> DataFrame:
    """Union over models, each tagged with its name."""
    return union([df.withColumn(key, F.lit(name)) for name, df in models.items()])


def distinct_values(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-null values; the limit is that of a value list in a report."""
    out = df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)
    return out if limit is None else out.limit(limit)


def values_by_measure(
    df: DataFrame, col: str | Column, measure: str | Column, descending: bool = True,
    context: Iterable[tuple[str | Column, object]] = (), limit: int | None = None,
) -> DataFrame:
    """Distinct values ordered by the average of a measure, under context filters."""
    for field, value in context:
        c = F.col(field) if isinstance(field, str) else field
        if isinstance(value, (list, tuple)):
            df = df.filter(c.isin(*value)) if value else df
        else:
            df = df.filter(c == F.lit(value))
    c = F.col(col) if isinstance(col, str) else col
    m = F.col(measure) if isinstance(measure, str) else measure
    sort = F.desc("sort_value") if descending else F.asc("sort_value")
    out = (df.filter(c.isNotNull()).groupBy(c.alias("value"))
           .agg(F.avg(m).alias("sort_value")).orderBy(sort, "value"))
    return out if limit is None else out.limit(limit)


def top_n(df: DataFrame, by: str | Column, n: int, *ties: str) -> DataFrame:
    """The n largest rows; each task keeps n rows, none sorts the whole table."""
    c = F.col(by) if isinstance(by, str) else by
    return df.orderBy(c.desc_nulls_last(), *ties).limit(n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order."""
    return keep_one(df, keys, order, latest=True)


def top_entities_latest(
    df: DataFrame, entity: str, order: str, score: str | Column, n: int,
    where: str | Column | None = None,
) -> DataFrame:
    """Rows of the n entities whose latest row scores highest."""
    src = df.filter(where) if where is not None else df
    s = F.expr(score) if isinstance(score, str) else score
    ranked = (src.groupBy(entity)
              .agg(F.max_by(s, F.struct(F.col(order), s)).alias("__score")))
    best = top_n(ranked, "__score", n, entity).select(entity)
    return df.join(best, entity, "left_semi")


def capped_by_bytes(
    df: DataFrame, max_bytes: int, order: Sequence[Column | str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first rows in ``order``, of ``columns``, whose JSON lines together take at most ``max_bytes``.

    A row counts its UTF-8 bytes as JSON and one for the line end; the first row that passes the cap
    and all after it are left out, also where a later one would fit. Rows the order leaves
    tied follow their JSON text, so reruns cut at the same place. The lengths are
    summed along a :class:`~starwright.operators.ordered.GlobalOrder`: exact, and no task sorts the whole
    report. A frame without an order has no first rows, so that is refused.
    """
    from starwright.operators.ordered import GlobalOrder

    if not order:
        raise ValueError("a byte cap needs an order of the rows")
    sent = [F.col(f"`{c}`") for c in (columns or df.columns)]
    lined = df.withColumn("__line", F.to_json(F.struct(*sent)))
    summed = GlobalOrder(lined, [*order, "__line"]).running_sum("__bytes", F.octet_length("__line") + 1)
    return summed.result().filter(F.col("__bytes") <= max_bytes).select(*sent)
