"""The request kinds: chart, box, OHLC, flat table, KPI row, pivot, value list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwright.functions import clean
from starwright.functions import measures as M
from starwright.operators import setops
from starwright.operators.ordered import GlobalOrder
from starwright.operators.pivot import PivotSpec, pivot, pivot_plain
from starwright.operators.quantiles import exact_percentiles
from starwright.plans.catalog import Catalog

MAX_POINTS = 30_000  # points in one list of a series


def short(ref: str) -> str:
    """The column name of a field; of one in a role, with the table it is reached by before it."""
    name, _, via = ref.split(".")[-1].partition("@")
    return f"{via}_{name}".replace("@", "_") if via else name


def ordered(df: DataFrame, sort: Mapping[str, str] | None, default: Sequence[str] = ()) -> DataFrame:
    """Sort by ``{by, order}``, else by the default columns."""
    if sort and sort.get("by"):
        c = F.col(f"`{short(sort['by'])}`")
        desc = sort.get("order", "asc").lower() == "desc"
        return df.orderBy(c.desc_nulls_last() if desc else c.asc_nulls_last(), *default)
    return df.orderBy(*default) if default else df


def chart(
    catalog: Catalog, x: str, y: str | Sequence[str], group_by: str | None = None,
    aggregation: str = "avg", filters: Sequence[Mapping[str, object]] = (),
    sort: Mapping[str, str] | None = None, path: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregate of each y per x (and group), ordered by x: columns x, [group], y…"""
    ys = [y] if isinstance(y, str) else list(y)
    keys = {short(ref): ref for ref in [x, *([group_by] if group_by else [])]}
    out = catalog.aggregated(keys, [M.Measure(short(v), v, aggregation) for v in ys], filters, path)
    return ordered(out, sort, list(keys))


def series(points: DataFrame, x: str, y: str, group: str | None = None,
           max_points: int = MAX_POINTS) -> DataFrame:
    """One row per group with its list of (x, y); a longer series continues in more parts.

    The points are aggregates already (one per x), and a list never exceeds ``max_points``. Without a
    group the points are numbered along a global order, not in one window.
    """
    key = F.col(group) if group else F.lit("all")
    rows = points.select(key.alias("series"), F.col(x).alias("x"), F.col(y).alias("y"))
    if group:
        numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy("series").orderBy("x")))
    else:
        numbered = GlobalOrder(rows, ["x"]).row_number("__n").result()
    parted = numbered.withColumn("part", F.floor((F.col("__n") - 1) / max_points))
    return parted.groupBy("series", "part").agg(
        F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))


def heatmap(
    catalog: Catalog, x: str, y: str, z: str, aggregation: str = "avg",
    filters: Sequence[Mapping[str, object]] = (), wide: bool = False,
) -> DataFrame:
    """z per (x, y); ``wide`` turns the y values into columns."""
    cells = catalog.aggregated({short(x): x, short(y): y}, [M.Measure(short(z), z, aggregation)], filters)
    if not wide:
        return cells
    return pivot_plain(cells, [short(x)], [short(y)], [[short(z), f"`{short(z)}`", "max"]])  # one value per cell


def box(
    catalog: Catalog, category: str, y: str, group: str | None = None,
    filters: Sequence[Mapping[str, object]] = (),
) -> DataFrame:
    """Raw (category, y, group) rows of a box chart."""
    refs = [category, y, *([group] if group else [])]
    df, at = catalog.joined(refs, filters)
    return df.select(*[at[r].col.alias(short(r)) for r in refs])


def box_summary(df: DataFrame, category: Sequence[str], y: str) -> DataFrame:
    """Minimum, quartiles, maximum and count per category; quartiles are exact."""
    ends = df.groupBy(*category).agg(
        F.min(y).alias("min"), F.max(y).alias("max"), F.count(y).alias("n"))
    quarts = exact_percentiles(df, category, y, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return ends.join(quarts, list(category)).select(
        *category, "min", "q1", "median", "q3", "max", "n")


def ohlc(
    catalog: Catalog, category: str, open_: str, high: str, low: str, close: str,
    filters: Sequence[Mapping[str, object]] = (),
) -> DataFrame:
    """(category, open, high, low, close) rows of a candlestick chart."""
    refs = {"category": category, "open": open_, "high": high, "low": low, "close": close}
    df, at = catalog.joined(refs.values(), filters)
    return df.select(*[at[r].col.alias(n) for n, r in refs.items()]).orderBy("category")


def flat_table(
    catalog: Catalog, columns: Sequence[Sequence[object]],
    filters: Sequence[Mapping[str, object]] = (), sort: Mapping[str, str] | None = None,
    limit: int | None = None, path: Sequence[str] | None = None,
) -> DataFrame:
    """Columns ``[key, field, aggregation?, format?, label?]``.

    With any aggregate among them, the plain ones become the group.
    """
    cols = [(list(c) + [None] * 5)[:3] for c in columns]
    if any(agg for *_, agg in cols):
        out = catalog.aggregated({k: f for k, f, agg in cols if not agg},
                                 [M.Measure(k, f, agg) for k, f, agg in cols if agg], filters, path)
        out = out.select(*[F.col(f"`{k}`") for k, *_ in cols])
    else:
        df, at = catalog.joined([f for _, f, _ in cols], filters, path)
        out = df.select(*[at[f].col.alias(k) for k, f, _ in cols])
    out = ordered(out, sort)
    return out if limit is None else out.limit(limit)


def resolved_measures(catalog: Catalog, measures: Sequence[object]) -> tuple[list[M.Measure], list[str]]:
    """Measures with their fields as columns, and the field references they use."""
    out, refs = [], []
    for m in map(M.measure, measures):
        if not m.computed and isinstance(m.field, str) and m.field != "*":
            refs.append(m.field)
            m = replace(m, field=catalog.resolve(m.field).col)
        out.append(m)
    return out, refs


def kpi(
    catalog: Catalog, measures: Sequence[object], filters: Sequence[Mapping[str, object]] = (),
    path: Sequence[str] | None = None,
) -> DataFrame:
    """One row of measures."""
    return catalog.aggregated({}, [M.measure(m) for m in measures], filters, path)


def pivot_request(
    catalog: Catalog, rows: Sequence[str], measures: Sequence[object], cols: Sequence[str] = (),
    filters: Sequence[Mapping[str, object]] = (), path: Sequence[str] | None = None,
    **options: object,
) -> DataFrame:
    """Pivot over field references; options are those of :class:`PivotSpec`."""
    ms, refs = resolved_measures(catalog, measures)
    sort = dict(options.pop("sort", None) or {})
    if sort.get("rows"):
        sort = {**sort.pop("rows"), **sort}
    if sort.get("field"):
        refs.append(sort["field"])
        sort["field"] = catalog.resolve(sort["field"]).col
    df, at = catalog.joined([*rows, *cols, *refs], filters, path)
    return pivot(df, PivotSpec(
        rows={short(r): at[r].col for r in rows}, cols={short(c): at[c].col for c in cols},
        measures=ms, sort=sort or None, **options))


def value_list(
    catalog: Catalog, field: str, order_by: str | None = None, descending: bool = True,
    context: Sequence[tuple[str, object]] = (), limit: int | None = None,
) -> DataFrame:
    """Distinct values of a field, sorted by value or by the average of a measure."""
    refs = [field, *([order_by] if order_by else []), *[f for f, _ in context]]
    df, at = catalog.joined(refs)
    pairs = [(at[f].col, v) for f, v in context]
    if order_by:
        return setops.values_by_measure(df, at[field].col, at[order_by].col, descending, pairs, limit)
    for c, v in pairs:
        df = df.filter(c.isin(*v) if isinstance(v, (list, tuple)) else c == F.lit(v))
    return setops.distinct_values(df.select(at[field].col.alias("value")), "value", limit)


def formatted(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Numbers as display text by format code, other columns as they are."""
    return df.withColumns({c: clean.display(c, f) for c, f in formats.items()})


def response(df: DataFrame, order: Sequence[Column | str] = (), max_rows: int | None = None,
             max_mb: float | None = None) -> DataFrame:
    """What is sent to a client: the first rows in ``order``, at most so many and so many megabytes.

    Without limits the frame goes out whole; a limit needs an order.
    """
    if not order and (max_rows is not None or max_mb is not None):
        raise ValueError("a cut response needs an order of the rows")
    if max_rows is not None:
        df = df.orderBy(*order).limit(max_rows)
    return df if max_mb is None else setops.capped_by_bytes(df, int(max_mb * 1024 * 1024), order)


def single_table(
    df: DataFrame, domain: str, name: str,
) -> Catalog:
    """Catalog of one raw table, for requests without joins."""
    return Catalog().add(domain, name, df)
