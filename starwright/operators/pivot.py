"""Pivots with totals, layouts, bins, sorting and row-over-row calculations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.functions import measures as M
from starwright.operators import partials as P
from starwright.operators.ordered import GlobalOrder
from starwright.operators.quantiles import exact_percentiles
from starwright.session import durable

LAYOUTS = ("by_measure", "by_column", "by_dimension")
TOTAL = "TOTAL"
WINDOW_KINDS = {
    "pct_change": "pct_change", "yoy": "pct_change", "diff": "diff", "row_delta": "diff",
    "running_sum": "running_sum", "rank": "rank",
}


@dataclass(frozen=True)
class PivotSpec:
    """What to pivot. ``rows``/``cols`` map output names to columns or SQL text.

    ``sort`` orders the rows: ``{by: measure, where?: column value, order}``,
    ``{field: column, dir}`` or ``{values: [first, second, …]}``; ``{rows: …, cols: {order}}``
    orders both. With ``max_columns`` a pivot of more column combinations is refused.
    """

    rows: Mapping[str, object]
    measures: Sequence[object]
    cols: Mapping[str, object] = field(default_factory=dict)
    layout: str = "by_measure"
    row_totals: bool = False
    col_totals: bool = False
    sort: Mapping[str, object] | None = None
    windows: Sequence[Sequence[str]] = ()
    buckets: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    max_columns: int | None = None


def as_expr(value: object) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def bucket_size(value: Column, size: float) -> Column:
    """Lower end of an equal-width bin."""
    return F.floor(value / F.lit(size)) * F.lit(size)


def bucket_edges(value: Column, edges: Sequence[float]) -> Column:
    """Bin label by custom edges: ``<a``, ``a-b``, …, ``>=z``."""
    chain = F.when(value < edges[0], f"<{edges[0]:g}")
    for low, high in zip(edges, edges[1:]):
        chain = chain.when((value >= low) & (value < high), f"{low:g}-{high:g}")
    return chain.when(value >= edges[-1], f">={edges[-1]:g}")


def bucket_count(df: DataFrame, value: str, count: int) -> Column:
    """Equal-frequency bin 1…count; the bounds are exact quantiles of the column.

    Only the ``count - 1`` bounds reach the driver.
    """
    probs = [i / count for i in range(1, count)]
    names = [f"q{i}" for i in range(1, count)]
    bounds = exact_percentiles(df, [], value, probs, names).first()
    above = sum((F.when(F.col(value) > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(1))
    return F.when(F.col(value).isNotNull(), above)


def row_sort(spec: PivotSpec) -> dict[str, object]:
    """The row part of the sort."""
    given = dict(spec.sort or {})
    nested = given.pop("rows", None) or {}
    given.pop("cols", None)
    return {**given, **nested}


def columns_descend(spec: PivotSpec) -> bool:
    cols = (spec.sort or {}).get("cols") or {}
    return str(cols.get("order", "asc")).lower() == "desc"


def combo_key(combo: Sequence[object]) -> str:
    """Name of a column combination: first value, two bars, then the others."""
    first, *others = map(str, combo)
    return "||".join([first, " | ".join(others)] if others else [first])


def wide_name(combo: str, key: str, layout: str) -> str:
    return f"{combo}||{key}" if layout == "by_column" else f"{key}||{combo}"


def column_values(
    df: DataFrame, cols: Iterable[str], limit: int | None = None, offset: int = 0,
) -> list[tuple]:
    """Sorted distinct non-NULL combinations of the column fields, ``limit`` of them from ``offset`` on."""
    found = df.select(*cols).dropna().distinct().orderBy(*cols)
    if offset:
        found = found.offset(offset)
    return [tuple(r) for r in (found if limit is None else found.limit(limit)).collect()]


@dataclass(frozen=True)
class _Groups:
    """States per (row keys, column keys) of a pivot, and what they were made from."""

    spec: PivotSpec
    measures: list[M.Measure]
    extra: list[M.Measure]  # for sorting only
    keys: list[str]
    cols: list[str]
    finest: DataFrame  # also by the values of distinct counts
    fine: DataFrame
    center: dict[str, float]

    @property
    def base(self) -> list[M.Measure]:
        return [m for m in self.measures if not m.computed]

    @property
    def distinct(self) -> list[M.Measure]:
        return [m for m in self.base if P.kind_of(m) == P.EXACT]

    @property
    def stateful(self) -> list[M.Measure]:
        return [m for m in [*self.base, *self.extra] if P.kind_of(m) != P.EXACT]


def _groups(df: DataFrame, spec: PivotSpec) -> _Groups:
    """One pass over the table; the groups are kept in the shared folder if more than one step reads them."""
    if spec.layout not in LAYOUTS:
        raise ValueError(f"unknown layout {spec.layout!r}")
    for _, _, kind, *_ in spec.windows:
        if kind not in WINDOW_KINDS:
            raise ValueError(f"unknown window type {kind!r}")
    ms = [M.measure(m) for m in spec.measures]
    rows = {n: as_expr(e) for n, e in spec.rows.items()}
    for name, how in spec.buckets.items():
        if how.get("size"):
            rows[name] = bucket_size(rows[name], how["size"])
        elif how.get("edges"):
            rows[name] = bucket_edges(rows[name], how["edges"])
        else:
            df = df.withColumn("__binned", rows[name])
            rows[name] = bucket_count(df, "__binned", how["count"])
    cols = {f"__c{i}": as_expr(e) for i, e in enumerate(spec.cols.values())}
    sort = row_sort(spec)
    extra = [M.Measure("__sort", sort["field"], "min")] if sort.get("field") is not None else []
    keys = [f"__r_{n}" for n in rows]
    keyed = df.select("*", *[c.alias(k) for k, c in zip(keys, rows.values())], *[c.alias(n) for n, c in cols.items()])
    base = [*[m for m in ms if not m.computed], *extra]
    finest = P.grouped(keyed, [*keys, *cols], base)
    split = any(P.kind_of(m) == P.EXACT for m in base)
    if cols or split or any(P.kind_of(m) in P.MOMENTS for m in base):
        finest = durable(finest)  # columns, cells and centers all come from these groups
    center = P.centers(finest, base)
    fine = P.regrouped(finest, [*keys, *cols], [m for m in base if P.kind_of(m) != P.EXACT], center) if split else finest
    return _Groups(spec, ms, extra, keys, list(cols), finest, fine, center)


def _matching(cols: Sequence[str], combo: Sequence[object]) -> Column:
    cond = F.lit(True)
    for name, v in zip(cols, combo):
        cond = cond & (F.col(name) == F.lit(v))
    return cond


def _distinct_counts(g: _Groups, m: M.Measure, names: Sequence[tuple[str, Column | None]]) -> DataFrame:
    """An exact distinct count per output row, one column per ``(name, test of the columns or None)``.

    Rows are made distinct from the finest level up: what is distinct under a prefix of the row keys
    follows from what is distinct one key further down, so neither raw rows nor groups are copied
    per level or per column.
    """
    v = P.value_name(m)
    found, levels = P.distinct_values(g.finest, [*g.keys, *g.cols], m), []
    depths = range(len(g.keys), -1, -1) if g.spec.row_totals else [len(g.keys)]
    for depth in depths:
        prefix = g.keys[:depth]
        if depth < len(g.keys):
            found = found.select(*prefix, *g.cols, v).distinct()
        cells = found.groupBy(*prefix, *g.cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__whole", F.lit(not g.cols))
        if g.cols and any(match is None for _, match in names):
            whole = found.select(*prefix, v).distinct().groupBy(*prefix).agg(F.count(F.lit(1)).alias("__n"))
            cells = cells.unionByName(whole.withColumn("__whole", F.lit(True)), allowMissingColumns=True)
        aggs = [F.sum(F.when(F.col("__whole") if match is None else ~F.col("__whole") & match, F.col("__n"))).alias(name)
                for name, match in names]
        level = cells.groupBy(*prefix).agg(*aggs)
        missing = [F.lit(None).cast(g.finest.schema[k].dataType).alias(k) for k in g.keys[depth:]]
        levels.append(level.select(*g.keys[:depth], *missing, *[F.col(f"`{n}`") for n, _ in names],
                                   F.lit((1 << (len(g.keys) - depth)) - 1).cast("long").alias("__g")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _with_distinct(out: DataFrame, g: _Groups, slots: Sequence[tuple[str, M.Measure, Column | None]]) -> DataFrame:
    """Add the exact distinct counts of ``slots`` to rows keyed by (level, row keys)."""
    for m in g.distinct:
        names = [(name, match) for name, owner, match in slots if owner is m]
        found = _distinct_counts(g, m, names).withColumnsRenamed({k: f"__d{i}" for i, k in enumerate([*g.keys, "__g"])})
        same = F.col("__g") == F.col(f"__d{len(g.keys)}")
        for i, k in enumerate(g.keys):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__d{i}"))
        out = out.join(found, same, "left").drop(*[f"__d{i}" for i in range(len(g.keys) + 1)])
        out = out.withColumns({name: F.coalesce(F.col(f"`{name}`"), F.lit(0)) for name, _ in names})
    return out


def pivot(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """One row per row-key combination, measures per column combination.

    The table is read once into states per (row keys, column keys), kept in the shared folder;
    columns, cells, totals and subtotals come from those, whatever the aggregate (see
    ``operators/partials.py``). As many columns as there are combinations; :func:`pivot_long` and
    :func:`pivot_pages` are for more than a frame of columns is good for.
    """
    g = _groups(df, spec)
    combos = column_values(g.fine, g.cols, None if spec.max_columns is None else spec.max_columns + 1) if g.cols else []
    if spec.max_columns is not None and len(combos) > spec.max_columns:
        raise ValueError(f"more than {spec.max_columns} column combinations; add filters or read it in pages")
    if columns_descend(spec):
        combos.reverse()
    return _wide(df, g, combos)


def pivot_pages(df: DataFrame, spec: PivotSpec, columns: int) -> Iterator[DataFrame]:
    """The same pivot in pages of at most ``columns`` combinations, all from one set of states."""
    g, at = _groups(df, spec), 0
    while combos := column_values(g.fine, g.cols, columns, at):
        yield _wide(df, g, combos)
        at += len(combos)


def pivot_long(df: DataFrame, spec: PivotSpec, name: str = "column") -> DataFrame:
    """The same cells as rows: row keys, the column combination by its key, measures.

    No combination comes to the driver, so there may be any number of them.
    """
    if spec.row_totals or spec.col_totals or spec.windows:
        raise ValueError("totals and windows are those of the wide form")
    g = _groups(df, spec)
    some = g.fine.dropna(subset=g.cols)
    cells = some.groupBy(*g.keys, *g.cols).agg(
        F.lit(1).alias("__one"), *[P.finished(m, g.center).alias(m.key) for m in g.base if m not in g.distinct])
    for m in g.distinct:
        counted = P.distinct_values(g.finest.dropna(subset=g.cols), [*g.keys, *g.cols], m).groupBy(*g.keys, *g.cols).agg(
            F.count(F.lit(1)).alias(m.key))
        counted = counted.withColumnsRenamed({k: f"__d{i}" for i, k in enumerate([*g.keys, *g.cols])})
        same = F.lit(True)
        for i, k in enumerate([*g.keys, *g.cols]):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__d{i}"))
        cells = cells.join(counted, same, "left").withColumn(m.key, F.coalesce(F.col(f"`{m.key}`"), F.lit(0)))
    for m in g.measures:
        if m.computed:
            cells = cells.withColumn(m.key, M.computed_column(m.field, M.as_operand))
    first, *others = [F.col(c).cast("string") for c in g.cols]
    key = F.concat(first, F.lit("||"), F.concat_ws(" | ", *others)) if others else first
    return cells.select(*[F.col(k).alias(n) for k, n in zip(g.keys, spec.rows)], key.alias(name),
                        *[F.col(f"`{m.key}`") for m in g.measures])


def _wide(df: DataFrame, g: _Groups, combos: Sequence[tuple]) -> DataFrame:
    spec, ms, keys, cols = g.spec, g.measures, g.keys, g.cols
    if cols and not combos:
        return g.fine.select(*[F.col(k).alias(n) for k, n in zip(keys, spec.rows)]).limit(0)
    # (combination or None for the whole row, its test)
    slots = [(combo_key(c), _matching(cols, c)) for c in combos] if cols else [(None, None)]
    order = []
    pairs = [(s, m) for s in slots for m in ms] if spec.layout != "by_measure" else \
            [(s, m) for m in ms for s in slots]
    for (combo, match), m in pairs:
        order.append((m.key if combo is None else wide_name(combo, m.key, spec.layout), m, combo, match))
    if cols and spec.col_totals:
        order += [(wide_name(TOTAL, m.key, spec.layout), m, TOTAL, None) for m in ms]
    aggs = [P.finished(m, g.center, match).alias(name) for name, m, _, match in order if m in g.stateful]
    aggs += [P.finished(m, g.center).alias(m.key) for m in g.extra]
    aggs = aggs or [F.lit(1).alias("__one")]
    group = [F.col(k) for k in keys]
    if spec.row_totals:
        out = g.fine.rollup(*group).agg(*aggs, F.grouping_id().alias("__g"))
    else:
        out = g.fine.groupBy(*group).agg(*aggs).withColumn("__g", F.lit(0).cast("long"))
    if g.distinct:
        out = _with_distinct(out, g, [(name, m, match) for name, m, _, match in order])

    def name_of(key: str, combo: str | None) -> str:
        return key if combo is None else wide_name(combo, key, spec.layout)

    for name, m, combo, _ in order:
        if m.computed and m.field["fn"] not in (*M.ROW_ORDERED, "share"):
            out = out.withColumn(name, M.computed_column(
                m.field,
                lambda k, c=combo: F.col(f"`{name_of(k, c)}`") if isinstance(k, str) else F.lit(k)))
    windows = list(spec.windows) + [
        [m.key, m.field["of"], {"delta": "diff", "pct_delta": "pct_change"}[m.field["fn"]]]
        for m in ms if m.computed and m.field["fn"] in M.ROW_ORDERED
    ]
    combos_named = [c for c, _ in slots]
    for m in ms:
        if m.computed and m.field["fn"] == "share":
            out = _with_share(out, m, combos_named, name_of)
    if windows:
        out = _with_windows(out, windows, keys, combos_named, name_of)

    labelled = []
    for i, (key, name) in enumerate(zip(keys, spec.rows)):
        if spec.row_totals:
            bit = F.lit(1 << (len(keys) - 1 - i))
            rolled = F.col("__g").bitwiseAND(bit) > 0
            labelled.append(F.when(rolled, TOTAL).otherwise(F.col(key).cast("string")).alias(name))
        else:
            labelled.append(F.col(key).alias(name))
    measured = [n for n, *_ in order if n in out.columns]
    added = [name_of(w[0], c) for w in windows for c in combos_named
             if name_of(w[0], c) in out.columns and name_of(w[0], c) not in measured]
    out = _sorted(out, spec, keys, name_of, combos)
    return out.select(*labelled, *[F.col(f"`{n}`") for n in [*measured, *added]])


def _sorted(out: DataFrame, spec: PivotSpec, keys: Sequence[str], name_of, combos) -> DataFrame:
    sort = row_sort(spec)
    # totals come after the details they sum up
    default = [F.col("__g").asc(), *[F.col(k).asc_nulls_last() for k in keys]]
    if sort.get("values"):
        place = F.array_position(F.array(*[F.lit(v) for v in sort["values"]]),
                                 F.col(keys[0]).cast("string"))
        return out.orderBy(F.col("__g"), F.when(place > 0, place).asc_nulls_last(), *default[1:])
    direction = str(sort.get("dir", sort.get("order", "asc"))).lower()
    column = None
    if sort.get("by"):
        where = sort.get("where")
        column = name_of(sort["by"], None if where is None else str(where))
    elif sort.get("field") is not None:
        column = "__sort"
    if column is None:
        return out.orderBy(*default)
    c = F.col(f"`{column}`")
    first = c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()
    return out.orderBy(F.col("__g"), first, *default[1:])


def _with_share(out: DataFrame, m: M.Measure, combos, name_of) -> DataFrame:
    """Share of each detail row in the total of the details."""
    of = m.field["of"]
    out = durable(out)  # read for the totals and for the rows
    for combo in combos:
        src, name = name_of(of, combo), name_of(m.key, combo)
        part = m.field.get("partition_by")
        detail = F.col("__g") == 0
        if part:
            from pyspark.sql import Window
            total = F.sum(F.when(detail, F.col(f"`{src}`"))).over(Window.partitionBy(f"__r_{part}"))
        else:
            total = out.filter(detail).select(F.sum(f"`{src}`").alias("t")).scalar()
        out = out.withColumn(name, F.when(detail, F.try_divide(
            F.col(f"`{src}`").cast("double"), F.nullif(total, F.lit(0)))))
    return out


def _with_windows(out: DataFrame, windows, keys, combos, name_of) -> DataFrame:
    """Row-over-row columns over the detail rows in key order; totals get NULL."""
    detail = out.filter(F.col("__g") == 0)
    carried, steps, ranked = {}, {}, []
    for key, source, kind, *_ in windows:
        for combo in combos:
            src, name = name_of(source, combo), name_of(key, combo)
            if src not in out.columns:
                continue
            now, prev = F.col(f"`{src}`"), F.col(f"`__before_{src}`")
            if WINDOW_KINDS[kind] == "running_sum":
                carried[name] = ("sum", now)
            elif WINDOW_KINDS[kind] == "rank":
                ranked.append((name, src))
            else:
                carried[f"__before_{src}"] = ("lag", now)
                change = now - prev
                if WINDOW_KINDS[kind] == "pct_change":
                    change = F.round(F.try_divide(change.cast("double"),
                                                  F.nullif(prev, F.lit(0))), 4)
                steps[name] = change
    result = detail
    if carried:
        result = GlobalOrder(detail, [F.col(k).asc_nulls_last() for k in keys]).add(carried).result()
        result = result.withColumns(steps).drop(*[c for c in carried if c.startswith("__before_")])
    for name, src in ranked:
        result = (GlobalOrder(result.withColumn("__v", F.col(f"`{src}`")), ["__v", *keys])
                  .rank(name, "__v").result().drop("__v"))
    totals = out.filter(F.col("__g") > 0)
    return result.unionByName(totals, allowMissingColumns=True)


def pivot_labels(spec: PivotSpec, columns: Sequence[str]) -> list[dict[str, object]]:
    """Key, label, format and group heading of the result columns of :func:`pivot`."""
    ms = {m.key: m for m in map(M.measure, spec.measures)}
    windows = {w[0]: (w[3] if len(w) > 3 and w[3] else w[0].replace("_", " ").title())
               for w in spec.windows}
    out: list[dict[str, object]] = []
    for name in columns:
        if name in spec.rows:
            out.append({"key": name, "label": name.replace("_", " ").title()})
            continue
        if spec.layout == "by_column":
            combo, _, key = name.rpartition("||")
        else:
            key, _, combo = name.partition("||")
        own = windows.get(key) or (ms[key].title if key in ms else key)
        fmt = "%" if key in windows else ms[key].fmt if key in ms else None
        head, _, tail = combo.partition("||")
        shown = combo.replace("||", " | ")
        if not combo:
            entry = {"label": own}
        elif spec.layout == "by_column":
            entry = {"label": f"{tail} | {own}" if tail else own, "group": head}
        elif spec.layout == "by_dimension":
            entry = {"label": tail, "group": head} if tail else {"label": combo}
        else:
            entry = {"label": shown, "group": own}
        out.append({"key": name, "format": fmt, **entry})
    return out


def pivot_plain(
    df: DataFrame, rows: Sequence[str], cols: Sequence[str], measures: Sequence[object],
) -> DataFrame:
    """A pivot over all column fields without totals or windows.

    Columns are named by the combination, followed by the measure if there is more than one.
    """
    spec = PivotSpec({c: F.col(f"`{c}`") for c in rows}, measures, {c: F.col(f"`{c}`") for c in cols}, "by_column")
    out = pivot(df, spec)
    if not cols:
        return out
    names = {}
    for name in out.columns[len(rows):]:
        combo, _, key = name.rpartition("||")
        names[name] = combo if len(spec.measures) == 1 else f"{combo}_{key}"
    return out.withColumnsRenamed(names)
