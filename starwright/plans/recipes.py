"""Recipes: ordered steps over a table, and the table kinds a star is built from."""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.functions import measures as M
from starwright.operators import filters, indicators, joins, pivot, projection, setops

log = logging.getLogger(__name__)

Step = Callable[[DataFrame, Mapping[str, object]], DataFrame]


def _aggregate(df: DataFrame, p: Mapping[str, object]) -> DataFrame:
    ms = [M.Measure(a.get("alias", f"{a['func']}_{a['col']}"), a["col"], a.get("func", "sum").lower())
          for a in p["aggs"]]
    return M.aggregate(df, p.get("group_by", []), ms)


def call_function(df: DataFrame, p: Mapping[str, object]) -> DataFrame:
    """Step given as a callable or a dotted path ``package.module.function``."""
    fn = p["fn"]
    if isinstance(fn, str):
        module, name = fn.rsplit(".", 1)
        fn = getattr(importlib.import_module(module), name)
    out = fn(df, **{k: v for k, v in p.items() if k not in ("fn", "op")})
    return df if out is None else out


def builtin_steps() -> dict[str, Step]:
    return {
        "filter": lambda df, p: filters.where_all(df, p.get("conditions", [])),
        "join": lambda df, p: joins.join(df, p["right"], p["on"], p.get("how", "inner")),
        "select": lambda df, p: projection.select_map(df, p["columns"])
        if isinstance(p["columns"], Mapping) else projection.select(df, p["columns"]),
        "derive": lambda df, p: projection.derive(df, p["expressions"]),
        "dedup": lambda df, p: setops.keep_one(df, p["keys"], p.get("order", ())),
        "drop": lambda df, p: projection.drop(df, p["columns"]),
        "enrich": lambda df, p: joins.enrich(df, p["table"], p["join"], p["columns"]),
        "window": lambda df, p: indicators.window_column(
            df, p["partition"], p["order"], p["expr"], p.get("alias", "window_col")),
        "unpivot": lambda df, p: setops.unpivot(
            df, p["id_cols"], p["value_cols"], p.get("var_name", "variable"),
            p.get("val_name", "value")),
        "pivot": lambda df, p: pivot.pivot_plain(
            df, p["rows"], p.get("cols", []), p["measures"]),
        "aggregate": _aggregate,
        "hook": call_function,
    }


class Recipe:
    """Named steps; users may register more. Unknown steps are skipped with a warning."""

    def __init__(self) -> None:
        self.steps = builtin_steps()

    def register(self, name: str, step: Step) -> Recipe:
        self.steps[name] = step
        return self

    def names(self) -> list[str]:
        return sorted(self.steps)

    def run(self, df: DataFrame, steps: Sequence[Mapping[str, object]]) -> DataFrame:
        """Apply ``{op, …parameters}`` steps; parameters may also sit under ``params``."""
        for spec in steps:
            step = self.steps.get(spec["op"])
            if step is None:
                log.warning("unknown step %s skipped", spec["op"])
                continue
            params = {**{k: v for k, v in spec.items() if k not in ("op", "params")},
                      **spec.get("params", {})}
            df = df.transform(lambda d, s=step, p=params: s(d, p))
        return df


def standard_table(
    source: DataFrame, where: Sequence[str] = (),
    lookups: Sequence[Mapping[str, object]] = (),
    select: Mapping[str, str] | None = None, derive: Mapping[str, str] | None = None,
    unique: Sequence[str] = (), order: Sequence[str] = (), drop: Sequence[str] = (),
) -> DataFrame:
    """The usual table: filter, look up, select, derive, dedup, drop."""
    df = filters.where_all(source, where)
    for lk in lookups:
        df = joins.enrich(df, lk["table"], lk["on"], lk["columns"])
    if select:
        df = projection.select_map(df, select)
    df = projection.derive(df, derive or {})
    if unique:
        df = setops.keep_one(df, unique, order)
    return projection.drop(df, drop) if drop else df


def indicator_table(
    source: DataFrame, columns: Sequence[Sequence[object]], entity: str, order: str,
) -> DataFrame:
    """Table of declared columns over a price table.

    Options of a column: ``indicator`` with its parameters, ``derived`` SQL, or none for a
    column taken from the source. Only the declared columns are kept.
    """
    options = {c[0]: (c[4] if len(c) > 4 and c[4] else {}) for c in columns}
    specs = {n: o for n, o in options.items() if "indicator" in o}
    out = indicators.add_indicators(source, specs, entity, order)
    out = projection.derive(out, {n: o["derived"] for n, o in options.items() if "derived" in o})
    return out.select(*[F.col(n) for n in options if n in out.columns])
