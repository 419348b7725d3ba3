"""Tables, fields and edges a request may name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.functions import measures as M
from starwright.operators import partials as P
from starwright.operators.filters import apply_specs
from starwright.operators.joins import (
    Edge, auto_edges, column_of, estimated_bytes, follow, join_steps, reachable_domains, role_of,
)


@dataclass(frozen=True)
class Field:
    """A resolved field reference."""

    domain: str
    table: str
    column: str

    @property
    def col(self) -> Column:
        return column_of(self.table, self.column)


@dataclass
class Catalog:
    """Tables by name, grouped in domains, with the edges between them.

    ``fields`` may give a table's field names other than its column names
    (``{table: {field: column}}``).
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    domains: dict[str, list[str]] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    depends_on: dict[str, list[str]] = field(default_factory=dict)
    fields: dict[str, dict[str, str]] = field(default_factory=dict)

    def add(self, domain: str, name: str, df: DataFrame, renames: Mapping[str, str] | None = None
            ) -> Catalog:
        self.tables[name] = df
        self.domains.setdefault(domain, []).append(name)
        if renames:
            self.fields[name] = dict(renames)
        return self

    def link(self, *edges: Edge) -> Catalog:
        self.edges.extend(edges)
        return self

    def link_automatically(self, rules: Sequence[tuple[str, str, str]]) -> Catalog:
        """Edges for every fact holding one of the foreign keys."""
        return self.link(*auto_edges(self.tables, rules))

    @property
    def domain_of(self) -> dict[str, str]:
        return {t: d for d, names in self.domains.items() for t in names}

    def resolve(self, ref: str) -> Field:
        """``domain.field`` to a column: longest matching domain, first table that has it.

        ``domain.table.field`` names the table as well. ``domain.field@table`` is the field in the role its
        table has when reached by way of that table, such as the nation of the customer.
        """
        ref, at, via = ref.partition("@")
        if via and role_of(via)[0] not in self.tables:
            raise ValueError(f"unknown table {via!r}")
        parts = ref.split(".")
        for cut in range(len(parts) - 1, 0, -1):
            domain, rest = ".".join(parts[:cut]), parts[cut:]
            for table in self.domains.get(domain, ()):
                if len(rest) == 2 and rest[0] != table or len(rest) > 2:
                    continue
                name = rest[-1]
                column = self.fields.get(table, {}).get(name, name)
                if column in self.tables[table].columns:
                    return Field(domain, table + at + via, column)
        raise ValueError(f"unknown field {ref!r}")

    def find(self, ref: str) -> Field | None:
        try:
            return self.resolve(ref)
        except ValueError:
            return None

    def joined(
        self, refs: Iterable[str], filters: Sequence[Mapping[str, object]] = (),
        path: Sequence[str] | None = None,
    ) -> tuple[DataFrame, dict[str, Field]]:
        """The tables of the fields joined, with filters applied before the joins.

        Filters on unknown fields or on tables out of reach of the requested domains are
        skipped. Catalyst pushes the filters down to the scans.
        """
        found, usable, base, steps = self._steps(refs, filters, path)
        df = follow(self.tables[base], base, steps, self.tables)
        return apply_specs(df, usable, lambda ref: self.resolve(ref).col), found

    def _steps(self, refs, filters, path) -> tuple[dict[str, Field], list, str, list[Edge]]:
        found = {r: self.resolve(r) for r in refs}
        allowed = reachable_domains({f.domain for f in found.values()}, self.depends_on)
        usable, filter_fields = [], []
        for spec in filters:
            target = self.find(spec["field"])
            if target is not None and target.domain in allowed:
                usable.append(spec)
                filter_fields.append(target)
        needed = {f.table for f in [*found.values(), *filter_fields]}
        if not needed:
            raise ValueError("a request names at least one field")
        base, steps = join_steps(self.tables, self.edges, needed, path, allowed, self.domain_of)
        return found, usable, base, steps

    def aggregated(
        self, keys: Mapping[str, str], measures: Sequence[M.Measure], filters: Sequence[Mapping[str, object]] = (),
        path: Sequence[str] | None = None, early: bool | None = None,
    ) -> DataFrame:
        """Measures per ``keys`` {name: field reference}; fields of measures are references as well.

        Where all measures are of the first table of the join and have a state that merges, its rows may
        be aggregated by the columns the joins, keys and filters need *before* they are joined:
        a join repeats or drops all rows of such a group alike. ``early`` says whether; by default it is done if a
        table to be joined is too large to be broadcast, so that groups are shuffled to it
        and not raw rows. With small tables only, the rows are joined where they are read.
        """
        plain = [m for m in measures if not m.computed]
        fields = [m.field for m in plain if isinstance(m.field, str) and m.field != "*"]
        found, usable, base, steps = self._steps([*keys.values(), *fields], filters, path)
        ready = [replace(m, field=found[m.field].col) if m.field in fields else m for m in plain]
        own = {f.table for r, f in found.items() if r in fields} | ({base} if len(fields) < len(plain) else set())
        possible = steps and own <= {base} and all(
            P.kind_of(m) in P.ADDITIVE and m.where is None and isinstance(m.field, str) for m in plain)
        if early is None:
            early = possible and any(self._large(role_of(e.right)[0]) for e in steps)
        if not (early and possible):
            df = apply_specs(follow(self.tables[base], base, steps, self.tables), usable, lambda ref: self.resolve(ref).col)
            out = [M.aggregate_column(m) for m in ready]
            by = [found[ref].col.alias(name) for name, ref in keys.items()]
            grouped = df.groupBy(*by).agg(*out) if by else df.agg(*out)
            return M.with_computed(grouped, measures).select(*keys, *[F.col(f"`{m.key}`") for m in measures])
        inner = [spec for spec in usable if self.resolve(spec["field"]).table == base]
        outer = [spec for spec in usable if spec not in inner]
        fact = apply_specs(self.tables[base].alias(base), inner, lambda ref: self.resolve(ref).col)
        kept = {f.column for r, f in found.items() if f.table == base and r in keys.values()}
        kept |= {a for e in steps if e.left == base for a, _ in e.on}
        states = P.grouped(fact, [column_of(base, c) for c in sorted(kept)], ready)
        df = apply_specs(follow(states, base, steps, self.tables), outer, lambda ref: self.resolve(ref).col)
        by = [found[ref].col.alias(name) for name, ref in keys.items()]
        out = [P.finished(m, {}).alias(m.key) for m in ready]
        grouped = df.groupBy(*by).agg(*out) if by else df.agg(*out)
        return M.with_computed(grouped, measures).select(*keys, *[F.col(f"`{m.key}`") for m in measures])

    def _large(self, table: str) -> bool:
        """Whether a table is over the session's broadcast threshold by Catalyst's estimate."""
        df = self.tables[table]
        jvm = df.sparkSession._jsparkSession.sessionState().conf()
        return estimated_bytes(df) > int(jvm.autoBroadcastJoinThreshold())
