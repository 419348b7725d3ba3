"""Joins along declared edges of a star schema, lookups and enrichment.

No broadcast hints are forced: Catalyst broadcasts a side whose size is below
``spark.sql.autoBroadcastJoinThreshold``, AQE re-checks it at run time and splits skewed
partitions of the sort-merge joins that remain.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """Two tables joined on all pairs of ``on``; ``optional`` edges keep unmatched rows."""

    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    optional: bool = False
    domain: str | None = None
    name: str | None = None

    def flipped(self) -> Edge:
        return Edge(self.right, self.left, tuple((b, a) for a, b in self.on),
                    self.optional, self.domain, self.name)


def edge(left: str, right: str, *on: str, optional: bool = False, domain: str | None = None,
         name: str | None = None) -> Edge:
    """Edge from ``"a=b"`` pairs; a single name stands for both sides."""
    pairs = tuple((p.split("=")[0].strip(), p.split("=")[-1].strip()) for p in on)
    return Edge(left, right, pairs, optional, domain, name)


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, on=list(on), how=how)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Broadcast hint when the estimated size is within the limit, else the frame as is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def column_of(table: str, column: str) -> Column:
    return F.col(f"`{table}`.`{column}`")


def key_condition(left: str, right: str, on: Iterable[tuple[str, str]]) -> Column:
    pairs = [column_of(left, a) == column_of(right, b) for a, b in on]
    return reduce(lambda x, y: x & y, pairs)


def role_of(name: str) -> tuple[str, str | None]:
    """``table@via`` as (table, via); a plain table has no role."""
    table, _, via = name.partition("@")
    return table, via or None


def join_path(
    edges: Sequence[Edge], start: str, goal: str, allowed: set[str] | None = None,
    domain_of: Mapping[str, str] | None = None,
) -> list[Edge] | None:
    """Shortest chain of edges between two tables, edges taken in either direction.

    With ``allowed``, intermediate tables must belong to one of those domains.
    """
    if start == goal:
        return []
    queue = deque([(start, [])])
    seen = {start}
    while queue:
        table, chain = queue.popleft()
        for e in edges:
            step = e if e.left == table else e.flipped() if e.right == table else None
            if step is None or step.right in seen:
                continue
            home = (domain_of or {}).get(step.right)
            if allowed is not None and home is not None and home not in allowed:
                continue
            if step.right == goal:
                return [*chain, step]
            seen.add(step.right)
            queue.append((step.right, [*chain, step]))
    return None


def reachable_domains(core: Iterable[str], depends_on: Mapping[str, Iterable[str]]) -> set[str]:
    """The core domains and all they depend on, directly or not."""
    found, todo = set(), list(core)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo.extend(depends_on.get(name, ()))
    return found


def auto_edges(
    tables: Mapping[str, DataFrame], rules: Sequence[tuple[str, str, str]]
) -> list[Edge]:
    """Edges every fact gets: for ``(fk column, dimension, key)``, each fact holding the
    column is joined to the dimension, optionally so."""
    return [
        edge(name, dim, f"{fk}={key}", optional=True)
        for name, df in tables.items() for fk, dim, key in rules
        if name.startswith("fact_") and name != dim and fk in df.columns
    ]


def join_steps(
    tables: Mapping[str, DataFrame],
    edges: Sequence[Edge],
    needed: Iterable[str] | None = None,
    path: Sequence[str] | None = None,
    allowed: set[str] | None = None,
    domain_of: Mapping[str, str] | None = None,
    allow_cross: bool = False,
) -> tuple[str, list[Edge]]:
    """The first table of a star join and the edges to follow, in order.

    A table may be needed in several roles: ``nation@customer`` is the nation found by way of
    ``customer``, a copy of its own, and so are the tables between the two. The graph searched is the one
    of (table, role), so each role has one place in the join.
    """
    named = list(needed or tables)
    roles = sorted({n for n in named if role_of(n)[1]}, key=lambda n: (n.count("@"), n))
    plain = {n for n in named if not role_of(n)[1]} | {n.split("@")[-1] for n in roles}
    names = sorted(plain, key=lambda n: (n.startswith("dim_"), n))
    included = list(path) if path else names[:1]
    base, steps = included[0], []
    both_ways = [*edges, *[e.flipped() for e in edges]]
    for a, b in zip(included, included[1:]):
        direct = [e for e in both_ways if (e.left, e.right) == (a, b)]
        if not direct:
            raise ValueError(f"no edge {a} -> {b}")
        steps.append(direct[0])
    for target in names:
        if target in included:
            continue
        chains = [c for c in (join_path(edges, t, target, allowed, domain_of)
                              for t in included) if c is not None]
        if not chains:
            if not allow_cross:
                raise ValueError(f"no join path to {target}")
            steps.append(Edge("", target, ()))
            included.append(target)
            continue
        for step in min(chains, key=len):
            if step.right not in included:
                steps.append(step)
                included.append(step.right)

    def place(name: str) -> None:
        """Join a role: first what it is reached by, then the copies from there on."""
        table, via = role_of(name)
        if name in included:
            return
        if "@" in via:
            place(via)
        chain = join_path(edges, role_of(via)[0], table, allowed, domain_of)
        if not chain:
            raise ValueError(f"no join path to {name}")
        left = via
        for step in chain:
            right = f"{step.right}@{via}"
            if right not in included:
                steps.append(Edge(left, right, step.on, step.optional, step.domain, step.name))
                included.append(right)
            left = right

    for name in roles:
        place(name)
    return base, steps


def follow(base: DataFrame, name: str, steps: Iterable[Edge], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Join the tables of ``steps`` to ``base``, each under the name it has there."""
    out = base.alias(name)
    for step in steps:
        other = tables[role_of(step.right)[0]].alias(step.right)
        if not step.on:
            out = out.crossJoin(other)
        else:
            out = out.join(other, key_condition(step.left, step.right, step.on),
                           "left" if step.optional else "inner")
    return out


def star_join(
    tables: Mapping[str, DataFrame],
    edges: Sequence[Edge],
    needed: Iterable[str] | None = None,
    path: Sequence[str] | None = None,
    allowed: set[str] | None = None,
    domain_of: Mapping[str, str] | None = None,
    allow_cross: bool = False,
) -> DataFrame:
    """Join the needed tables along the edges, facts first, tables between included.

    Columns are read from the result as ``F.col("table.column")``, or by :func:`column_of` for roles
    (see :func:`join_steps`). ``path`` is a chain of tables to join first, for hops through a table
    that more than one edge leads to; needed tables off the chain follow. All key pairs of an edge
    count, and an optional edge joins left.
    """
    base, steps = join_steps(tables, edges, needed, path, allowed, domain_of, allow_cross)
    return follow(tables[base], base, steps, tables)


def enrich(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], columns: Sequence[str],
) -> DataFrame:
    """Left join of chosen lookup columns. Keys are names or ``"a=b"`` pairs."""
    pairs = [(k.split("=")[0].strip(), k.split("=")[-1].strip()) for k in keys]
    right = lookup.select(
        *[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)], *columns
    )
    cond = reduce(lambda x, y: x & y,
                  [df[a] == right[f"__k{i}"] for i, (a, _) in enumerate(pairs)])
    return df.join(right, cond, "left").drop(*[f"__k{i}" for i in range(len(pairs))])


def aggregate_enrich(
    dim: DataFrame, fact: DataFrame, on: tuple[str, str],
    columns: Mapping[str, str | Column], where: str | Column | None = None,
    derived: Mapping[str, str] | None = None,
) -> DataFrame:
    """Aggregates of a fact per key, left-joined to the dimension, then derived columns.

    ``on`` is (fact key, dimension key). The fact is aggregated before the join, so only
    one row per key is shuffled to it.
    """
    fact_key, dim_key = on
    src = fact.filter(where) if where is not None else fact
    aggs = [(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in columns.items()]
    per_key = src.groupBy(F.col(fact_key).alias("__key")).agg(*aggs)
    out = dim.join(per_key, dim[dim_key] == per_key["__key"], "left").drop("__key")
    for name, expr in (derived or {}).items():
        out = out.withColumn(name, F.expr(expr))
    return out


def latest_enrich(
    dim: DataFrame, fact: DataFrame, on: tuple[str, str],
    values: Mapping[str, str], order_by: Sequence[str],
    derived: Mapping[str, str] | None = None,
) -> DataFrame:
    """Last value per key by an order, joined to the dimension (``{name: value expr}``)."""
    rank = F.struct(*[F.col(c) for c in order_by])
    return aggregate_enrich(
        dim, fact, on,
        {n: F.max_by(F.expr(v), rank) for n, v in values.items()},
        derived=derived,
    )


def repair_key(
    fact: DataFrame, dim: DataFrame, natural: tuple[str, str], key: str, dim_key: str,
) -> DataFrame:
    """Replace ``key`` of the fact by the dimension's key found over the natural key."""
    fact_nat, dim_nat = natural
    found = dim.select(F.col(dim_nat).alias("__nat"), F.col(dim_key).alias("__found"))
    joined = fact.drop(key).join(found, F.col(fact_nat) == F.col("__nat"), "left")
    return joined.withColumnRenamed("__found", key).drop("__nat")


def match_rate(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows with the key set, their share."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(key).alias("matched_rows"),
    ).withColumn("match_rate", F.try_divide(F.col("matched_rows").cast("double"),
                                            F.nullif(F.col("total_rows"), F.lit(0))))


def fan_out(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """One row telling whether the join multiplies rows, without doing the join.

    Both sides are counted per key first, so a hot key is one row of the join of counts.
    """
    a, b = on
    lhs = left.groupBy(F.col(a).alias("k")).agg(F.count(F.lit(1)).alias("n_left"))
    rhs = right.groupBy(F.col(b).alias("k")).agg(F.count(F.lit(1)).alias("n_right"))
    return lhs.join(rhs, "k", "left").agg(
        F.sum("n_left").alias("rows_before"),
        F.sum(F.coalesce(F.col("n_left") * F.col("n_right"), F.lit(0))).alias("rows_after"),
        F.coalesce(F.max("n_right"), F.lit(0)).alias("max_matches"),
    ).withColumn("explodes", F.col("rows_after") > F.col("rows_before"))


def parent_keys(df: DataFrame, key: str, code: str, is_parent: str | Column,
                parent_alias: str = "parent_key") -> DataFrame:
    """Self reference: each row gets the key of the parent row sharing its code."""
    parents = df.filter(is_parent).select(
        F.col(code).alias("__code"), F.col(key).alias("__parent"))
    joined = df.join(parents, F.col(code) == F.col("__code"), "left")
    test = F.expr(is_parent) if isinstance(is_parent, str) else is_parent
    return joined.withColumn(
        parent_alias, F.when(~test, F.col("__parent"))
    ).drop("__code", "__parent")
