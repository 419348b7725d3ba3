"""Projection and conforming of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.functions import clean

# Type names a column declaration may use; others read as text.
TYPE_NAMES = {
    "string": "string", "varchar": "string", "int": "int", "integer": "int",
    "long": "bigint", "bigint": "bigint", "double": "double", "float": "double",
    "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp",
}


def spark_type(name: str) -> T.DataType:
    """Spark type of a declared type name; ``decimal(p,s)`` is honoured."""
    text = name.strip().lower()
    if text.startswith("decimal"):
        return T.DataType.fromDDL(text)
    return T.DataType.fromDDL(TYPE_NAMES.get(text, "string"))


def struct_of(columns: Sequence[Sequence], keep_nullability: bool = True) -> T.StructType:
    """StructType of ``[name, type, nullable, description, {options}]`` definitions."""
    fields = []
    for name, type_name, *rest in columns:
        options = dict(rest[2]) if len(rest) > 2 and rest[2] else {}
        nullable = bool(rest[0]) if rest and keep_nullability else True
        meta = {k: v for k, v in options.items() if v is not None}
        if len(rest) > 1 and rest[1]:
            meta["comment"] = rest[1]
        fields.append(
            T.StructField(name, spark_type(type_name), nullable or "derived" in options, meta)
        )
    return T.StructType(fields)


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; names the table lacks are ignored."""
    return df.drop(*columns)


def derive(df: DataFrame, expressions: Mapping[str, str | Column]) -> DataFrame:
    """Add columns one after the other, so that later ones may use earlier ones."""
    for name, expr in expressions.items():
        df = df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)
    return df


def select_map(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """``{target: expression}`` as one projection: every expression sees the input only."""
    return df.select(*[
        (F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in mapping.items()
    ])


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename those columns the table has."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Safe numeric coercion of the named columns that exist."""
    present = {c: clean.to_number(c, t) for c, t in types.items() if c in df.columns}
    return df.withColumns(present) if present else df


def computed(
    df: DataFrame, name: str, expr: str, type_name: str = "double", default: object = None
) -> DataFrame:
    """Computed column; where the table cannot support it, a typed default instead."""
    if name in df.columns:
        return df
    try:
        return df.withColumn(name, F.expr(expr))
    except AnalysisException:
        return df.withColumn(name, F.lit(default).cast(spark_type(type_name)))


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant columns, e.g. discriminators of a source."""
    return df.withColumns({
        k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()
    })


def with_load_metadata(
    df: DataFrame, literals: Mapping[str, object] | None = None, snapshot: bool = True
) -> DataFrame:
    """Ingestion time, snapshot date and literal columns."""
    stamped = {"ingestion_timestamp": F.current_timestamp()}
    if snapshot:
        stamped["snapshot_date"] = F.current_date()
    stamped.update({k: F.lit(v) for k, v in (literals or {}).items()})
    return df.withColumns(stamped)


def conform(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly these columns in this order and type; missing ones become typed NULL."""
    return df.select(*[
        (F.col(name).try_cast(spark_type(t)) if name in df.columns
         else F.lit(None).cast(spark_type(t))).alias(name)
        for name, t in columns
    ])


def parsed(col: Column, type_name: str) -> Column:
    """A text column read as the declared type, unparsable values NULL."""
    kind = TYPE_NAMES.get(type_name.lower(), type_name.lower())
    if kind == "string":
        return col
    if kind in ("int", "bigint"):
        return clean.to_integer(col, kind)
    if kind == "date":
        return clean.to_date_any(col)
    if kind == "timestamp":
        return clean.to_timestamp_any(col)
    return col.try_cast(spark_type(kind))


def typed(df: DataFrame, fields: Sequence[tuple[str, str]], year_from: str | None = None) -> DataFrame:
    """Text columns read by declared type; optional ``year`` kept or taken from a date."""
    out = df.withColumns({n: parsed(F.col(n), t) for n, t in fields if n in df.columns})
    if year_from and year_from in out.columns:
        year = "year" if "year" in out.columns else None
        out = out.withColumn("year", clean.year_or_date(year, year_from))
    return out


def normalize(
    df: DataFrame,
    fields: Sequence[Mapping[str, object]],
    literals: Mapping[str, object] | None = None,
    stamp: bool = False,
) -> DataFrame:
    """Raw records to a declared schema.

    Each field is ``{name, type, source?, expr?, default?}``: blanks to NULL, rename from
    ``source``, parse by type, then computed fields, then the declared columns in order.
    """
    stored = [f for f in fields if not f.get("expr")]
    out = df.select(*[
        (parsed(clean.blank_to_null(F.col(f"`{f.get('source', f['name'])}`")), f["type"])
         if df.schema[f.get("source", f["name"])].dataType == T.StringType()
         else F.col(f"`{f.get('source', f['name'])}`")).alias(f["name"])
        for f in stored if f.get("source", f["name"]) in df.columns
    ])
    for f in fields:
        if f.get("expr"):
            out = computed(out, f["name"], f["expr"], f["type"], f.get("default"))
    out = conform(out, [(f["name"], f["type"]) for f in fields])
    if literals:
        out = with_constants(out, literals)
    return with_load_metadata(out) if stamp else out
