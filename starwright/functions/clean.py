"""Column builders that clean, parse and key raw text columns.

All of them use ``try_*`` casts, so they behave the same with ANSI mode on or
off: a value that cannot be parsed becomes NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value" in raw feeds.
NULL_TOKENS = ("", "N/A", "-")
NULL_DATES = ("", "None", "0000-00-00")



def as_column(value: Column | str) -> Column:
    """A Column as is, a string as a column name."""
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(col: Column | str, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Trimmed text, with the given tokens turned into NULL."""
    text = F.trim(as_column(col))
    return F.when(~text.isin(*tokens), text)


def to_number(col: Column | str, type_name: str = "double") -> Column:
    """Safe numeric coercion: bad text becomes NULL, integer targets stay double.

    Feeds mix ``"12"`` and ``"NaN"`` in one column, so whole numbers are kept as
    doubles here and narrowed by :func:`to_integer` when the schema asks.
    """
    target = "double" if type_name in ("int", "integer", "long", "bigint", "float") else type_name
    return as_column(col).try_cast(target)


def to_integer(col: Column | str, type_name: str = "int") -> Column:
    """Integer by way of double: ``"12.0"`` gives 12, NaN and bad text give NULL."""
    return as_column(col).try_cast("double").try_cast(type_name)


def to_date(col: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Date of one format; placeholder dates become NULL."""
    text = as_column(col)
    return F.when(
        ~F.trim(text).isin(*NULL_DATES), F.try_to_timestamp(text, F.lit(fmt))
    ).cast("date")


def to_timestamp(col: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp of one format; placeholder dates become NULL."""
    text = as_column(col)
    return F.when(~F.trim(text).isin(*NULL_DATES), F.try_to_timestamp(text, F.lit(fmt)))


def first_readable(*tries: tuple[Column, str]) -> Column:
    """The timestamp of the first (text, format) that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for text, fmt in tries])


def to_date_any(col: Column | str) -> Column:
    """Date from ISO (with or without time), M/D/YYYY, ``Month DD YYYY`` or a year."""
    text = F.trim(as_column(col))
    return first_readable(
        (F.substring_index(text, "T", 1), "yyyy-MM-dd"), (text, "M/d/yyyy"),
        (F.initcap(text), "MMMM d yyyy"), (text, "yyyy")).cast("date")


def to_timestamp_any(col: Column | str) -> Column:
    """Timestamp from ISO, M/D/YYYY, a bare date or a bare year."""
    text = F.trim(as_column(col))
    return first_readable(
        (F.translate(F.substring(text, 1, 19), "T", " "), "yyyy-MM-dd HH:mm:ss"),
        (text, "yyyy-MM-dd"), (text, "M/d/yyyy"), (text, "yyyy"))


def year_or_date(year: Column | str | None, date: Column | str) -> Column:
    """The year column where set, else the year of the date."""
    from_date = F.year(as_column(date))
    return from_date if year is None else F.coalesce(as_column(year), from_date)


def surrogate_key(*cols: Column | str, bits: int = 64, separator: str = "_") -> Column:
    """Non-negative integer key of the natural key.

    64 bits by default: with 32 bits two of 100,000 keys already collide. Every part is hashed with its length
    before it, so ``("a_b", "c")`` and ``("a", "b_c")`` differ, and a NULL part differs from any text. The
    32-bit form is kept for tables keyed that way; its one overflow value
    (the smallest int) is mapped to NULL instead of failing.
    """
    parts = [as_column(c).cast("string") for c in cols]
    given = F.coalesce(*parts).isNotNull()
    # a NULL part has its own mark, so that (a, NULL, b) and (a, b, NULL) differ
    text = F.when(given, F.concat_ws(separator, *[F.coalesce(p, F.lit("\u0000")) for p in parts]))
    if bits == 64:
        if len(parts) > 1:
            text = F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
        return F.when(given, F.pmod(F.xxhash64(text), F.lit(2**63 - 1)))
    if bits == 32:
        code = F.hash(text)
        return F.when(given & (code > F.lit(-(2**31))), F.abs(code))
    raise ValueError("bits must be 32 or 64")


def date_key(col: Column | str) -> Column:
    """Integer yyyyMMdd key of a date or timestamp, by arithmetic: cheaper than formatting,
    and free of time zones."""
    day = as_column(col)
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def date_key_of_text(col: Column | str) -> Column:
    """Integer yyyyMMdd key of an ISO date text."""
    return F.regexp_replace(as_column(col), "-", "").try_cast("int")


def date_of_key(col: Column | str) -> Column:
    """The date of an integer yyyyMMdd key."""
    return F.try_to_timestamp(as_column(col).cast("string"), F.lit("yyyyMMdd")).cast("date")


def year_of_key(col: Column | str) -> Column:
    """The year of an integer yyyyMMdd key."""
    return F.floor(as_column(col) / 10000).cast("int")


def padded_id(col: Column | str, width: int = 14) -> Column:
    """Identifier as zero-padded text."""
    return F.lpad(as_column(col).cast("string"), width, "0")


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when the denominator is 0 or NULL."""
    return F.try_divide(as_column(num).cast("double"), F.nullif(as_column(den), F.lit(0)))


def geometry_text(col: Column | str) -> Column:
    """Nested geometry kept as JSON text."""
    return F.to_json(as_column(col))


def category(rules: Sequence[tuple[str | Column, object]], default: object = None) -> Column:
    """First matching rule wins: ``[(condition, value), …]``, conditions as SQL or Column."""
    chain = None
    for cond, value in rules:
        test = F.expr(cond) if isinstance(cond, str) else cond
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(default)


def band(col: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label by ascending edges: below the first edge, …, from the last edge on."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    value = as_column(col)
    rules = [(value < edge, label) for edge, label in zip(edges, labels)]
    return F.when(value.isNull(), None).otherwise(category(rules, labels[-1]))


def epoch_date(col: Column | str, unit: str = "s") -> Column:
    """UTC date of epoch seconds (``s``) or milliseconds (``ms``)."""
    seconds = as_column(col) if unit == "s" else as_column(col) / 1000
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def first_existing(columns: Sequence[str], candidates: Iterable[str]) -> Column:
    """The first candidate the table has, else NULL."""
    for name in candidates:
        if name in columns:
            return F.col(name)
    return F.lit(None)


def coalesce_existing(columns: Sequence[str], candidates: Iterable[str]) -> Column:
    """coalesce over those candidates the table has, else NULL."""
    present = [F.col(c) for c in candidates if c in columns]
    return F.coalesce(*present) if present else F.lit(None)


# Display format codes -> (prefix, scale, decimals, suffix).
DISPLAY_FORMATS = {
    "$": ("$", 1.0, 0, ""),
    "$2": ("$", 1.0, 2, ""),
    "$K": ("$", 1e-3, 1, "K"),
    "$M": ("$", 1e-6, 1, "M"),
    "$B": ("$", 1e-9, 2, "B"),
    "%": ("", 100.0, 2, "%"),
    "%0": ("", 100.0, 0, "%"),
    "number": ("", 1.0, 0, ""),
    "decimal": ("", 1.0, 4, ""),
    "decimal2": ("", 1.0, 2, ""),
}


def display(col: Column | str, code: str) -> Column:
    """Number as display text by a format code; ``decimal`` codes take no separators."""
    prefix, scale, decimals, suffix = DISPLAY_FORMATS[code]
    text = F.format_number(as_column(col) * F.lit(scale), decimals)
    if code.startswith("decimal"):
        text = F.regexp_replace(text, ",", "")
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def display_code(
    key: str, column_code: str | None, overrides: dict[str, str | dict] | None = None
) -> str | None:
    """Effective code of a column: the override (text or ``{format: …}``), else its own."""
    override = (overrides or {}).get(key)
    if isinstance(override, dict):
        override = override.get("format")
    return override or column_code
