"""Table writes: plain, append-immutable, upsert, merge, delete, clustering.

A table is a directory of Parquet files, replaced as a whole by staging the new version
beside it and renaming. Appends and partition overwrites go through Spark's committer.

NULL is a key like any other in all of them: appends, upserts and merges compare keys NULL-safe.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.operators.setops import keep_one
from starwright.session import durable
from starwright.sources.tables import path_exists, scan

FORMAT = "parquet"
CLUSTER_ROWS, CLUSTER_BYTES = 2_000_000, 64 << 20  # most in a clustered file, which one task sorts


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a committed version is there; finishes an interrupted swap first."""
    if not path_exists(spark, path):
        old = f"{path.rstrip('/')}__old"
        if path_exists(spark, old):
            _rename(spark, old, path)
    _finish_swap(spark, path.rstrip("/"))
    return path_exists(spark, path)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The committed version of a table, after an interrupted swap has been finished."""
    table_exists(spark, path)
    return scan(spark, path)


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, src = _fs(spark, source)
    if not fs.rename(src, _fs(spark, target)[1]):
        raise OSError(f"could not rename {source} to {target}")


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def present_partitions(df: DataFrame, partitions: Sequence[str] | None) -> list[str]:
    """Those partition columns the frame has."""
    return [c for c in (partitions or []) if c in df.columns]


def spread_for_write(df: DataFrame, partitions: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Shuffle by the partition columns, so that each directory gets few files.

    Left to AQE's REBALANCE, which also splits a partition value that holds many rows over
    several tasks; a plain hash repartition would give it to one. With a number of ``tasks`` the rows
    are dealt by ranges of the partition columns and a hash of the row, so a value that holds
    many rows spans as many tasks as its share of them.
    """
    if not partitions:
        return df
    if tasks:
        return df.repartitionByRange(tasks, *partitions, row_hash(df))
    return df.hint("rebalance", *[F.col(c) for c in partitions])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields
                        if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.VariantType))])


def landed(df: DataFrame, partitions: Sequence[str] | None) -> DataFrame:
    """Rows as they will be read back: an empty text in a partition column is stored as NULL."""
    empty = [c for c in present_partitions(df, partitions) if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in empty}) if empty else df


def same_key(left: Mapping[str, str] | Sequence[str], a: str = "", b: str = "") -> Column:
    """NULL-safe equality of all key columns, ``{left: right}`` or one name for both, under two aliases."""
    pairs = left.items() if isinstance(left, Mapping) else [(k, k) for k in left]
    name = lambda side, k: F.col(f"{side}.`{k}`" if side else f"`{k}`")
    return reduce(lambda x, y: x & y, [name(a, x).eqNullSafe(name(b, y)) for x, y in pairs])


def write(
    df: DataFrame, path: str, mode: str = "overwrite", partitions: Sequence[str] | None = None,
    fmt: str = FORMAT, spread: bool = True,
) -> str:
    """Overwrite, append, ignore or error-if-exists, partitioned by columns that exist."""
    keys = present_partitions(df, partitions)
    out = spread_for_write(df, keys) if spread else df
    writer = out.write.format(fmt).mode(mode)
    if keys:
        writer = writer.partitionBy(*keys)
    if mode == "overwrite":
        _remove(df.sparkSession, f"{path.rstrip('/')}__swap")  # an unfinished rewrite of what goes now
        writer = writer.option("partitionOverwriteMode", "static")
    writer.save(path)
    return path


def write_if_missing(df: DataFrame, path: str, partitions: Sequence[str] | None = None) -> bool:
    """Write only where there is no table yet; tells whether it wrote."""
    if table_exists(df.sparkSession, path):
        return False
    write(df, path, "ignore", partitions)
    return True


def replace(
    df: DataFrame, path: str, partitions: Sequence[str] | None = None, spread: bool = True,
) -> str:
    """New version of a table that may be computed from the old one.

    Written beside, then renamed into place. If the job dies between the two renames the
    old version is put back by the next :func:`table_exists`.
    """
    spark = df.sparkSession
    base = path.rstrip("/")
    staged = f"{base}__new_{uuid.uuid4().hex}"
    write(df, staged, "overwrite", partitions, spread=spread)
    old = f"{base}__old"
    if table_exists(spark, base):
        if path_exists(spark, old):
            _remove(spark, old)
        _rename(spark, base, old)
    _rename(spark, staged, base)
    if path_exists(spark, old):
        _remove(spark, old)
    return path


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> str:
    """New versions of those partitions that ``df`` has rows of; the others stay.

    Written beside as a whole and committed by one rename to ``__swap``. From there every
    partition is moved into its place; if the job dies on the way, the rest is moved by the next
    :func:`table_exists`. A crash before the rename leaves the table as it was.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    staged = f"{base}__new_{uuid.uuid4().hex}"
    write(df, staged, "overwrite", partitions)
    _rename(spark, staged, f"{base}__swap")
    _finish_swap(spark, base)
    return path


def _finish_swap(spark: SparkSession, base: str) -> None:
    """Move what a committed partition rewrite still holds into the table; may be repeated."""
    fs, swap = _fs(spark, f"{base}__swap")
    if not fs.exists(swap):
        return

    def place(source, target) -> None:
        entries = list(fs.listStatus(source))
        if any(e.isFile() and e.getPath().getName()[0] not in "_." for e in entries):
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"could not rename {source} to {target}")
            return
        for entry in entries:
            if entry.isDirectory():
                place(entry.getPath(), spark._jvm.org.apache.hadoop.fs.Path(target, entry.getPath().getName()))

    place(swap, _fs(spark, base)[1])
    fs.delete(swap, True)


def resolve_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Key names as the frame spells them; unknown keys are an error."""
    by_lower = {c.lower(): c for c in df.columns}
    missing = [k for k in keys if k.lower() not in by_lower]
    if missing:
        raise ValueError(f"key columns not found: {missing}")
    return [k if k in df.columns else by_lower[k.lower()] for k in keys]


def narrowed(col: Column, source: T.DataType, target: T.DataType) -> Column:
    """Safe cast; NaN becomes NULL on the way to an integer."""
    if isinstance(source, T.FractionalType) and isinstance(target, T.IntegralType) \
            and not isinstance(source, T.DecimalType):
        col = F.when(~F.isnan(col), col)
    return col.try_cast(target)


def aligned(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Columns the stored table also has, cast to its types."""
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    casts = {f.name: narrowed(F.col(f.name), f.dataType, kinds[f.name])
             for f in df.schema.fields if f.name in kinds and kinds[f.name] != f.dataType}
    return df.withColumns(casts) if casts else df


def stored_like(df: DataFrame, path: str, partitions: Sequence[str] | None) -> DataFrame:
    """The stored table for a batch: partition values read as the batch has them.

    What Spark infers from folder names alone turns ``01`` into 1, and a column of NULLs into no type.
    """
    spark = df.sparkSession
    stored = scan(spark, path)
    kinds = {c: df.schema[c].dataType for c in present_partitions(stored, partitions) if c in df.columns}
    kinds = {c: k for c, k in kinds.items() if k != stored.schema[c].dataType and (
        isinstance(k, T.StringType) or isinstance(stored.schema[c].dataType, T.NullType))}
    if not kinds:
        return stored
    return spark.read.schema(T.StructType([
        T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in stored.schema.fields])).parquet(path)


def append_immutable(
    df: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str] | None = None,
    date_column: str | None = None, order: Sequence[str] = (), year_column: str | None = None,
) -> str:
    """Append rows whose key is not stored yet; stored rows never change.

    Keys are compared NULL-safe, so a NULL key is stored once as well. Where the date is one
    of the keys, the stored side of the anti join is cut to the batch's date range and
    to rows without a date, which skips row groups: only the bounds of the batch come to
    the driver. ``year_column`` names a partition column that holds the year of the date, so that
    partitions are skipped too. A date outside the key says nothing about where a
    key may be stored; then all stored keys are compared.
    """
    spark = df.sparkSession
    keys = resolve_keys(df, keys)
    batch = keep_one(landed(df, partitions), keys, order)
    if not table_exists(spark, path):
        return write(batch, path, "overwrite", partitions)
    stored = stored_like(df, path, partitions)
    batch = durable(aligned(batch, stored))  # the bounds and the rows are of one run of the source
    held = stored
    if date_column and date_column in keys:
        low, high = batch.agg(F.min(date_column), F.max(date_column)).first()
        undated = F.col(date_column).isNull()
        dated = F.lit(False) if low is None else F.col(date_column).between(F.lit(low), F.lit(high))
        if year_column and low is not None:
            dated = dated & F.col(year_column).between(low.year, high.year)
        held = held.filter(dated | undated)
    names = {k: f"__held_{i}" for i, k in enumerate(keys)}
    same = same_key(names)
    known = held.select(*[F.col(k).alias(n) for k, n in names.items()])
    return write(batch.join(known, same, "left_anti"), path, "append", partitions)


def merged(
    stored: DataFrame, df: DataFrame, keys: Sequence[str], update_existing: bool = True,
    order: Sequence[str] = (),
) -> DataFrame:
    """Stored rows with the batch merged in, one row per key; the winning row counts whole.

    Both sides are united and reduced to one row per key in one shuffle, so keys the stored
    table held twice come out once. With ``order`` the last row of either side wins, and a late
    row does not replace a newer stored one; equal or no order leaves it to the batch.
    ``update_existing=False`` puts the stored side first.
    """
    latest = bool(order)
    preferred = 1 if latest else 0
    batch_side = preferred if update_existing else 1 - preferred
    both = stored.withColumn("__side", F.lit(1 - batch_side)).unionByName(
        aligned(df, stored).withColumn("__side", F.lit(batch_side)), allowMissingColumns=True)
    lead = [*order, "__side"] if update_existing else ["__side", *order]
    return keep_one(both, resolve_keys(both, keys), lead, latest).drop("__side")


def upsert(
    df: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str] | None = None,
    update_existing: bool = True, order: Sequence[str] = (),
) -> str:
    """Insert or update by key. ``update_existing=False`` keeps stored rows.

    Where the partition columns belong to the key, a row cannot change its partition, so only
    the partitions the batch touches are rewritten, the one of NULL among them; otherwise the
    table is replaced.
    """
    spark = df.sparkSession
    keys = resolve_keys(df, keys)
    df = landed(df, partitions)
    if not table_exists(spark, path):
        return write(keep_one(df, keys, order, latest=bool(order)), path, "overwrite", partitions)
    stored = stored_like(df, path, partitions)
    parts = present_partitions(stored, partitions)
    if parts and set(parts) <= set(keys) and set(df.columns) <= set(stored.columns):
        names = {c: f"__touched_{i}" for i, c in enumerate(parts)}
        touched = aligned(df, stored).select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
        out = merged(stored.join(touched, same_key(names), "left_semi"), df, keys, update_existing, order)
        return replace_partitions(out, path, parts)
    return replace(merged(stored, df, keys, update_existing, order), path, partitions)


def smart_write(
    df: DataFrame, path: str, strategy: str = "upsert", keys: Sequence[str] = (),
    partitions: Sequence[str] | None = None, date_column: str | None = None,
) -> str:
    """Append-immutable for ``append`` with a date column, else upsert."""
    if strategy == "append" and date_column:
        return append_immutable(df, path, keys, partitions, date_column)
    return upsert(df, path, keys, partitions)


def write_evolving(
    df: DataFrame, path: str, mode: str = "append", partitions: Sequence[str] | None = None,
) -> str:
    """Append with new columns allowed; an overwrite may change types as well.

    Appended columns are cast to the stored types; what only the files of one side have
    reads as NULL on the other with ``scan(…, merge_schema=True)``.
    """
    spark = df.sparkSession
    if mode == "append" and table_exists(spark, path):
        return write(aligned(df, scan(spark, path, merge_schema=True)), path, "append", partitions)
    return replace(df, path, partitions)


def merge(
    source: DataFrame, path: str, on: Sequence[str], update: Mapping[str, str] | None = None,
    insert: Mapping[str, str] | None = None, partitions: Sequence[str] | None = None,
) -> str:
    """Conditional merge: matched rows take ``update`` (column → SQL over ``t.`` and ``s.``),
    unmatched source rows are inserted by ``insert``. None stands for all source columns.

    A NULL key matches a NULL key, so merging the same rows again inserts nothing."""
    spark = source.sparkSession
    stored = open_table(spark, path)
    keyed = keep_one(source, on)
    t = stored.withColumn("__t", F.lit(True)).alias("t")
    s = keyed.withColumn("__s", F.lit(True)).alias("s")
    both = t.join(s, same_key(on, "t", "s"), "full")
    shared = {c: f"s.{c}" for c in stored.columns if c in source.columns}
    changes = shared if update is None else update
    inserts = shared if insert is None else insert
    matched = F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull()
    only_new = F.col("t.__t").isNull()
    out = []
    for f in stored.schema.fields:
        value = F.col(f"t.{f.name}")
        if f.name in changes:
            value = F.when(matched, F.expr(changes[f.name])).otherwise(value)
        new = F.expr(inserts[f.name]) if f.name in inserts else F.lit(None)
        out.append(F.when(only_new, new).otherwise(value).cast(f.dataType).alias(f.name))
    kept = both if inserts else both.filter(~only_new)
    return replace(kept.select(*out), path, partitions)


def merge_delete(
    source: DataFrame, path: str, on: Sequence[str], partitions: Sequence[str] | None = None,
) -> str:
    """Delete the stored rows a source row matches; a NULL key matches a NULL key."""
    stored = open_table(source.sparkSession, path)
    gone = source.select(*on).distinct()
    return replace(stored.alias("t").join(gone.alias("s"), same_key(on, "t", "s"), "left_anti"),
                   path, partitions)


def delete_where(
    spark: SparkSession, path: str, condition: str | Column, dry_run: bool = False,
    partitions: Sequence[str] | None = None,
) -> int:
    """Delete matching rows; returns their number. A dry run only counts."""
    stored = open_table(spark, path)
    n = stored.filter(condition).count()
    if n and not dry_run:
        test = F.expr(condition) if isinstance(condition, str) else condition
        # rows where the condition is NULL stay
        replace(stored.filter(~F.coalesce(test, F.lit(False))), path, partitions)
    return n


def z_order(ranks: Sequence[Column], bits: int) -> Column:
    """Interleaved bits of several ranks, the highest bits first (the Morton code)."""
    parts = []
    for bit in range(bits):
        for i, rank in enumerate(ranks):
            place = bit * len(ranks) + (len(ranks) - 1 - i)
            parts.append(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), place))
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def range_ranks(df: DataFrame, columns: Sequence[str], bits: int) -> dict[str, Column]:
    """Per column its place among ``2 ** bits`` ranges of about equally many rows, NULL first.

    The bounds come from Spark's approximate quantiles (numbers, dates) or, for text, from the
    quantiles of the first seven bytes read as a number; only the bounds reach the driver.
    """
    def number(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            return c.cast("double")
        if isinstance(kind, T.BooleanType):
            return c.cast("int").cast("double")
        if isinstance(kind, T.DateType):
            return F.unix_date(c).cast("double")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(c.cast("timestamp")).cast("double")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
            return F.conv(head, 16, 10).cast("double")
        raise ValueError(f"{name}: cannot cluster by {kind.simpleString()}")

    count = 1 << bits
    probs = F.array(*[F.lit(i / count) for i in range(1, count)])
    numbers = {name: number(name) for name in columns}
    found = df.agg(*[F.approx_percentile(x, probs, F.lit(count * 100)).alias(n) for n, x in numbers.items()]).first()

    def rank(name: str) -> Column:
        x, bounds = numbers[name], sorted(set(found[name] or []))
        below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x)) if bounds else F.lit(0)
        return F.when(x.isNull(), F.lit(0)).otherwise(below).cast("int")

    return {name: rank(name) for name in columns}


def clustered_files(spark: SparkSession, path: str, rows: int, files: int) -> int:
    """``files``, or the multiple of it that keeps each file within CLUSTER_ROWS and CLUSTER_BYTES."""
    fs, folder = _fs(spark, path)
    stored = fs.getContentSummary(folder).getLength()
    return files * max(1, -(-rows // (files * CLUSTER_ROWS)), -(-stored // (files * CLUSTER_BYTES)))


def cluster(
    spark: SparkSession, path: str, columns: Sequence[str], files: int,
    partitions: Sequence[str] | None = None, zorder: bool = False, bits: int = 7,
) -> str:
    """Compact a table into ``files`` range-clustered files, sorted inside, so that min/max
    statistics skip row groups. Long runs of one value are spread by the row hash.

    With ``zorder`` the rows follow the interleaved bits of the columns' range ranks, so a filter on any
    one of them skips files; sorted by columns in turn, only the first would. NULLs lie with the
    smallest values. ``bits`` per column bound how fine the ranges are.

    A file is sorted by one task, so a table too large for ``files`` of bounded size gets a
    multiple of them: each file is then cut into equally many narrower ranges.
    """
    stored = open_table(spark, path)
    files = clustered_files(spark, path, stored.count(), files)  # counted from the footers
    salt = row_hash(stored)
    if not zorder:
        laid = stored.repartitionByRange(files, *columns, salt).sortWithinPartitions(*columns)
        return replace(laid, path, partitions, spread=False)
    code = z_order(list(range_ranks(stored, columns, bits).values()), bits)
    laid = stored.withColumn("__z", code).repartitionByRange(files, "__z", salt).sortWithinPartitions("__z", *columns)
    return replace(laid.drop("__z"), path, partitions, spread=False)


def write_star(
    tables: Mapping[str, DataFrame], root: str, partitions: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Dimensions under ``dims/``, facts under ``facts/``, dimensions first."""
    paths = {}
    for name in sorted(tables, key=lambda n: (n.startswith("fact_"), n)):
        folder = "facts" if name.startswith("fact_") else "dims"
        paths[name] = replace(tables[name], f"{root.rstrip('/')}/{folder}/{name}",
                              (partitions or {}).get(name))
    return paths
