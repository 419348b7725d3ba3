"""CSV downloads: all text, quoted newlines, headers turned into snake case."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.operators.projection import typed
from starwright.operators.setops import union


def snake_case(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


def header_groups(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """The files below ``paths``, grouped by their first line; only these lines reach the driver."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)
    groups: dict[str, list[str]] = {}

    def visit(fs, status) -> None:
        place = status.getPath()
        if place.getName()[0] in "_.":
            return
        if status.isDirectory():
            for inner in fs.listStatus(place):
                visit(fs, inner)
            return
        stream, codec = fs.open(place), codecs.getCodec(place)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line is not None:
            groups.setdefault(line, []).append(place.toString())

    for path in paths:
        place = hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        for status in fs.globStatus(place) or []:
            visit(fs, status)
    return list(groups.values())


def read_csv(
    spark: SparkSession, path: str | Sequence[str],
    fields: Sequence[Mapping[str, str]] | None = None,
    year_from: str | None = None, quoted_newlines: bool = True,
) -> DataFrame:
    """CSV with a header to the declared ``{name, type, source?}`` fields.

    Columns the file lacks are NULL. Files of one list or folder may have different headers: files with the same
    one are read together, and the groups are united by column name. A file with quoted newlines cannot
    be split, so one task reads it whole; turn ``quoted_newlines`` off for very large files without them.
    """
    def read(place: str | list[str]) -> DataFrame:
        raw = spark.read.csv(place, header=True, inferSchema=False, multiLine=quoted_newlines, quote='"', escape='"')
        return raw.toDF(*[snake_case(c) for c in raw.columns])

    places = [path] if isinstance(path, str) else list(path)
    groups = header_groups(spark, places)
    raw = union([read(files) for files in groups]) if len(groups) > 1 else read(places)
    if not fields:
        return raw
    picked = raw.select(*[
        (F.col(f.get("source", f["name"])) if f.get("source", f["name"]) in raw.columns
         else F.lit(None).cast("string")).alias(f["name"]) for f in fields
    ])
    return typed(picked, [(f["name"], f["type"]) for f in fields], year_from)
