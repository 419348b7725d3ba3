"""WARC revisits resolved by an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm.common import stage
from starwright.llm.registry import query, table
from starwright.operators.ordered import GlobalOrder

# fixed values: fields that a 304 answer may replace in the stored response (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, no slash at the end."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def opaque(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The stored response each not-modified revisit stands for, and the headers it then has.

    ``records``: ``record_id long, url string, captured_at timestamp, kind string`` (``response``
    or ``revisit``), ``headers map<string,string>`` with names in lower case. Other columns are
    ignored. Returns one row per revisit: ``record_id, canonical_url, captured_at, response_id,
    outcome, headers``.

    A revisit is matched with the response of the same canonical URL captured last before it
    (of equal times the largest record_id). Outcomes: ``resolved``; ``mismatch`` (the revisit
    names an entity tag, or without one a modification date, that the response does not have);
    ``unvalidated`` (it names neither, or the response lacks it); ``missing`` (no earlier
    response). Only a resolved one gets the response's headers, with the permitted ones replaced by its
    own; else it keeps its own. NULL url or time is ``missing``; NULL headers are empty; repeated
    revisits are resolved each; repeated responses (same id) count once; an empty table gives no rows.

    The as-of join is a running maximum over one global order of URL, time and kind, so a URL that
    holds a third of all records is spread over many range partitions, each carrying one row on.
    Only keys and validators are sorted; headers join in afterwards by record id.
    """
    own = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    base = records.select("record_id", canonical_url(F.col("url")).alias("key"), "captured_at", "kind",
                          own.alias("headers"))
    usable = F.col("key").isNotNull() & F.col("captured_at").isNotNull()
    full = (F.col("kind") == "response") & usable
    keys = base.where(full | (F.col("kind") == "revisit")).select(
        "record_id", "key", "captured_at", F.col("kind").eqNullSafe("response").alias("full"),
        F.when(full, F.struct("key", "captured_at", "record_id")).alias("stored"))
    # of records at one time the revisits come first: a response is not earlier than itself
    order = GlobalOrder(keys, ["key", "captured_at", "full", "record_id"])
    order.add({"last": ("max", "stored")})
    found = order.rows.where("NOT full").select(
        F.col("record_id").alias("rid"), F.col("key").alias("rkey"), F.col("captured_at").alias("at"),
        F.when(F.col("last.key") == F.col("key"), F.col("last.record_id")).alias("response_id"))
    revisits = base.where("kind = 'revisit'").select("record_id", "key", "captured_at", "headers")
    # a revisit given twice is found twice with the same answer
    answer = found.groupBy("rid").agg(F.max("response_id").alias("response_id"))
    stored = base.where(full).groupBy("record_id").agg(F.max(F.map_entries("headers")).alias("entries"))
    # staged, so that the join below reads plain shuffles on both sides, whose hot keys are split
    stored = stage(stored.select(F.col("record_id").cast("string").alias("stored_id"), "entries"), "revisit-stored")
    stored = stored.select("stored_id", F.map_from_entries("entries").alias("kept"))
    # revisits without a response match none, and are spread instead of meeting under one NULL
    spread = F.concat(F.lit("none "), F.xxhash64("record_id", "captured_at").cast("string"))
    joined = revisits.join(answer, F.col("record_id").eqNullSafe(F.col("rid")), "left").withColumn(
        "stored_id", F.coalesce(F.col("response_id").cast("string"), spread)).join(stored, "stored_id", "left")
    tag, date = F.col("headers")["etag"], F.col("headers")["last-modified"]
    kept_tag, kept_date = F.col("kept")["etag"], F.col("kept")["last-modified"]
    outcome = (
        F.when(F.col("kept").isNull(), "missing")
        .when(tag.isNotNull() & kept_tag.isNotNull(),
              F.when(opaque(tag) == opaque(kept_tag), "resolved").otherwise("mismatch"))
        .when(tag.isNull() & date.isNotNull() & kept_date.isNotNull(),
              F.when(date == kept_date, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated"))
    newer = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(
        F.map_filter("kept", lambda k, _: ~F.array_contains(F.map_keys(newer), k)), newer)
    return joined.withColumn("outcome", outcome).select(
        "record_id", F.col("key").alias("canonical_url"), "captured_at",
        F.when(F.col("outcome") != "missing", F.col("response_id")).alias("response_id"), "outcome",
        F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log made from pages: each page stored once and revisited three times.

    The times, tags and dates follow from the page id and content; some revisits precede the
    response, some name an older tag, some a date only, some nothing.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    minute = F.pmod(F.col("page_id") * 37, F.lit(1000))
    day = F.concat(F.lit("day "), F.pmod("page_id", F.lit(28)).cast("string"))
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + m * 60)
    response = pages.select(
        (F.col("page_id") * 4).alias("record_id"), "url", at(minute).alias("captured_at"),
        F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"),
                     F.lit("content-length"), F.octet_length("html").cast("string")).alias("headers"))
    number = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("v")
    shape = F.pmod(F.col("page_id") + F.col("v"), F.lit(5))
    sent = (
        F.when(shape == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), F.lit("now")))
        .when(shape == 1, F.create_map(F.lit("etag"), F.lit('"old"')))
        .when(shape == 2, F.create_map(F.lit("last-modified"), day, F.lit("server"), F.lit("s")))
        .when(shape == 3, F.create_map(F.lit("expires"), F.lit("soon")))
        .otherwise(F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("x"), F.lit("vary"), F.lit("*"))))
    revisit = pages.select("page_id", "url", "html", number).select(
        (F.col("page_id") * 4 + F.col("v")).alias("record_id"),
        F.concat(F.col("url"), F.lit("#v"), F.col("v").cast("string")).alias("url"),
        at(minute + (F.col("v") - 1) * 50).alias("captured_at"), F.lit("revisit").alias("kind"),
        sent.alias("headers"))
    return response.unionByName(revisit)


SQL = r"""
WITH p AS (SELECT page_id, url, html, '"' || md5(html) || '"' AS tag,
                  'day ' || (page_id % 28) AS day, (page_id * 37) % 1000 AS minute FROM pages),
r AS (SELECT page_id * 4 AS record_id, url, minute AS moment, tag, day, octet_length(encode(html)) AS bytes FROM p),
v AS (SELECT page_id * 4 + v AS record_id, url, minute + (v - 1) * 50 AS moment, tag, day, (page_id + v) % 5 AS shape
      FROM p, generate_series(1, 3) AS g(v)),
u AS (SELECT record_id, url, moment, regexp_replace(trim(url), '#.*$', '') AS bare FROM r
      UNION ALL SELECT record_id, url, moment, regexp_replace(trim(url), '#.*$', '') FROM v),
h AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head FROM u),
k AS (SELECT record_id, moment, regexp_replace(regexp_replace(head, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
             || regexp_replace(substr(bare, length(head) + 1), '/+$', '') AS key FROM h),
pairs AS (SELECT v.record_id, max({'t': b.moment, 'id': b.record_id}).id AS response_id
          FROM v JOIN k a USING (record_id)
          LEFT JOIN (SELECT r.record_id, k.moment, k.key FROM r JOIN k USING (record_id)) b
            ON a.key = b.key AND b.moment < a.moment GROUP BY v.record_id),
j AS (SELECT v.record_id, k.key, v.shape, v.tag, v.day, pairs.response_id, r.tag AS rtag, r.day AS rday, r.bytes
      FROM v JOIN pairs USING (record_id) JOIN k ON k.record_id = v.record_id
      LEFT JOIN r ON r.record_id = pairs.response_id),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
        WHEN shape IN (0, 4) THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END
        WHEN shape = 1 THEN CASE WHEN rtag = '"old"' THEN 'resolved' ELSE 'mismatch' END
        WHEN shape = 2 THEN CASE WHEN day = rday THEN 'resolved' ELSE 'mismatch' END
        ELSE 'unvalidated' END AS outcome FROM j)
SELECT record_id, key AS canonical_url, response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN
    CASE shape WHEN 0 THEN 'content-length=' || bytes || ';content-type=text/html;date=now;etag=W/' || tag || ';last-modified=' || rday
               WHEN 2 THEN 'content-length=' || bytes || ';content-type=text/html;etag=' || rtag || ';last-modified=' || day
               ELSE 'content-length=' || bytes || ';content-type=text/html;etag=' || tag || ';last-modified=' || rday || ';vary=*' END
  ELSE CASE shape WHEN 0 THEN 'date=now;etag=W/' || tag WHEN 1 THEN 'etag="old"'
                  WHEN 2 THEN 'last-modified=' || day || ';server=s' WHEN 3 THEN 'expires=soon'
                  ELSE 'content-type=x;etag=' || tag || ';vary=*' END END AS headers
FROM o"""


@query("op9_warc_revisits", sql=SQL)
def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.sort_array(F.map_entries("headers"))
    return resolve_revisits(captures(table(spark, sf_dir, "pages"))).select(
        "record_id", "canonical_url", "response_id", "outcome",
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))
