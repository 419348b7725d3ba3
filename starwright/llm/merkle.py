"""Merkle dataset manifest: tree levels as concatenated hex strings of aligned blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.llm.common import small, stage
from starwright.llm.registry import query, table

ARITY = 16
BLOCK = ARITY * ARITY  # nodes of one aligned block: two levels of the tree
HEX = 64  # characters of a digest
PATH_ROWS = 10_000  # rows with a path, some kilobytes each, that may be broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value for hashing: ``-`` if NULL, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Add ``pos``, the gapless place of a row in its group of ``keys``, and ``n``, the rows of the group.

    Rows are dealt by ranges of (keys, order), so a group of any size lies in many tasks. The ranged
    rows are staged with their place in their range; a group's place is that plus the group's
    rows in the ranges before, of which there is one row per group and range.
    """
    ranged = df.repartitionByRange(*keys, *order) if keys or order else df
    ranged = stage(
        ranged.sortWithinPartitions(*keys, *order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), label)
    found = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row per range at most
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(found.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__kp"),
        (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__off"),
        F.sum("__c").over(group).alias("n")), label)
    same = F.col("__part") == F.col("__kp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranged.join(small(offsets), same).select(
        *df.columns, (F.col("__at") + F.col("__off")).alias("pos"), "n")


def blocks(nodes: DataFrame, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """Aligned blocks of ``nodes (key, pos, n, node, extra...)``, one row each.

    ``runs`` holds the block's level cut into runs of ARITY digests, ``level`` the next level, both as
    concatenated hex; ``depth`` says how many levels the block climbs and ``root`` where it ends: a
    lone node stays, up to ARITY nodes are hashed once, more twice. ``items`` keeps
    ``extra`` of the nodes in order. A block has at most BLOCK nodes whatever the size of its group.
    """
    width = ARITY * HEX
    found = nodes.groupBy(key, F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "node", *extra))).alias("items"))
    found = found.withColumn("text", F.array_join(F.transform("items", lambda x: x["node"]), ""))
    found = found.withColumn("runs", F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / width).cast("int")),
        lambda i: F.substring(F.col("text"), i * width + 1, F.lit(width)))).drop("text")
    return (
        found.withColumn("level", F.array_join(F.transform("runs", lambda run: F.sha2(run, 256)), ""))
        .withColumn("depth", F.when(F.col("n") == 1, 0).when(F.col("n") <= ARITY, 1).otherwise(2))
        .withColumn("root", F.when(F.col("depth") == 0, F.element_at("runs", 1))
                    .when(F.col("depth") == 1, F.col("level")).otherwise(F.sha2("level", 256))))


def flanks(level: Column, at: Column) -> Column:
    """The digests left and right of number ``at`` of a level string."""
    return F.struct(F.substring(level, F.lit(1), at * HEX).alias("l"),
                    F.substring(level, at * HEX + HEX + 1, F.lit(ARITY * HEX)).alias("r"))


def steps(i: Column) -> Column:
    """The siblings of a block's node ``i`` on its way to the block's root, lowest first."""
    low = flanks(F.element_at("runs", (i / ARITY).cast("int") + 1), i % ARITY)
    high = flanks(F.col("level"), (i / ARITY).cast("int"))
    return F.slice(F.array(low, high), 1, F.col("depth"))


def climb(nodes: DataFrame, key: str, label: str) -> DataFrame:
    """``key, pos, path, root`` of ``nodes (key, pos, n, node)``: siblings up to the group's root.

    Roots of blocks are nodes of the next call, with a 256th of the rows, until every group is one block.
    """
    found = stage(blocks(nodes, key), label)
    each = found.select("*", F.posexplode("items").alias("at", "item")).select(
        F.col(key), "block", F.col("item.pos").alias("pos"), steps(F.col("at")).alias("path"), "root")
    return each.drop("block") if found.where(F.col("n") > BLOCK).isEmpty() else onward(
        each, above(found, key, label), key)


def above(found: DataFrame, key: str, label: str) -> DataFrame:
    """The ways of blocks to their group's root, staged."""
    nodes = found.select(key, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
                         F.col("root").alias("node"))
    return stage(climb(nodes, key, label), label)


def onward(rows: DataFrame, upper: DataFrame, key: str) -> DataFrame:
    """Continue the ``path`` of rows of a block by the block's own, to its root."""
    up = upper.select(F.col(key).alias("__key"), F.col("pos").alias("__block"), F.col("path").alias("__up"),
                      F.col("root").alias("__top"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block"))
    return rows.join(small(up, PATH_ROWS), same).select(
        key, "pos", F.concat("path", "__up").alias("path"), F.col("__top").alias("root"))


def merkle_manifest(
    df: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    tampered: Column | None = None,
) -> DataFrame:
    """A Merkle tree over all rows, and for every row the proof that it is in it.

    A row's leaf is the SHA-256 of ``columns`` by :func:`field`. The leaves of a group ascend by id, and
    of every 16 nodes in a row one parent is made until one is left, the group's subroot; the
    subroots, by group, make the root alike. ``tampered`` is the digest (see :func:`leaf`) a row is
    presented with, by default its own; ``folded_root`` is what that gives with the row's siblings.

    Returns per row ``id, leaf, subroot, root, proof_sha256, folded_root, verified``; the proof's
    digest is over all siblings, lowest level first, left to right. NULLs are hashed as ``-``; NULL
    ids and the NULL group come first; equal ids are ordered by leaf, so rows given twice are two equal
    leaves side by side; other columns are ignored; an empty table gives no rows.

    Texts are hashed where they are read; only ids and digests are shuffled. No group is in one
    task: its order is by ranges, its levels by blocks of 256 nodes, and block roots recurse.
    """
    own = leaf(*[df[c] for c in columns])
    rows = stage(df.select(
        df[id_col].alias("id"), df[group_col].cast("string").alias("key"), own.alias("node"),
        (own if tampered is None else tampered).alias("shown")), "merkle-leaves")
    placed = positions(rows, ["key"], ["id", "node"], "merkle-ranges")
    found = stage(blocks(placed, "key", ["id", "shown"]), "merkle-blocks")
    whole = found.where(F.col("n") <= BLOCK).select("key", F.lit(0).cast("long").alias("pos"), F.expr(
        "cast(array() as array<struct<l: string, r: string>>)").alias("path"), "root")
    parts = found.where(F.col("n") > BLOCK)
    upper = whole if parts.isEmpty() else whole.unionByName(above(parts, "key", "merkle-upper"))
    upper = stage(upper, "merkle-upper")

    subroots = upper.where("pos = 0").select("key", F.col("root").alias("node"))
    tops = positions(subroots, [], ["key"], "merkle-tops").withColumn("all", F.lit(0))
    ends = climb(tops.select("all", "pos", "n", "node"), "all", "merkle-root")
    ends = tops.select("key", F.col("pos").alias("at"), F.col("node").alias("subroot")).join(
        ends.select(F.col("pos").alias("at"), F.col("path").alias("__end"), F.col("root").alias("__root")), "at")
    ends = stage(ends.select(F.col("key").alias("__group"), "subroot", "__end", "__root"), "merkle-root")

    ways = found.join(
        small(upper.select(F.col("key").alias("__key"), F.col("pos").alias("__block"), F.col("path").alias("__up")),
              PATH_ROWS),
        F.col("key").eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block")))
    ways = ways.join(small(ends, PATH_ROWS), F.col("key").eqNullSafe(F.col("__group")))
    ways = ways.withColumn("__rest", F.concat("__up", "__end"))
    each = ways.select("runs", "level", "depth", "subroot", "__root", "__rest", F.posexplode("items").alias("at", "item"))
    each = each.select(
        F.col("item.id").alias(id_col), F.col("item.node").alias("leaf"), "subroot", F.col("__root").alias("root"),
        F.col("item.shown").alias("shown"), F.concat(steps(F.col("at")), F.col("__rest")).alias("path"))
    folded = F.aggregate("path", F.col("shown"), lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    out = each.select(id_col, "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


TREE_SQL = """
    WITH RECURSIVE
    crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, x:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(i))),
    d AS (SELECT doc_id, source, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
            coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
            coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
        xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM documents, crc),
    h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(CASE WHEN crc % 5 = 0 THEN strlen(low) || ':' || low ELSE strlen(text) || ':' || text END,
            '-')) AS shown FROM d),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
    nodes(source, level, pos, h) AS (
        SELECT source, 0, pos, leaf FROM leaves
        UNION ALL
        SELECT source, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
        FROM (SELECT *, count(*) OVER (PARTITION BY source, level) AS c FROM nodes) WHERE c > 1
        GROUP BY source, level, pos // 16),
    subroots AS (SELECT source, max_by(h, level) AS subroot FROM nodes GROUP BY source),
    placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM subroots),
    tops(level, pos, h) AS (
        SELECT 0, place, subroot FROM placed
        UNION ALL
        SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
        FROM (SELECT *, count(*) OVER (PARTITION BY level) AS c FROM tops) WHERE c > 1 GROUP BY level, pos // 16),
    sides AS (
        SELECT source, level, pos, count(*) OVER (PARTITION BY source, level) AS c,
            coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM nodes WINDOW w AS (PARTITION BY source, level, pos // 16 ORDER BY pos)),
    ends AS (
        SELECT level, pos, count(*) OVER (PARTITION BY level) AS c,
            coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM tops WINDOW w AS (PARTITION BY level, pos // 16 ORDER BY pos)),
    powers AS (SELECT l, (16 ** l)::BIGINT AS p FROM range(12) AS r(l)),
    steps AS (
        SELECT a.source, a.pos, s.level, s.l, s.r FROM leaves a CROSS JOIN powers k JOIN sides s
        ON s.source IS NOT DISTINCT FROM a.source AND s.level = k.l AND s.pos = a.pos // k.p WHERE s.c > 1
        UNION ALL
        SELECT a.source, a.pos, 100 + e.level, e.l, e.r FROM leaves a JOIN placed b ON a.source IS NOT DISTINCT FROM b.source
        CROSS JOIN powers k JOIN ends e ON e.level = k.l AND e.pos = b.place // k.p WHERE e.c > 1),
    ways AS (
        SELECT source, pos, string_agg(l || r, '' ORDER BY level) AS proof,
            list({'l': l, 'h': '', 'r': r} ORDER BY level) AS way
        FROM steps GROUP BY source, pos),
    whole AS (
        SELECT a.doc_id, a.leaf, b.subroot, (SELECT max_by(h, level) FROM tops) AS root,
            sha256(coalesce(proof, '')) AS proof_sha256,
            CASE WHEN way IS NULL THEN shown ELSE list_reduce([{'l': '', 'h': shown, 'r': ''}] || way,
                lambda x, y: {'l': '', 'h': sha256(y.l || x.h || y.r), 'r': ''}).h END AS folded_root
        FROM leaves a JOIN placed b ON a.source IS NOT DISTINCT FROM b.source
        LEFT JOIN ways w ON w.source IS NOT DISTINCT FROM a.source AND w.pos = a.pos)
    SELECT *, folded_root = root AS verified FROM whole"""


@query("op11_merkle_manifest", sql=TREE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    shown = F.when(chosen, leaf(*own[:-1], F.translate(docs["text"], UPPER, LOWER))).otherwise(leaf(*own))
    return merkle_manifest(docs, tampered=shown)
