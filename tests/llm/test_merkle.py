"""The Merkle manifest against trees built by hand."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import DATA_DIR
from starwright.llm import merkle
from starwright.llm import queries as llm

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, key string, node int, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row: dict) -> str:
    parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in COLUMNS))
    return digest("".join(parts))


def ways(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of ``nodes`` and every node's siblings, lowest level first."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 16 * 16:place // 16 * 16 + 16]
            found[i].append(("".join(run[:place % 16]), "".join(run[place % 16 + 1:])))
        at = [p // 16 for p in at]
        nodes = [digest("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], found


def by_hand(rows: list[dict]) -> list[tuple]:
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, trees = [], {}
    for source in order:
        groups[source].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[source] = ways([leaf_of(r) for r in groups[source]])
        tops.append(trees[source][0])
    root, ends = ways(tops)
    out = []
    for place, source in enumerate(order):
        for row, path in zip(groups[source], trees[source][1]):
            path, shown = path + ends[place], dict(row)
            if row["doc_id"] is not None and row["text"] and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                shown["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            folded = leaf_of(shown)
            for left, right in path:
                folded = digest(left + folded + right)
            out.append((row["doc_id"], leaf_of(row), trees[source][0], root,
                        digest("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def made(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf(
        *[F.col(c) for c in COLUMNS[:-1]], F.translate("text", merkle.UPPER, merkle.LOWER)))
    shown = F.coalesce(shown, merkle.leaf(*[F.col(c) for c in COLUMNS]))
    got = merkle.merkle_manifest(docs, tampered=shown)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def row(i, source, text="Some Words"):
    return (i, source, "en", 10, text, 1, "k", 2, "r")


@pytest.mark.parametrize("sizes", [[1], [2], [16, 1], [17, 256], [257, 3, 600], [1] * 40, [4200]])
def test_trees_of_all_shapes(spark, sizes):
    rng = random.Random(str(sizes))
    rows = [row(rng.randrange(10**9), f"s{k}") for k, n in enumerate(sizes) for _ in range(n)]
    assert made(spark, rows) == by_hand([dict(zip(SCHEMA_NAMES, r)) for r in rows])


SCHEMA_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def test_more_than_256_groups(spark):
    rows = [row(i, f"s{i % 300}") for i in range(700)]
    assert made(spark, rows) == by_hand([dict(zip(SCHEMA_NAMES, r)) for r in rows])


def test_odd_rows(spark):
    rows = [row(5, None), row(5, None), row(None, None), (None,) * 9, row(0, "a", None), row(7, "a", ""),
            row(8, "é", "ÀB中😀 " * 9), row(9, "a", "X" * 300000), row(-3, "B"), row(10**18, "a", "x\n|:-")]
    rows += [row(12, "hot")] * 400  # rows given many times
    assert made(spark, rows) == by_hand([dict(zip(SCHEMA_NAMES, r)) for r in rows])


def test_empty_table(spark):
    assert made(spark, []) == []


def test_tampering_is_seen(spark):
    got = llm.QUERIES["op11_merkle_manifest"](spark, DATA_DIR)
    docs = spark.read.parquet(f"{DATA_DIR}/documents.parquet")
    changed = {r["doc_id"] for r in docs.where("text rlike '[A-Z]'").select("doc_id").collect()}
    for r in got.collect():
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in changed
        assert r["verified"] != tampered
