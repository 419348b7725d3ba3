"""Ranked lexical search: impact vectors in buckets by length, pruned by bounds, rescored in integers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.llm.common import buckets_for, running_total, stage
from starwright.llm.registry import query, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII letters in lower case, digits and bytes of other characters as they are, the rest as a blank
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_TERMS = 400_000  # terms of the items that are searched together, ITEM_COST per item included
ITEM_COST = 25
FIRST_ROWS, GROWTH = 20_000, 16  # rows of the longest vectors that are searched first; each round takes more
CLASSES = 4  # of lengths, per doubling
BUCKET_ROWS = 2048
FOCUS = 6  # heaviest terms of an item whose coordinates are looked at
PIECE_BYTES = 1 << 20
SALTS = 64
SLACK = 1e-9  # of bounds, for rounding


def term_counts(text: str | None, places: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """How many terms a whole text has, and how often those of ``places``; long texts go in pieces."""
    body = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    total, found, at = 0, Counter(), 0
    while at < len(body):
        end = len(body) if at + PIECE_BYTES >= len(body) else body.find(b" ", at + PIECE_BYTES)
        words = body[at:end if end >= 0 else len(body)].split()
        total += len(words)
        found.update(map(places.get, words))
        at = end if end >= 0 else len(body)
    found.pop(None, None)
    return total, found


def count_terms(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, ids, tfs`` of every document with a term: n counts all, ids and tfs those of ``places``."""
    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept, sizes, offsets, ids, tfs = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                n, found = term_counts(text.as_py(), places)
                if n:
                    kept.append(row)
                    sizes.append(n)
                    ids.extend(found)
                    tfs.extend(found.values())
                    offsets.append(len(ids))
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")).mapInArrow(
        batches, "doc_id long, n long, ids array<int>, tfs array<long>")


@dataclass
class Items:
    """Items searched together: terms as numbers, and the weight of every term."""

    keys: list
    terms: list[np.ndarray]  # of each item, heaviest first
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.lengths = np.array([math.sqrt(self.weights[t].sum()) for t in self.terms])
        self.rests = np.array([math.sqrt(self.weights[t[FOCUS:]].sum()) for t in self.terms])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def impact_vectors(counts: DataFrame, weights: np.ndarray, documents: int, terms: int) -> DataFrame:
    """``doc_id, length, ids, impacts`` of documents that hold a term of weight.

    With x as impact and w as weight of a term, a score is the inner product of the vectors x sqrt(w) of
    the document and sqrt(w) of the item; ``length`` is the norm of the first over all terms of the items.
    """
    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, each = lists(batch.column(2))
            tfs, _ = lists(batch.column(3))
            m = 50 + (50 * batch.column(1).to_numpy() * documents) // terms
            owner = np.repeat(np.arange(batch.num_rows), each)
            impacts = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owner])
            length = np.sqrt(np.bincount(owner, weights[ids] * impacts.astype(float) ** 2, minlength=batch.num_rows))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(length), batch.column(2),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *each]), pa.int32()), pa.array(impacts.astype(np.int32)))],
                ["doc_id", "length", "ids", "impacts"])
            yield out.filter(pa.array(length > 0))

    return counts.mapInArrow(batches, "doc_id long, length double, ids array<int>, impacts array<int>")


class Best:
    """The best rows of each item so far, and the score below which a row has no place any more."""

    def __init__(self, floors: np.ndarray, count: int):
        self.floors, self.count = floors.copy(), count
        self.scores: list[list[np.ndarray]] = [[] for _ in floors]
        self.ids: list[list[np.ndarray]] = [[] for _ in floors]
        self.held = np.zeros(len(floors), np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scores[item].append(scores)
        self.ids[item].append(ids)
        self.held[item] += len(scores)
        if self.held[item] >= 2 * self.count:
            self.cut(item)

    def cut(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = np.concatenate(self.scores[item]), np.concatenate(self.ids[item])
        best = np.lexsort((ids, -scores))[:self.count]
        scores, ids = scores[best], ids[best]
        self.scores[item], self.ids[item], self.held[item] = [scores], [ids], len(best)
        if len(best) == self.count:
            self.floors[item] = max(self.floors[item], scores[-1])
        return scores, ids


def search_bucket(items: Items, best: Best, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray,
                  each: np.ndarray, impacts: np.ndarray) -> None:
    """Search a bucket of vectors of about one length for all items that may find something in it.

    An item's length times the largest of the bucket bounds all its scores there (Cauchy-Schwarz). Inside,
    the coordinates of its FOCUS heaviest terms give a part of the score, and Cauchy-Schwarz on what is left of
    both vectors bounds the rest, row by row. Rows whose bound reaches the floor are rescored in integers.
    """
    asking = np.flatnonzero(items.lengths * lengths.max() * (1 + SLACK) >= best.floors)
    if not len(asking):
        return
    owner = np.repeat(np.arange(len(doc_ids)), each)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    values = items.weights[ids] * impacts[order]
    known, starts = np.unique(ids, return_index=True)
    first = np.zeros(len(items.weights) + 1, np.int64)
    last = np.zeros(len(items.weights) + 1, np.int64)
    first[known], last[known] = starts, np.append(starts[1:], len(ids))
    squares = lengths * lengths
    for item in asking:
        terms = items.terms[item]
        part, seen = np.zeros(len(doc_ids)), np.zeros(len(doc_ids))
        for t in terms[:FOCUS]:
            rows, x = owner[first[t]:last[t]], values[first[t]:last[t]].astype(float)
            part[rows] += x
            seen[rows] += x * x / items.weights[t]
        bound = part + items.rests[item] * np.sqrt(np.maximum(squares - seen, 0) + 1e-12 * squares)
        maybe = bound * (1 + SLACK) >= best.floors[item]
        if not maybe.any():
            continue
        scores = np.zeros(len(doc_ids), np.int64)
        for t in terms:
            scores[owner[first[t]:last[t]]] += values[first[t]:last[t]]  # a row holds a term once
        found = np.flatnonzero(maybe & (scores >= best.floors[item]))
        if len(found):
            best.add(item, scores[found], doc_ids[found])


def search(rows: DataFrame, items: Items, floors: np.ndarray, count: int) -> DataFrame:
    """``item, doc_id, score`` of each task's best rows of every item that reach the floors."""
    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floors, count)
        for batch in source:
            doc_ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)  # NULL ids come first
            lengths = batch.column(1).to_numpy()
            ids, each = lists(batch.column(2))
            impacts = lists(batch.column(3))[0].astype(np.int64)
            ends = np.cumsum([0, *each])
            for at in range(0, len(doc_ids), BUCKET_ROWS):
                to = min(at + BUCKET_ROWS, len(doc_ids))
                inner = slice(ends[at], ends[to])
                search_bucket(items, best, doc_ids[at:to], lengths[at:to], ids[inner], each[at:to], impacts[inner])
        for item in np.flatnonzero(best.held):
            scores, ids = best.cut(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), item), pa.int32()), pa.array(ids, mask=ids == -(2**63)), pa.array(scores)],
                ["item", "doc_id", "score"])

    return rows.mapInArrow(batches, "item int, doc_id long, score long")


def top(found: DataFrame, by: list[str], count: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def search_block(docs: DataFrame, keys: list, terms: list[list[str]], count: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for items whose terms fit the driver and every task."""
    spark = docs.sparkSession
    vocabulary = sorted({t for some in terms for t in some})
    places = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(vocabulary)}
    counts = stage(count_terms(docs, places), "lemp-counts")
    documents, all_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():
        weights[r["id"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))  # a row per term
    numbers = [np.array([places[t.encode("utf-8", "surrogatepass")] for t in some], np.int64) for some in terms]
    numbers = [t[weights[t] > 0] for t in numbers]  # without weight or documents a term adds nothing
    items = Items(keys, [t[np.argsort(-weights[t], kind="stable")] for t in numbers], weights)

    found = spark.createDataFrame([], "item int, doc_id long, score long, rank int")
    floors = np.ones(len(keys))  # scores are integers above 0
    if documents:
        by_length = [F.desc("length"), "doc_id"]
        vectors = impact_vectors(counts, weights, documents, all_terms)
        vectors = stage(vectors.repartitionByRange(*by_length).sortWithinPartitions(*by_length), "lemp-vectors")
        group = F.floor(F.log2("length") * CLASSES).alias("class")
        classes = sorted(((r["class"], r["n"]) for r in vectors.groupBy(group).agg(  # a row per length class
            F.count("*").alias("n")).collect()), reverse=True)
        rows, most, high = 0, FIRST_ROWS, math.inf
        for k, (number, n) in enumerate(classes):
            rows += n
            if rows < most and k < len(classes) - 1:
                continue
            low = 0.0 if k == len(classes) - 1 else 2 ** (number / CLASSES)
            needed = float((floors / np.maximum(items.lengths, 1e-300)).min()) * (1 - SLACK) if keys else math.inf
            if high <= needed:  # shorter vectors reach no floor
                break
            part = vectors.where((F.col("length") >= max(low, needed)) & (F.col("length") < high))
            new = search(part, items, floors, count).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
            new = top(new, ["item", "salt"], count).select("item", "doc_id", "score")
            found = stage(top(found.select("item", "doc_id", "score").unionByName(new), ["item"], count), "lemp-best")
            for r in found.where(F.col("rank") == count).select("item", "score").collect():  # a row per item
                floors[r["item"]] = r["score"]
            rows, most, high = 0, most * GROWTH, low
    names = spark.createDataFrame(list(enumerate(keys)), "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, count: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``count`` best documents with a score above 0.

    Scores are those of the module's contract: impacts and weights as integers, added up over the item's
    distinct terms. Equal scores rank by id, NULL ids first. Rows of one item id, also NULL, are one
    item; items without terms have no rows. NULL and empty texts have no terms, and count in no statistic;
    texts of any length are read whole; a document given twice is two documents; other columns are ignored;
    an empty table gives no rows.

    Items are searched in blocks whose terms fit a task (``block_terms``; a longer item is a block of its own),
    each in one pass over the texts. Document vectors are ordered by length over all tasks. The longest
    are searched first and give each item a floor; of the rest only what Cauchy-Schwarz lets reach
    the lowest floor is read, bucket by bucket. Tasks hand on their best rows per item, merged in salted steps.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(
        F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    terms = stage(terms, "lemp-items")
    sizes = terms.groupBy("item_id").agg((F.count("*") + ITEM_COST).alias("cost"))
    total, most = sizes.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.count("*")).first()
    blocks = total // block_terms + 1
    if blocks > 1:
        before = running_total(sizes, [], ["item_id"], F.col("cost"), "before", buckets_for(most))
        place = before.select(F.col("item_id").alias("__item"), F.floor(F.col("before") / block_terms).alias("block"))
        terms = stage(terms.join(place, F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item"), "lemp-items")
    results = []
    for block in range(blocks):
        some = terms.where(F.col("block") == block) if blocks > 1 else terms
        rows = some.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id").collect()
        if rows:
            results.append(search_block(docs, [r["item_id"] for r in rows], [r["terms"] for r in rows], count))
    out = results[0] if results else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in results[1:]:
        out = out.unionByName(more)
    return out


@query("op12_lemp_search", sql=r"""
    WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l,
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
    d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, u, l), p) AS terms
        FROM documents, low),
    used AS (SELECT row, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM used),
    items AS (SELECT DISTINCT item_id, term FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, u, l), p)) AS term FROM benchmark, low)),
    tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM used)
        WHERE term IN (SELECT term FROM items) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
    impacts AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))
        AS part FROM tf JOIN weights USING (term), totals),
    scores AS (SELECT item_id, row, doc_id, sum(part)::BIGINT AS score FROM items JOIN impacts USING (term)
        GROUP BY item_id, row, doc_id HAVING sum(part) > 0),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER
        AS rank, doc_id, score FROM scores)
    SELECT * FROM ranked WHERE rank <= 50""")
def op12_lemp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
