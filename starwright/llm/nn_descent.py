"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers queries.

Nodes are dealt to cells by a hash. A cell is one row of arrays: vectors, lists of neighbours, beams of its
queries. What cells ask of and tell each other are rows of arrays too, one per pair of cells and step, so a
shuffle moves few large rows and the work is done on arrays inside tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.llm.common import bounded_batches, stage
from starwright.llm.registry import query, table
from starwright.llm.words import mix

DEGREE = 32  # neighbours of a node in the graph
REVERSE = 32  # of those that point to a node, how many it introduces to each other
BLOCK = 128  # vectors compared with each other at the start, at least
WIDER, SHARE = 64, 64  # blocks grow up to WIDER times that while they are a SHARE-th of all vectors
PLANTINGS = 4  # random partitions at the start
SETTLED = 0.01  # NN-descent ends with a round that replaces less than this share of all neighbours
TELL = 12  # new neighbours that one introduction may name for a node
BEAM, EXPAND = 128, 32  # of the greedy search, at first
PROBES, RECALL = 200, 0.93  # queries whose answers are known; the share of these that the search has to find
GAIN = 0.005  # a wider beam that finds no more than this was the last
SEED = 17
CELL, CELLS, LEAST = 8192, 24, 4096  # nodes of a cell; so many cells at least, if they have LEAST nodes each
CHUNK = 256  # groups or queries worked on together
FLUSH = 1 << 22  # bytes of rows sent on at once

ROW = "cell int, kind int, sender int, n int, told long, a binary, b binary, c binary, d binary, e binary"
VECTORS, LISTS, REVERSED, MEMBERS, BARS, WANTED, FOUND, BEAMS, OPENED, SCORE, EVERY, TRUTH = range(12)


class Layout(NamedTuple):
    """How nodes are numbered: ``cell * stride + place in the cell``."""

    cells: int
    stride: int
    dimension: int
    degree: int

    @property
    def span(self) -> int:
        return self.cells * self.stride

    @property
    def code(self) -> type:
        return np.int32 if self.span < 1 << 30 else np.int64


class Letter(NamedTuple):
    """A row that a cell got; ``told`` is a count for the driver."""

    kind: int
    sender: int
    n: int
    parts: list

    def array(self, i: int, dtype: type, *shape: int) -> np.ndarray:
        part = self.parts[i]
        flat = np.frombuffer(part, dtype) if part is not None and part.size else np.zeros(0, dtype)
        return flat.reshape(shape) if shape else flat


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def inner(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def best(df: DataFrame, by: str | list[str], count: int, *order: Column) -> DataFrame:
    """The first ``count`` rows of each group; Spark keeps no more of it on either side of the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= count).drop("__r")


def letter(cell: int, kind: int, sender: int, *parts: np.ndarray | None, n: int = 0, told: int = 0) -> tuple:
    return (int(cell), kind, int(sender), int(n), int(told),
            *[None if p is None else np.ascontiguousarray(p).tobytes() for p in parts], *[None] * (5 - len(parts)))


def batches(letters: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32()] * 4 + [pa.int64()] + [pa.binary()] * 5
    names = [field.split()[0] for field in ROW.split(", ")]
    held, size = [], 0
    for one in letters:
        held.append(one)
        size += 40 + sum(len(p) for p in one[5:] if p is not None)
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def mail(source: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[Letter]]]]:
    """Each cell with what it got, by kind and in the order of senders."""
    cell, got = None, {}
    for batch in source:
        heads = [batch.column(i).to_pylist() for i in range(4)]
        for i, (to, kind, sender, n) in enumerate(zip(*heads)):
            if to != cell and got:
                yield cell, got
                got = {}
            cell = to
            parts = [batch.column(j)[i].as_buffer() if batch.column(j)[i].is_valid else None for j in range(5, 10)]
            got.setdefault(kind, []).append(Letter(kind, sender, n, parts))
    if got:
        yield cell, got


def at_cells(rows: DataFrame, lay: Layout, work: Callable[[int, dict[int, list[Letter]]], Iterator[tuple]]) -> DataFrame:
    """The rows of a cell meet in one task; ``work`` gets them and yields rows to cells."""
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(row for cell, got in mail(source) for row in work(cell, got))

    met = rows.repartitionById(lay.cells, F.col("cell")).sortWithinPartitions("cell", "kind", "sender")
    return met.mapInArrow(run, ROW)


def by_owner(codes: np.ndarray, stride: int, *columns: np.ndarray) -> Iterator[tuple]:
    """For each cell that owns some of ``codes``: the cell, their places in it, and their part of the columns."""
    owner = codes // stride
    order = np.argsort(owner.astype(np.uint16) if len(owner) and owner.max() < 1 << 16 else owner, kind="stable")
    owner = owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(owner)]):
        part = order[lo:hi]
        yield int(owner[lo]), (codes[part] % stride).astype(np.int32), *[c[part] for c in columns]


def places(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal ones."""
    if not len(groups):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def falling(group: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Order by group, then from the largest score, as whole numbers."""
    bits = np.ascontiguousarray(score, np.float32).view(np.int32).astype(np.int64)
    rising = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)
    return (group.astype(np.int64) << 32) + (0x7FFFFFFF - rising)


def ranked(group: np.ndarray, code: np.ndarray, score: np.ndarray, count: int, known: int,
           span: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ``count`` best different codes of each group, by group and score, with their places.

    Of a code given twice one counts, of the first ``known`` if it is there; codes are less than ``span``.
    """
    key = (group.astype(np.int64) * span + code) * 2
    key[known:] += 1
    order = np.argsort(key)
    pair = key[order] >> 1
    order = order[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(order) else order
    order = order[np.argsort(falling(group[order], score[order]))]
    place = places(group[order])
    return order[place < count], place[place < count]


def joined(got: list[Letter], *parts: tuple[int, type]) -> list[np.ndarray]:
    return [np.concatenate([x.array(i, kind) for x in got]) if got else np.zeros(0, kind) for i, kind in parts]


def lists_of(got: dict[int, list[Letter]], lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (own,) = got[LISTS]
    return (own.array(0, lay.code, -1, lay.degree), own.array(1, np.float32, -1, lay.degree),
            own.array(2, np.bool_, -1, lay.degree))


def update(cell: int, got: dict[int, list[Letter]], lay: Layout) -> Iterator[tuple]:
    """New lists of a cell's nodes from what was found, and to each neighbour who points to it."""
    degree, size = lay.degree, got[VECTORS][0].n if VECTORS in got else None
    if LISTS in got:
        near, score, _ = lists_of(got, lay)
        size = len(near)
        group, place = np.nonzero(near >= 0)
        codes, scores = [near[group, place]], [score[group, place]]
        groups = [group.astype(np.int32)]
    else:
        groups, codes, scores = [np.zeros(0, np.int32)], [np.zeros(0, lay.code)], [np.zeros(0, np.float32)]
    known = len(groups[0])
    src, dst, value = joined(got.get(FOUND, []), (0, np.int32), (1, lay.code), (2, np.float32))
    group, code, scored = np.concatenate([*groups, src]), np.concatenate([*codes, dst]), np.concatenate([*scores, value])
    kept, place = ranked(group, code, scored, degree, known, lay.span)
    near, score, fresh = np.full((size, degree), -1, lay.code), np.full((size, degree), -np.inf, np.float32), np.zeros(
        (size, degree), bool)
    rows = group[kept]
    near[rows, place], score[rows, place], fresh[rows, place] = code[kept], scored[kept], kept >= known
    # told counts all neighbours, n those that are new
    yield letter(cell, LISTS, cell, near, score, fresh, n=int(fresh.sum()), told=len(kept))
    own = (rows + cell * lay.stride).astype(lay.code)
    for owner, at, back, worth, new in by_owner(code[kept], lay.stride, own, scored[kept], kept >= known):
        yield letter(owner, REVERSED, cell, at, back, worth, new)


def gather(cell: int, got: dict[int, list[Letter]], lay: Layout, most: int) -> Iterator[tuple]:
    """The members of each node's group: itself, its neighbours, the ``most`` best that point to it; asks for vectors.

    Groups without a new member have nothing to introduce.
    """
    near, score, fresh = lists_of(got, lay)
    size = len(near)
    dst, src, value, new = joined(got.get(REVERSED, []), (0, np.int32), (1, lay.code), (2, np.float32), (3, np.bool_))
    kept = np.argsort(falling(dst, value), kind="stable")
    place = places(dst[kept])
    kept, place = kept[place < most], place[place < most]
    back, back_new = np.full((size, most), -1, lay.code), np.zeros((size, most), bool)
    back[dst[kept], place], back_new[dst[kept], place] = src[kept], new[kept]
    for j in range(lay.degree):
        same = (back == near[:, j:j + 1]) & (back >= 0)
        fresh = fresh.copy() if j == 0 else fresh
        fresh[:, j] |= (same & back_new).any(axis=1)
        back[same] = -1
    itself = (np.arange(size) + cell * lay.stride).astype(lay.code)[:, None]
    members = np.concatenate([itself, near, back], axis=1)
    news = np.concatenate([np.zeros((size, 1), bool), fresh, back_new & (back >= 0)], axis=1)
    active = news.any(axis=1)
    members, news = members[active], news[active]
    order = np.argsort(members < 0, axis=1, kind="stable")
    members, news = np.take_along_axis(members, order, 1), np.take_along_axis(news, order, 1)
    counts = (members >= 0).sum(axis=1)
    width = int(counts.max()) if len(counts) else 0
    order = np.argsort(counts, kind="stable")  # groups of like sizes are worked on together
    members, news = members[order, :width], news[order, :width]
    need = np.unique(members[members >= 0])
    index = np.where(members >= 0, np.searchsorted(need, members), -1).astype(np.int32)
    yield letter(cell, BARS, cell, score[:, -1])
    if not len(need):
        return
    yield letter(cell, MEMBERS, cell, index, news, need, n=width)
    for owner, at in by_owner(need, lay.stride):
        yield letter(owner, WANTED, cell, at)


def supply(cell: int, got: dict[int, list[Letter]], lay: Layout) -> Iterator[tuple]:
    """Sends the vectors that other cells asked for, each with the score that its node's list begins to change at."""
    vectors = got[VECTORS][0].array(0, np.float32, -1, lay.dimension)
    bars = got[BARS][0].array(0, np.float32) if BARS in got else None
    for asked in got.get(WANTED, []):
        at = asked.array(0, np.int32)
        bar = bars[at] if bars is not None else np.full(len(at), -np.inf, np.float32)
        yield letter(asked.sender, VECTORS, cell, vectors[at], bar)
    for one in got.get(MEMBERS, []):
        yield letter(cell, MEMBERS, cell, *[one.array(i, np.uint8) for i in range(3)], n=one.n)


def introduce(cell: int, got: dict[int, list[Letter]], lay: Layout, keep: int) -> Iterator[tuple]:
    """In each group, every node's ``keep`` best others above its bar, of pairs with a new member."""
    if MEMBERS not in got:
        return
    (one,) = got[MEMBERS]
    index, news, need = one.array(0, np.int32, -1, one.n), one.array(1, np.bool_, -1, one.n), one.array(2, lay.code)
    vectors = np.zeros((len(need) + 1, lay.dimension), np.float32)  # the last stands for no member
    bars = np.full(len(need) + 1, np.inf, np.float32)
    at = 0
    for part in got.pop(VECTORS):
        some = part.array(0, np.float32, -1, lay.dimension)
        vectors[at:at + len(some)], bars[at:at + len(some)] = some, part.array(1, np.float32)
        at += len(some)
    src, dst, value = [], [], []
    for lo in range(0, len(index), CHUNK):
        part, new = index[lo:lo + CHUNK], news[lo:lo + CHUNK]
        width = int((part >= 0).sum(axis=1).max())
        part, new = np.ascontiguousarray(part[:, :width]), new[:, :width]
        v = vectors[part]
        s = np.matmul(v, v.transpose(0, 2, 1))
        s += np.where(part < 0, np.float32(-np.inf), np.float32(0))[:, None, :]
        s[:, np.arange(width), np.arange(width)] = -np.inf
        fits = s > bars[part][:, :, None]
        fits &= new[:, :, None] | new[:, None, :]
        many = np.count_nonzero(fits, axis=2) > keep
        if many.any():
            of = np.where(fits[many], s[many], -np.inf)
            fits[many] &= of >= np.partition(of, width - keep, axis=1)[:, width - keep, None]
        flat = np.flatnonzero(fits)
        from_, k = np.divmod(flat, width)
        src.append(part.reshape(-1)[from_])
        dst.append(part.reshape(-1)[from_ // width * width + k])
        value.append(s.reshape(-1)[flat])
    if src:
        src, dst, value = np.concatenate(src), np.concatenate(dst), np.concatenate(value)
        for owner, at, to, score in by_owner(need[src], lay.stride, need[dst], value):
            yield letter(owner, FOUND, cell, at, to, score)


def solved(blocks: DataFrame, lay: Layout, keep: int) -> DataFrame:
    """What is found in blocks: every node's ``keep`` best others; ``blocks (key, part, code, packed)``."""
    def work(source: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for key, codes, v in runs(source, lay):
            if len(codes) < 2:
                continue
            k = min(keep, len(codes) - 1)
            for lo in range(0, len(codes), CHUNK):
                s = v[lo:lo + CHUNK] @ v.T
                s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
                bar = np.partition(s, -k, axis=1)[:, -k]
                flat = np.flatnonzero(s >= bar[:, None])
                flat = flat[places(flat // len(codes)) < k]  # many may be as near as the last
                row, column = np.divmod(flat, len(codes))
                held.append((codes[row + lo], codes[column], s.reshape(-1)[flat]))
                size += len(flat)
            if size > 1 << 21:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def sent(held: list[tuple]) -> Iterator[tuple]:
        src, dst, score = (np.concatenate(x) for x in zip(*held))
        for owner, at, to, value in by_owner(src, lay.stride, dst, score):
            yield letter(owner, FOUND, 0, at, to, value)

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(work(source))

    return blocks.mapInArrow(run, ROW)


def runs(source: Iterable[pa.RecordBatch], lay: Layout) -> Iterator[tuple]:
    """Runs of equal (key, part) with their codes and vectors."""
    keys, codes, packed = np.zeros((0, 2), np.int64), np.zeros(0, lay.code), np.zeros((0, lay.dimension), np.float32)
    for batch in source:
        if not batch.num_rows:
            continue
        new = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        keys = np.concatenate([keys, new])
        codes = np.concatenate([codes, batch.column(2).to_numpy().astype(lay.code)])
        packed = np.concatenate([packed, unpacked(batch.column(3), lay.dimension)])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            yield keys[lo], codes[lo:hi], packed[lo:hi]
        if len(cuts):
            keys, codes, packed = keys[cuts[-1]:], codes[cuts[-1]:], packed[cuts[-1]:]
    if len(codes):
        yield keys[0], codes, packed


def unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dimension)


def neighbour_graph(vectors: DataFrame, lay: Layout, count: int) -> DataFrame:
    """For each cell, the lists of about the DEGREE nearest nodes of its nodes.

    ``vectors``: a row per cell. Random hyperplanes first deal the nodes into blocks of BLOCK or more,
    PLANTINGS times, and a hash of the node deals them once more over the whole table, so that nodes alone
    on their side of the planes get edges too; each block is solved. Then NN-descent: every node introduces its
    neighbours and those it is a neighbour of to each other, pairs that met in an earlier round excepted; what beats a
    node's worst neighbour replaces it. Rounds go on until one replaces less than SETTLED of all neighbours. A node
    introduces at most DEGREE + REVERSE + 1, so no group grows with the data.
    """
    block = max(BLOCK, min(WIDER * BLOCK, count // SHARE))
    bits = max(0, math.ceil(math.log2(max(1, count / block))))
    parts = max(1, math.ceil(count / block))
    planes = np.random.default_rng(SEED).normal(size=(PLANTINGS, lay.dimension, max(bits, 1)))
    most, keep = REVERSE, TELL

    def deal(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, got in mail(source):
            own = got[VECTORS][0].array(0, np.float32, -1, lay.dimension)
            for lo in range(0, len(own), 1024):
                v = own[lo:lo + 1024]
                codes = np.arange(lo, lo + len(v)) + cell * lay.stride
                packed = pa.array([x.tobytes() for x in v], pa.binary())
                for turn in range(PLANTINGS + 1):
                    if turn < PLANTINGS:
                        side = (v @ planes[turn] > 0)[:, :bits]
                        key = side @ (1 << np.arange(bits)) if bits else np.zeros(len(v), np.int64)
                    else:
                        with np.errstate(over="ignore"):
                            key = mix(codes.astype(np.uint64) + np.uint64(SEED)) % np.uint64(parts)
                    key = key.astype(np.int64) * (PLANTINGS + 1) + turn
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(codes), packed], ["key", "code", "packed"])

    dealt = vectors.mapInArrow(deal, "key long, code long, packed binary")
    sizes = stage(dealt.groupBy("key").agg(F.count("*").alias("c")), "ann-sizes")
    blocks = dealt.join(sizes, "key").select(
        "key", F.pmod(F.xxhash64("code", "key"), F.ceil(F.col("c") / block)).alias("part"), "code", "packed")
    blocks = blocks.repartition(lay.cells, "key", "part").sortWithinPartitions("key", "part", "code")
    sizes_only = vectors.withColumn("a", F.lit(None).cast("binary"))
    lists = stage(at_cells(solved(blocks, lay, lay.degree).union(sizes_only), lay, lambda c, g: update(c, g, lay)),
                  "ann-lists")
    while True:
        asked = at_cells(lists, lay, lambda c, g: gather(c, g, lay, most))
        supplied = at_cells(asked.union(vectors), lay, lambda c, g: supply(c, g, lay))
        found = at_cells(supplied, lay, lambda c, g: introduce(c, g, lay, keep))
        lists = stage(at_cells(found.union(lists.where(F.col("kind") == LISTS)), lay, lambda c, g: update(c, g, lay)),
                      "ann-lists")
        fresh, filled = lists.where(F.col("kind") == LISTS).agg(F.sum("n"), F.sum("told")).first()
        if fresh <= SETTLED * filled:
            return lists.where(F.col("kind") == LISTS)


class Beams(NamedTuple):
    """The queries of a cell by their place in it, and the best nodes of each: code, score, and whether it was opened."""

    at: np.ndarray
    code: np.ndarray
    score: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(got: dict[int, list[Letter]], lay: Layout) -> Beams:
        (one,) = got[BEAMS]
        return Beams(one.array(0, np.int32), one.array(1, lay.code, -1, one.n), one.array(2, np.float32, -1, one.n),
                     one.array(3, np.bool_, -1, one.n))

    def row(self, cell: int) -> tuple:
        return letter(cell, BEAMS, cell, *self, n=self.code.shape[1], told=int(((self.code >= 0) & ~self.seen).sum()))


def passed(cell: int, got: dict[int, list[Letter]], *kinds: int) -> Iterator[tuple]:
    for kind in kinds:
        for one in got.get(kind, []):
            yield letter(cell, kind, one.sender, *[one.array(i, np.uint8) for i in range(5)], n=one.n)


def own_queries(got: dict[int, list[Letter]], at: np.ndarray, lay: Layout) -> np.ndarray:
    """Vectors of queries; their extra coordinate is none of an inner product."""
    asking = got[VECTORS][0].array(0, np.float32, -1, lay.dimension)[at].copy()
    asking[:, -1] = 0
    return asking


def open_best(cell: int, got: dict[int, list[Letter]], lay: Layout, expand: int, again: bool) -> Iterator[tuple]:
    """Opens the ``expand`` best unopened nodes of each beam: asks for their lists. ``again``: all nodes are unopened."""
    beams = Beams.of(got, lay)
    seen = np.zeros_like(beams.seen) if again else beams.seen
    pick = ~seen & (beams.code >= 0)
    pick &= np.cumsum(pick, axis=1) <= expand
    yield beams._replace(seen=seen | pick).row(cell)
    if not pick.any():
        return
    rows, columns = np.nonzero(pick)
    need = np.unique(beams.code[rows, columns])
    opened = np.full((len(beams.at), expand), -1, np.int32)
    opened[rows, places(rows)] = np.searchsorted(need, beams.code[rows, columns])
    yield letter(cell, OPENED, cell, opened, n=expand)
    for owner, at in by_owner(need, lay.stride):
        yield letter(owner, WANTED, cell, at)


def recite(cell: int, got: dict[int, list[Letter]], lay: Layout) -> Iterator[tuple]:
    """Sends the lists that other cells asked for."""
    yield from passed(cell, got, BEAMS, OPENED)
    if WANTED in got:
        near = lists_of(got, lay)[0]
        for asked in got[WANTED]:
            yield letter(asked.sender, FOUND, cell, near[asked.array(0, np.int32)])


def sift(cell: int, got: dict[int, list[Letter]], lay: Layout, width: int) -> Iterator[tuple]:
    """Sends each query's vector to the cells of the nodes it reached and does not hold."""
    yield from passed(cell, got, BEAMS)
    if OPENED not in got:
        return
    beams = Beams.of(got, lay)
    opened = got[OPENED][0].array(0, np.int32, -1, got[OPENED][0].n)
    lists = np.concatenate([*joined(got[FOUND], (0, lay.code)), np.full(lay.degree, -1, lay.code)]).reshape(-1, lay.degree)
    bars = beams.score[:, width - 1] if beams.score.shape[1] >= width else np.full(len(beams.at), -np.inf, np.float32)
    asks, reached = [], []
    for lo in range(0, len(opened), CHUNK):
        near = lists[opened[lo:lo + CHUNK]].reshape(len(opened[lo:lo + CHUNK]), -1)
        # what a beam holds comes before the same node reached anew, and that before itself reached again
        keys = np.sort(np.concatenate([beams.code[lo:lo + CHUNK] * 2, near * 2 + 1], axis=1), axis=1)
        nodes = keys >> 1
        fresh = (keys & 1).astype(bool) & (nodes >= 0)
        fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        asks.append((np.flatnonzero(fresh) // fresh.shape[1] + lo).astype(np.int32))
        reached.append(nodes[fresh])
    asking = own_queries(got, beams.at, lay)
    for owner, at, ask in by_owner(np.concatenate(reached), lay.stride, np.concatenate(asks)):
        who, which = np.unique(ask, return_inverse=True)
        yield letter(owner, SCORE, cell, asking[who], who, which.astype(np.int32), at, bars[who])


def score(cell: int, got: dict[int, list[Letter]], lay: Layout, keep: int) -> Iterator[tuple]:
    """Sends back the nodes whose score beats a query's bar; of a query to every cell the ``keep`` best."""
    yield from passed(cell, got, BEAMS)
    if VECTORS not in got:
        return
    own = got[VECTORS][0].array(0, np.float32, -1, lay.dimension)
    for one in got.get(SCORE, []):
        asking, who = one.array(0, np.float32, -1, lay.dimension), one.array(1, np.int32)
        which, at, bars = one.array(2, np.int32), one.array(3, np.int32), one.array(4, np.float32)
        found = np.concatenate([
            np.einsum("ij,ij->i", asking[which[lo:lo + 2048]], own[at[lo:lo + 2048]]) for lo in range(0, len(at), 2048)])
        good = found > bars[which]
        if good.any():
            yield letter(one.sender, FOUND, cell, who[which[good]], (at[good] + cell * lay.stride).astype(lay.code), found[good])
    for one in got.get(EVERY, []):
        asking, who = one.array(0, np.float32, -1, lay.dimension), one.array(1, np.int32)
        k = min(keep, len(own))
        for lo in range(0, len(who), CHUNK):
            s = asking[lo:lo + CHUNK] @ own.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield letter(one.sender, FOUND, cell, np.repeat(who[lo:lo + CHUNK], k),
                         (top.ravel() + cell * lay.stride).astype(lay.code), np.take_along_axis(s, top, 1).ravel())


def settle(cell: int, got: dict[int, list[Letter]], lay: Layout, width: int, done: bool) -> Iterator[tuple]:
    """The ``width`` best of each beam and of what was found; ``done``: those are opened."""
    if BEAMS not in got:
        return
    beams = Beams.of(got, lay)
    rows, columns = np.nonzero(beams.code >= 0)
    who, code, value = joined(got.get(FOUND, []), (0, np.int32), (1, lay.code), (2, np.float32))
    group = np.concatenate([rows.astype(np.int32), who])
    codes = np.concatenate([beams.code[rows, columns], code])
    scores = np.concatenate([beams.score[rows, columns], value])
    seen = np.concatenate([beams.seen[rows, columns], np.full(len(who), done)])
    kept, place = ranked(group, codes, scores, width, len(rows), lay.span)
    shape = (len(beams.at), width)
    after = Beams(beams.at, np.full(shape, -1, lay.code), np.full(shape, -np.inf, np.float32), np.zeros(shape, bool))
    for held, given in ((after.code, codes), (after.score, scores), (after.seen, seen)):
        held[group[kept], place] = given[kept]
    yield after.row(cell)


def call(cell: int, got: dict[int, list[Letter]], lay: Layout, chosen: Callable[[int, Beams], np.ndarray]) -> Iterator[tuple]:
    """Sends the chosen queries of a cell to every cell."""
    if BEAMS not in got:
        return
    beams = Beams.of(got, lay)
    who = np.flatnonzero(chosen(cell, beams)).astype(np.int32)
    if len(who):
        asking = own_queries(got, beams.at[who], lay)
        for other in range(lay.cells):
            yield letter(other, EVERY, cell, asking, who)


def compare(cell: int, got: dict[int, list[Letter]], lay: Layout, keep: int) -> Iterator[tuple]:
    """``n`` of the ``told`` nearest nodes of some queries, as known, are in their beams."""
    if FOUND not in got:
        return
    beams = Beams.of(got, lay)
    who, code, value = joined(got[FOUND], (0, np.int32), (1, lay.code), (2, np.float32))
    kept, _ = ranked(who, code, value, keep, 0, lay.span)
    hits = (beams.code[who[kept]] == code[kept][:, None]).any(axis=1).sum()
    yield letter(cell, TRUTH, cell, n=hits, told=len(kept))


def search(beams: DataFrame, graph: DataFrame, vectors: DataFrame, lay: Layout, width: int, expand: int) -> DataFrame:
    """The best ``expand`` unopened of the ``width`` best nodes of a query hand on their neighbours, until all are opened."""
    again = True
    while True:
        asked = by_rows(beams, lambda c, g, again=again: open_best(c, g, lay, expand, again))
        told = at_cells(asked.union(graph), lay, lambda c, g: recite(c, g, lay))
        reached = at_cells(told.union(vectors), lay, lambda c, g: sift(c, g, lay, width))
        scored = at_cells(reached.union(vectors), lay, lambda c, g: score(c, g, lay, width))
        beams = stage(at_cells(scored, lay, lambda c, g: settle(c, g, lay, width, False)), "ann-beams")
        again = False
        if not beams.agg(F.sum("told")).first()[0]:
            return beams


def by_rows(rows: DataFrame, work: Callable[[int, dict[int, list[Letter]]], Iterator[tuple]]) -> DataFrame:
    """As ``at_cells``, for rows that each are all that their cell needs."""
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(row for cell, got in mail(source) for row in work(cell, got))

    return rows.mapInArrow(run, ROW)


def nearest(
    df: DataFrame, queries: Column, count: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` selects, its nearest other rows.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors that
    are NULL, zero, or hold a NULL or non-finite component take no part, nor do NULL ids and vectors of
    another length than most; a row given twice is one vector. If there are fewer than ``count`` candidates, all
    are returned. Other columns are ignored; an empty table gives no rows.

    Equal vectors are one node that keeps its ``count + 1`` smallest ids, which is all an answer
    can need, so copies cost nothing in the graph. For unequal norms the graph uses the usual
    extra coordinate that turns inner products into distances. A query starts at its own node and
    follows the graph: the best EXPAND unvisited of its BEAM best nodes hand on their neighbours, until
    no query has an unvisited node in its beam. About PROBES queries are also compared with all nodes; while
    the search finds less than RECALL of their nearest nodes, it goes on with beams two or four times as wide, unless
    that gained less than GAIN. A query that reached fewer nodes than an answer
    needs is compared with all nodes. Answers are ranked by exact scores on the original vectors.
    """
    rows = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    spark = df.sparkSession
    bounded_batches(spark)
    shape = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == shape["d"]).dropDuplicates(["id"])
    # numbers are quicker to sort than vectors; 0.0 and -0.0 are equal
    rows = stage(rows.withColumn("hash", F.xxhash64(F.transform("vector", lambda x: x + 0.0))), "ann-rows")
    first = best(rows, ["hash", "vector"], count + 1, F.col("id"))
    nodes = stage(first.groupBy("hash", "vector").agg(F.sort_array(F.collect_list("id")).alias("copies")).select(
        F.col("copies")[0].alias("node"), "hash", "vector", "copies"), "ann-nodes")
    total, longest = nodes.agg(F.count("*"), F.max(inner("vector", "vector"))).first()
    rest = F.sqrt(F.greatest(F.lit(float(longest)) - inner("vector", "vector"), F.lit(0.0)))

    cells = max(-(-total // CELL), min(CELLS, -(-total // LEAST)))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("node")) - 1
    placed = nodes.withColumn("cell", F.pmod(F.xxhash64("node"), F.lit(cells)).cast("int")).withColumn("place", place)
    placed = stage(placed, "ann-placed")
    stride = 1 << int(placed.agg(F.max("place")).first()[0]).bit_length()
    lay = Layout(cells, stride, shape["d"] + 1, DEGREE)
    coded = placed.withColumn("code", F.col("cell").cast("long") * stride + F.col("place"))
    # copies of a query share its answers, so each node with a query asks once
    homes = coded.select("hash", "vector", F.col("code").alias("q"))
    askers = stage(rows.where("asks").join(homes, ["hash", "vector"]).select("id", "q"), "ann-askers")
    starts = stage(askers.select("q").distinct().join(
        coded.select(F.col("code").alias("q"), "cell", "place", F.col("vector").alias("qv")), "q"), "ann-starts")
    asking = starts.count()
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def pack(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(letter(cell, VECTORS, cell, v, n=len(v)) for cell, _, v in by_cell(source))

    def begin(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, at, v in by_cell(source):
            code = (at + cell * lay.stride).astype(lay.code)[:, None]
            norm = np.einsum("ij,ij->i", v, v).astype(np.float32)[:, None]
            yield from batches([Beams(at.astype(np.int32), code, norm, np.zeros(code.shape, bool)).row(cell)])

    whole = F.concat("vector", F.array(rest)).cast("array<float>")
    vectors = stage(coded.select("cell", "place", whole.alias("v")).repartitionById(
        lay.cells, F.col("cell")).sortWithinPartitions("cell", "place").mapInArrow(pack, ROW), "ann-vectors")
    beams = stage(starts.select("cell", "place", F.col("qv").cast("array<float>").alias("v")).repartitionById(
        lay.cells, F.col("cell")).sortWithinPartitions("cell", "place").mapInArrow(begin, ROW), "ann-beams")
    graph = neighbour_graph(vectors, lay, total)

    def to_all(beams: DataFrame, chosen: Callable[[int, Beams], np.ndarray], keep: int) -> DataFrame:
        called = at_cells(beams.union(vectors), lay, lambda c, g: call(c, g, lay, chosen))
        return at_cells(called.union(vectors), lay, lambda c, g: score(c, g, lay, keep))

    share, stride, needed = max(1, asking // PROBES), lay.stride, min(count + 1, total)
    known = stage(to_all(beams, lambda c, b: mix((b.at + c * stride).astype(np.uint64)) % np.uint64(share) == 0, needed),
                  "ann-known")
    width, before = BEAM, -1.0
    while True:
        beams = search(beams, graph, vectors, lay, width, width * EXPAND // BEAM)
        hits, probed = at_cells(beams.union(known), lay, lambda c, g: compare(c, g, lay, needed)).agg(
            F.sum("n"), F.sum("told")).first()
        found = hits / probed if probed else 1.0
        if found >= RECALL or width >= total or found < before + GAIN:
            break
        width, before = width * (2 if found > 1 - 3 * (1 - RECALL) else 4), found
    keep = max(count + 1, width)
    short = stage(to_all(beams, lambda c, b: (b.code >= 0).sum(axis=1) < needed, keep), "ann-short")
    if not short.isEmpty():
        beams = stage(at_cells(beams.union(short), lay, lambda c, g: settle(c, g, lay, keep, True)), "ann-beams")

    margin = float(longest) * lay.dimension * 2.0 ** -22  # of scores in single precision

    def answers(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, got in mail(source):
            b = Beams.of(got, lay)
            last = b.score[:, min(count, b.score.shape[1] - 1)][:, None]
            row, column = np.nonzero((b.code >= 0) & (b.score >= last - margin))
            yield pa.RecordBatch.from_arrays([
                pa.array((b.at[row] + cell * lay.stride).astype(np.int64)), pa.array(b.code[row, column].astype(np.int64))],
                ["q", "code"])

    pairs = stage(beams.mapInArrow(answers, "q long, code long"), "ann-pairs")
    exact = pairs.join(coded.select("code", "node", "vector", "copies"), "code").join(starts.select("q", "qv"), "q").select(
        "q", "node", "copies", inner("qv", "vector").alias("score"))
    top = best(exact, "q", count + 1, F.desc("score"), F.col("node")).select("q", F.explode("copies").alias("vec_id"), "score")
    answered = askers.join(top, "q").where("id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return answered.withColumn("rank", rank).where(F.col("rank") <= count).select(
        F.col("id").alias("query_id"), "rank", "vec_id", "score")


def by_cell(source: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows ``(cell, place, v)`` in order: each cell with its places and vectors."""
    cell, at, held = None, [], []
    for batch in source:
        cells, where = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else None
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                if held and cells[lo] != cell:
                    yield int(cell), np.concatenate(at), np.concatenate(held)
                    at, held = [], []
                cell = cells[lo]
                at.append(where[lo:hi])
                held.append(v[lo:hi])
    if held:
        yield int(cell), np.concatenate(at), np.concatenate(held)


@query("op1_nn_descent")
def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
