"""Ranked lexical search against brute force over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from starwright.llm import lemp

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLDED = str.maketrans(lemp.UPPER, lemp.LOWER)
DOCS = "doc_id long, text string, lang string, rank int, score string, ids string, length int"
ITEMS = "item_id long, text string, rank int, doc_id string"


def words(text):
    return TERM.findall((text or "").translate(FOLDED))


def brute_force(docs, items, count=50):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, all_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for key, text in items:
        wanted[key].update(words(text))
    out = []
    for key, terms in wanted.items():
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(key, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:count], 1)]
    return sorted(out, key=repr)


def made(spark, docs, items, **kw):
    docs = spark.createDataFrame([(i, t, "en", 1, "x", "y", 2) for i, t in docs], DOCS).repartition(5)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS).repartition(3)
    got = lemp.ranked_search(docs, items, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(seed, rows, items):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé中9", k=rng.randrange(1, 6))) for _ in range(120)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    docs = [(i, text(rng.randrange(1, 60))) for i in range(rows)]
    return docs, [(i, text(rng.randrange(1, 15)).upper()) for i in range(items)]


@pytest.mark.parametrize("first, growth", [(20_000, 16), (5, 2), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, first, growth):
    monkeypatch.setattr(lemp, "FIRST_ROWS", first)
    monkeypatch.setattr(lemp, "GROWTH", growth)
    docs, items = corpus(first, 900, 25)
    copies = [(10_000 + i, docs[3][1]) for i in range(400)]  # a third of the rows are one text
    assert made(spark, docs + copies, items, count=7) == brute_force(docs + copies, items, 7)


def test_blocks_of_items(spark):
    docs, items = corpus(2, 200, 30)
    assert made(spark, docs, items, count=5, block_terms=120) == brute_force(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha"), (5, "alpha " * 200000),
            (6, "É é ALPHA{9}x"), (7, "beta\x00gamma"), (8, "b" * 3_000_000 + " gamma")]
    items = [(1, "alpha"), (1, "BETA beta"), (None, "gamma é 9"), (2, None), (3, "..."), (4, "nowhere"), (5, "É x")]
    assert made(spark, docs, items) == brute_force(docs, items)


def test_empty_tables(spark):
    assert made(spark, [], [(1, "a")]) == made(spark, [(1, "a")], []) == made(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("seed", range(6))
def test_buckets_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    vocabulary, rows, count = 60, 700, 9
    weights = rng.integers(0, 9000, vocabulary)
    terms = [rng.choice(vocabulary, rng.integers(1, 20), replace=False) for _ in range(12)]
    terms = [t[weights[t] > 0] for t in terms]
    items = lemp.Items(list(range(12)), [t[np.argsort(-weights[t])] for t in terms], weights)
    vectors = [(np.flatnonzero(rng.random(vocabulary) < rng.random() * 0.5), None) for _ in range(rows)]
    vectors = [(t, rng.integers(1, 1_000_000, len(t))) for t, _ in vectors]
    lengths = np.array([math.sqrt(sum(weights[t] * x.astype(float) ** 2)) for t, x in vectors])
    order = np.argsort(-lengths)
    best = lemp.Best(np.ones(12), count)
    for at in range(0, rows, 50):
        some = order[at:at + 50]
        lemp.search_bucket(
            items, best, some.astype(np.int64), lengths[some], np.concatenate([vectors[i][0] for i in some]),
            np.array([len(vectors[i][0]) for i in some]), np.concatenate([vectors[i][1] for i in some]).astype(np.int64))
    for item, wanted in enumerate(items.terms):
        full = sorted((-sum(int(weights[t]) * int(x) for t, x in zip(*v) if t in set(wanted)), i) for i, v in enumerate(vectors))
        want = [(-s, i) for s, i in full if s < 0][:count]
        assert want == ([] if not best.held[item] else list(zip(*map(lambda a: a.tolist(), best.cut(item)))))


def test_short_vectors_are_not_read(spark, monkeypatch):
    """Once floors are known, rounds end before the shortest vectors."""
    monkeypatch.setattr(lemp, "FIRST_ROWS", 50)
    seen = []
    plain = lemp.search
    monkeypatch.setattr(lemp, "search", lambda rows, *rest: seen.append(rows.count()) or plain(rows, *rest))
    rich = [(i, "rare words here together") for i in range(60)]
    poor = [(1000 + i, "filler " * 40 + "words" * (i % 2)) for i in range(600)]
    got = made(spark, rich + poor, [(1, "rare words here together")], count=5)
    assert got == brute_force(rich + poor, [(1, "rare words here together")], 5)
    assert sum(seen) < 300
