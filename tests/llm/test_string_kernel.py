"""Language identification: grams and kernels by hand, odd rows, held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starwright.llm import string_kernel as sk

SCHEMA = "doc_id long, text string, lang string, source string, score string, lang_pred int, bits string"


def grams(text: str) -> set[int]:
    body = b" " + sk.raw(text) + b" "
    return {(int.from_bytes(body[i:i + n], "big") * int(sk.ODD[n]) % 2**32) >> (32 - sk.BITS)
            for n in range(1, sk.SPECTRUM + 1) for i in range(len(body) - n + 1)}


def sets(texts):
    return [set(map(int, np.flatnonzero(row))) for flags in sk.presence(texts) for row in flags]


def test_presence_is_the_set_of_grams(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", None, "ÀÉ中😀", "x\ny 12", " ", "\x00"] + [
        "".join(rng.choices("abc é中\n!Z", k=rng.randrange(400))) for _ in range(150)]
    want = [grams(t or "") for t in texts]
    assert sets(texts) == want
    for size in (5, 64, 700):  # long texts in pieces hold the same grams
        monkeypatch.setattr(sk, "PIECE_BYTES", size)
        assert sets(texts) == want


def test_margins_are_kernel_values_times_ridge_weights():
    rng = random.Random(5)
    texts = ["".join(rng.choices(alphabet, k=60)) for alphabet in ("abcd ", "cdef ", "xyz ") for _ in range(20)]
    langs = [lang for lang in "pqr" for _ in range(20)]
    order = rng.sample(range(60), 60)
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    bits = [np.packbits(row).tobytes() for flags in sk.presence(texts) for row in flags]
    model = sk.fit(bits, langs, landmarks=30)
    held = [grams(t) for t in texts]

    def kernel(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    marks = held[:30]
    full = np.array([[kernel(a, b) for b in marks] for a in held])
    values, vectors = np.linalg.eigh(full[:30])
    kept = values > 1e-6 * values[-1]
    phi = np.hstack([full @ vectors[:, kept] / np.sqrt(values[kept]), np.ones((60, 1))])
    target = np.array([[1.0 if lang == name else -1.0 for name in "pqr"] for lang in langs])
    ridge = sk.RIDGE * 60 * np.diag([*[1.0] * kept.sum(), 0.0])
    want = phi @ np.linalg.solve(phi.T @ phi + ridge, phi.T @ target)
    got = np.concatenate([model.margins(flags) for flags in sk.presence(texts)])
    assert np.allclose(got, want, atol=1e-3)
    assert [model.langs[k] for k in got.argmax(1)] == langs


def asked(docs, **kw):
    got = sk.identify_language(docs, **kw)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    return {(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in got.collect()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(7)
    words = {"aa": "the and of with that this from".split(), "bb": "der und die nicht das ist ein".split()}
    return [(i, " ".join(rng.choices(words[lang], k=30)), lang, "s", "x", 1, "y") for i in range(120)
            for lang in [("aa", "bb")[i % 2]]]


def test_odd_rows(spark, spoken):
    odd = [(None, "the of and", "bb", None, None, None, None), (500, None, "aa", "s", "x", 1, "y"), (501, "", "aa", "s", "x", 1, "y"),
           (502, " 12 ?!\n", "aa", "s", "x", 1, "y"), (503, "und nicht " * 60000, None, "s", "x", 1, "y"),
           (504, "中文", None, "s", "x", 1, "y"), (1, spoken[1][1], "bb", "s", "x", 1, "y")]
    docs = spark.createDataFrame(spoken + odd, SCHEMA).repartition(7)
    got = asked(docs)
    by_id = {r[0]: r for r in got}
    assert {by_id[i][2:] for i in (500, 501, 502)} == {("und", 0.0)}
    assert by_id[None][1:3] == (False, "aa") and by_id[503][2] == "bb" and by_id[504][2] in ("aa", "bb")
    assert all(0 <= r[3] <= 1 for r in got)
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == "bb" for r in sk.identify_language(docs).where("doc_id = 1").collect()) == 2


def test_labels_of_held_out_rows_never_teach(spark, spoken):
    docs = spark.createDataFrame(spoken, SCHEMA)
    other = docs.withColumn("lang", F.when(sk.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert asked(docs) == asked(other) == asked(docs.withColumn("source", F.lit(None).cast("string")).repartition(11))


def test_nothing_to_learn_from(spark, spoken):
    docs = spark.createDataFrame(spoken, SCHEMA)
    assert {r[2:] for r in asked(docs.withColumn("lang", F.lit(None).cast("string")))} == {("und", 0.0)}
    assert {r[2:] for r in asked(docs.where("lang = 'aa'"))} == {("aa", 1.0)}
    assert asked(docs.limit(0)) == set()


def test_bounds_of_the_sample(spark, spoken):
    docs = spark.createDataFrame(spoken, SCHEMA)
    model = sk.train(docs.unionByName(docs), max_docs=10, max_langs=1)
    assert model.langs == ["aa"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = sk.identify_language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98
