from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starwright.operators import gram_index, matching
from starwright.operators.matching import cosine_matches, resolve_names

CANON = ["Police Department", "Fire Department", "Streets & Sanitation", "Water Management", "OEMC"]


def grams(text):
    out = Counter()
    for word in text.lower().split():
        w = f" {word} "
        out.update(w[i:i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))
    return out


def brute_force(names, canon, threshold):
    """All pairs by the definition, on a small fixture."""
    docs = {c: grams(c) for c in set(canon)}
    df = Counter(g for d in docs.values() for g in d)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(counts):
        v = {g: n * idf[g] for g, n in counts.items() if g in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()}

    vectors = {c: unit(d) for c, d in docs.items()}
    found = {}
    for name in set(names):
        a = unit(grams(name))
        for c, b in vectors.items():
            s = sum(w * b.get(g, 0.0) for g, w in a.items())
            if s >= threshold:
                found[name, c] = s
    return found


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_pairs_equal_brute_force(spark, threshold):
    names = ["POLCE DEPT", "Police  Department", "Fire Dept", "water managment", "STREETSAN", "Streets Sanitation",
             "OEMC Office", "zzz", "Department", "Fire Fire Department", *CANON]
    got = {(r.name, r.canonical): r.similarity for r in cosine_matches(
        frame(spark, names, "n"), "n", frame(spark, CANON, "c"), "c", threshold).collect()}
    assert got == pytest.approx(brute_force(names, CANON, threshold))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc ", min_size=2, max_size=12).filter(str.strip), min_size=2, max_size=8))
def test_random_texts_equal_brute_force(spark, texts):
    got = {(r.name, r.canonical): r.similarity for r in cosine_matches(
        frame(spark, texts, "n"), "n", frame(spark, texts[:4], "c"), "c", 0.5).collect()}
    want = brute_force(texts, texts[:4], 0.5)
    near = {k for k, s in want.items() if abs(s - 0.5) < 1e-9}
    assert set(got) - near == set(want) - near


def test_lookup_first_then_cosine(spark):
    names = ["police department ", "CPD", "Police Departmnt", "nothing alike", None]
    aliases = spark.createDataFrame([("cpd", "Police Department")], "alias string, canonical string")
    got = {r.name: (r.canonical, r.method) for r in resolve_names(
        frame(spark, names, "n"), "n", frame(spark, CANON, "c"), "c", aliases, 0.7).collect()}
    assert got == {
        "police department ": ("Police Department", "MASTER"), "CPD": ("Police Department", "MASTER"),
        "Police Departmnt": ("Police Department", "COSINE"), "nothing alike": ("nothing alike", "UNMATCHED")}
    left_out = resolve_names(frame(spark, ["qqq"], "n"), "n", frame(spark, CANON, "c"), "c", unmatched="skip")
    assert left_out.count() == 0
    with pytest.raises(Exception):
        resolve_names(frame(spark, ["qqq"], "n"), "n", frame(spark, CANON, "c"), "c", unmatched="error").collect()


def test_candidates_stay_near_the_matches(spark):
    """Names of disjoint topics that share a common last word: few pairs beyond the matches."""
    from starwright.operators import matching

    topics = spark.range(40).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("t"), "id")
    canon = topics.select(F.concat("t", F.lit(" company")).alias("c"))
    names = topics.select(F.explode(F.array(
        F.concat("t", F.lit(" company")), F.concat("t", F.lit(" company inc")))).alias("n"))
    left, right = matching.distinct_texts(names, "n"), matching.distinct_texts(canon, "c")
    found = matching.candidate_pairs(*matching.vectors(left, right), 0.85).count()
    matches = cosine_matches(names, "n", canon, "c").count()
    assert 40 <= matches <= found <= 2 * matches


def test_learned_aliases_are_not_matched_again(spark, tmp_path, monkeypatch):
    from starwright.operators import matching

    path, canon = str(tmp_path / "aliases"), frame(spark, CANON, "c")
    first = frame(spark, ["POLICE DEPARTMENTS", "oemc", "zzz", None, "POLICE DEPARTMENTS"], "n")
    once = {x.name: (x.canonical, x.method) for x in matching.resolve_and_learn(
        first, "n", canon, "c", path, 0.7).collect()}
    assert once == {"POLICE DEPARTMENTS": ("Police Department", "COSINE"), "oemc": ("OEMC", "MASTER"),
                    "zzz": ("zzz", "UNMATCHED")}
    assert [x.alias for x in spark.read.parquet(path).collect()] == ["police departments"]

    def forbidden(*_):
        raise AssertionError("known names were matched again")

    with monkeypatch.context() as m:
        m.setattr(matching, "cosine_matches", forbidden)
        again = matching.resolve_and_learn(
            frame(spark, [" Police Departments ", "POLICE DEPARTMENTS"], "n"), "n", canon, "c", path, 0.7).collect()
    assert {(x.name, x.canonical, x.method) for x in again} == {
        (" Police Departments ", "Police Department", "ALIAS"), ("POLICE DEPARTMENTS", "Police Department", "ALIAS")}
    # an alias of a name that is gone, or less sure than now asked, does not count
    less = matching.resolve_and_learn(
        first, "n", frame(spark, ["Fire Department"], "c"), "c", path, 0.99, "skip").collect()
    assert less == []
    mixed = matching.resolve_and_learn(
        frame(spark, ["POLICE DEPARTMENTS", "Fire Departments"], "n"), "n", canon, "c", path, 0.7)
    assert {(x.name, x.method) for x in mixed.collect()} == {
        ("POLICE DEPARTMENTS", "ALIAS"), ("Fire Departments", "COSINE")}
    assert spark.read.parquet(path).count() == 2


ODD = ["  Police\tDepartment\n", "Police Department", "ÇA VA Straße 😀 İi", "ça va straße 😀 i̇i", "a b", "a", "",
       "  ", "x" * 300 + " police", "Water Management\r\nWater Management", "police department fire department"]


def test_index_makes_no_pairs_of_rows(spark, monkeypatch):
    """Long texts share common grams with all canonical ones, so their pairs must not become rows."""
    def forbidden(*args):
        raise AssertionError("pairs of rows")

    monkeypatch.setattr(matching, "candidate_pairs", forbidden)
    long = " ".join(CANON) + " the fire of the police and the water "
    names = [*ODD, long * 3, *CANON]
    got = {(r.name, r.canonical): r.similarity for r in cosine_matches(
        frame(spark, [*names, None, *CANON], "n"), "n", frame(spark, [*CANON, *ODD, None], "c"), "c", 0.4).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(matching, "INDEX_CHARS", 0)
    joined = {(r.name, r.canonical): r.similarity for r in cosine_matches(
        frame(spark, names, "n"), "n", frame(spark, [*CANON, *ODD], "c"), "c", 0.4).collect()}
    assert got == pytest.approx(joined) and len(got) > len(CANON)


def test_index_in_small_steps(monkeypatch):
    """Slices of texts, of characters and of lists give the same similarities."""
    docs = [grams(c) for c in CANON]
    known = sorted({g for d in docs for g in d})
    of_gram, of_text, weight = zip(*[(known.index(g), i, 0.1 * n) for i, d in enumerate(docs) for g, n in d.items()])
    index = gram_index.GramIndex(known, np.ones(len(known)), np.array(of_gram), np.array(of_text), np.array(weight), len(CANON))
    texts = [t.lower() for t in [*CANON, "fire police water management " * 20, "zzz", ""]]

    def found():
        return {(first + int(p), int(b)): s for first, end in index.slices(texts)
                for p, b, s in zip(*index.matches(texts[first:end], index.codes(), 0.01))}

    whole = found()
    monkeypatch.setattr(gram_index, "SLICE_CHARS", 7)
    monkeypatch.setattr(gram_index, "CELLS", 3)
    assert found() == pytest.approx(whole) and {(i, i) for i in range(len(CANON))} <= set(whole)


def test_no_canonical_texts(spark):
    assert cosine_matches(frame(spark, ["a"], "n"), "n", frame(spark, [None, ""], "c"), "c").count() == 0
