"""Work and recall of the neighbour search: rows per cell, beams as wide as recall asks for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from starwright.llm import nn_descent
from starwright.llm.nn_descent import nearest


def frame_of(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def found(frame, v, count, queries):
    got = {}
    for r in nearest(frame, F.col("vec_id").isin(queries), count).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in queries:
        score = v @ v[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-score)[:count].tolist()))
    return hit / len(queries) / count


def test_beams_widen_until_the_probes_are_found(spark, monkeypatch):
    # directions without any structure on a poor graph: a narrow beam finds about half
    for name, value in (("DEGREE", 10), ("REVERSE", 10), ("BEAM", 24), ("EXPAND", 6)):
        monkeypatch.setattr(nn_descent, name, value)
    v = np.random.default_rng(5).normal(size=(2500, 40))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert found(frame_of(spark, v), v, 20, list(range(0, 2500, 25))) >= 0.9


def test_lists_of_neighbours_are_a_row_per_cell(spark, monkeypatch):
    """No row per pair or per member of a group passes between the rounds."""
    staged, stage = [], nn_descent.stage

    def counted(df, label):
        out = stage(df, label)
        if label not in ("ann-rows", "ann-nodes", "ann-placed", "ann-askers", "ann-starts", "ann-pairs"):
            staged.append((label, out.count()))
        return out

    monkeypatch.setattr(nn_descent, "stage", counted)
    v = np.random.default_rng(6).normal(size=(1000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert found(frame_of(spark, v), v, 10, [3, 5, 999]) >= 0.9
    assert len(staged) > 4 and max(n for _, n in staged) < 300, staged


def test_old_members_do_not_meet_again():
    lay = nn_descent.Layout(cells=2, stride=4, dimension=2, degree=2)
    v = np.array([[1, 0], [0.9, 0.1], [0.8, 0.2], [0.1, 0.9]], np.float32)

    def sent(news):
        index = np.array([[0, 1, 2, 3]], np.int32)
        rows = [nn_descent.letter(0, nn_descent.MEMBERS, 0, index, np.array([news]), np.array([0, 1, 2, 4], np.int32), n=4),
                nn_descent.letter(0, nn_descent.VECTORS, 0, v[:3], np.full(3, -9, np.float32)),
                nn_descent.letter(0, nn_descent.VECTORS, 1, v[3:], np.full(1, -9, np.float32))]
        (_, got), = nn_descent.mail(nn_descent.batches(rows))
        pairs = set()
        for cell, _, _, _, _, at, to, *_ in nn_descent.introduce(0, got, lay, 12):
            pairs |= set(zip((np.frombuffer(at, np.int32) + cell * 4).tolist(), np.frombuffer(to, np.int32).tolist()))
        return pairs

    assert sent([False, False, False, False]) == set()
    assert sent([False, False, False, True]) == {(0, 4), (1, 4), (2, 4), (4, 0), (4, 1), (4, 2)}
    assert len(sent([True, True, False, False])) == 10
