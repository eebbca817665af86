"""Nearest neighbours: recall, exact scores and ties."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratavec.llm import neighbours as N

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 16]
    out = {}
    for i, v in good:
        if i % every == 0:
            s = sorted((-float(N.exact_scores(v[None], w[None])[0]), j) for j, w in good if j != i)
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def test_recall_scores_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 32)
    monkeypatch.setattr(N, "BLOCK", 64)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2000)]
    same = rows[7][1]
    rows += [(2000 + i, same) for i in range(700)]
    rows += [(3000, None), (3010, []), (3020, [0.0] * 16), (3030, [math.nan] + [1.0] * 15), (3040, [None] + [1.0] * 15), (3050, [math.inf] + [1.0] * 15), (3060, [1.0] * 4), (None, same)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS).withColumn("rank", F.lit(0)).withColumn("score", F.lit("x"))
    got = {}
    for r in N.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute(rows, 5, 50)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    for q, found in got.items():
        truth = dict(brute([r for r in rows if r[0] in {q, *(j for j, _ in found)}], 5, 1)[q])
        assert all(truth[j] == s for j, s in found)
    assert got[2050] == [(j, got[2050][0][1]) for j in (7, 2000, 2001, 2002, 2003)]


def test_copies_of_an_id_take_one_place():
    x = np.array([[0.9, 0.436]] * 5 + [[0.8, 0.6], [0.7, 0.714]])
    q_ids, q = np.array([0]), np.array([[1.0, 0.0]])
    got = N._nearest(q_ids, q, np.array([1, 1, 1, 1, 1, 2, 3]), x, 2)
    assert got[1].tolist() == [1, 2]
    assert N._nearest(q_ids, q, np.array([1, 1, 1, 1, 1, 2, 3]), x, 5)[1].tolist() == [1, 2, 3]
    mixed = np.array([[0.9, 0.1], [0.5, 0.5], [0.8, 0.3], [0.9, 0.2], [0.7, 0.4]])
    assert N._nearest(q_ids, q, np.array([4, 4, 2, 4, 3]), mixed, 3)[1].tolist() == [4, 2, 3]


def test_repeated_rows_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 32)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)], 0) for i in range(600)]
    once = N.search(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    many = spark.createDataFrame(rows * 2 + rows[:60] * 20, ROWS)
    again = N.search(many, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    assert len(once) == 150 and again == once


def test_rows_of_one_id_that_differ_leave_room(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(0, base.tolist(), 0)] + [(1, (base + rng.normal(size=8) * 0.01).tolist(), 0) for _ in range(500)] + [(i, (base + rng.normal(size=8)).tolist(), 0) for i in range(2, 40)]
    got = [r.vec_id for r in N.search(spark.createDataFrame(rows, ROWS), F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    score = lambda v: float(N.exact_scores(np.float32(base)[None].astype(float), np.float32(v)[None].astype(float))[0])
    best = sorted(range(2, 40), key=lambda i: -score(rows[499 + i][1]))
    assert got == [1, *best[:4]]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 0.5], 0)], ROWS)
    got = [(r.rank, r.vec_id) for r in N.search(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 1)]
    assert N.search(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c = N._unit(rng.normal(size=(300, 8)))
    q = N._unit(rng.normal(size=(50, 8)))
    dist = np.sqrt(np.maximum(2 - 2 * (q @ c.T), 0))
    found = N.walk(q, c, N.centroid_graph(c), 1.2, 10)
    assert np.mean([ids[0] == d.argmin() for (ids, _), d in zip(found, dist)]) > 0.95
    share, wrong = [], 0
    for (ids, far), d in zip(found, dist):
        assert np.allclose(far, d[ids]) and np.all(np.diff(far) >= 0)
        within = set(np.flatnonzero(d <= 1.2 * d.min()).tolist()) | set(np.argsort(d)[:10].tolist())
        share.append(len(within & set(ids.tolist())) / len(within))
    assert np.mean(share) > 0.95
    assert all(sorted(ids.tolist()) == list(range(300)) for ids, _ in N.walk(q, c, N.centroid_graph(c), 1.0, 300))


def test_the_walk_prunes():
    rng = np.random.default_rng(3)
    centres = N._unit(rng.normal(size=(40, 32)))
    c = N._unit(np.repeat(centres, 50, 0) + 0.02 * rng.normal(size=(2000, 32)))
    looked = []
    real = np.einsum
    q = N._unit(c[::100] + 0.01 * rng.normal(size=(20, 32)))
    try:
        np.einsum = lambda f, a, b: (looked.append(len(a)), real(f, a, b))[1]
        found = N.walk(q, c, N.centroid_graph(c), 1.3, 16)
    finally:
        np.einsum = real
    assert sum(looked) < 0.25 * len(q) * len(c)
    assert np.mean([ids[0] == np.argmax(v @ c.T) for (ids, _), v in zip(found, q)]) > 0.8


def test_two_levels(spark, monkeypatch):
    for name, value in (("LIST_ROWS", 16), ("MAX_LISTS", 16), ("BLOCK", 100)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16)) * 3
    rows = [(i, (centres[i % 60] + rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    got = {}
    for r in N.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute(rows, 5, 50)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & {j for j, _ in expected[q]}) for q in expected) >= 0.9 * 5 * len(expected)


def test_one_id_in_the_way(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 16)
    monkeypatch.setattr(N, "LEAST", 2)
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(0, base.tolist())] + [(1, (base + rng.normal(size=8) * 0.001).tolist()) for _ in range(600)] + [(i, (-base + rng.normal(size=8) * 0.1).tolist()) for i in range(2, 400)]
    got = N.search(spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    u = [np.float32(v).astype(float) for _, v in rows]
    best = sorted(range(2, 400), key=lambda i: -float(N.exact_scores(u[0][None], u[599 + i][None])[0]))
    assert [r.vec_id for r in got] == [1, *best[:4]]


def test_other_lengths_and_magnitudes(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)] + [(100 + i, [1.0, float(i)]) for i in range(4)] + [(200, [5.0])]
    rows += [(300, [1e200, 1e200, 0.0, 0.0]), (301, [1e-200, 1e-200, 1e-200, 0.0]), (302, [1e-320, 1e-320, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in N.search(df, F.lit(True), 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got[100]] == [101, 102, 103] and 200 not in got
    assert all(len(got[i]) == 5 and all(math.isfinite(s) for _, s in got[i]) for i in (*range(50), 300, 301, 302))
    assert got[300][0] == (302, 1.0) or abs(got[300][0][1] - 1) < 1e-12
    plain = lambda v, w: sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w))
    vectors = dict(rows)
    for q in range(50):
        truth = sorted(((plain(vectors[q], vectors[j]), j) for j in range(50) if j != q), reverse=True)[:3]
        assert [round(s, 9) for i, s in got[q] if i < 50][:3] == [round(s, 9) for s, _ in truth][: len([1 for i, _ in got[q] if i < 50][:3])]


def test_balanced_lists():
    rng = random.Random(3)
    x = N._unit(np.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(1000)]))
    c = N.balanced_centroids(x, 16, rounds=0)
    assert len(c) == 16
