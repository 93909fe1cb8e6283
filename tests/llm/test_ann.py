import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann
from palimpsest.llm.ann import Centroids, nearest, op6_nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, asked):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(np.float64)
            good[i] = min(good[i], v, key=tuple) if i in good else v
    ids = sorted(good)
    x = np.array([good[i] for i in ids]) if ids else np.empty((0, 1))
    out = {}
    for i in ids:
        if asked(i):
            s = (x * good[i]).sum(axis=1)
            out[i] = [(v, a) for a, v in sorted((-a, v) for a, v in zip(s, ids, strict=True) if v != i)[:k]]
    return out


def test_all_lists_give_exact_results(spark, sf_dir):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [None, *rows[1][1][1:]]), (2004, [float("nan")] * 8), (2005, [float("inf"), *[0.0] * 7]), (None, rows[3][1]), (20, rows[20][1]), (40, [9.0] * 8), (2006, [-0.0, *rows[7][1][1:]]), (2007, [x * 100 for x in rows[9][1]])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows] + [(2020, [1.0, 2.0], 0)], SCHEMA)
    out = op6_nearest(spark, sf_dir(embeddings=frame)).collect()
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert {x.query_id for x in out} == want.keys()
    for q, found in want.items():
        got = sorted((x["rank"], x.vec_id, x.score) for x in out if x.query_id == q)
        assert [g[0] for g in got] == list(range(1, 21))
        assert [g[1] for g in got] == [v for v, _ in found] and np.allclose([g[2] for g in got], [-a for _, a in found])


@pytest.mark.parametrize("part_rows", [1 << 16, 20])
def test_recall(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ann, "PART_ROWS", part_rows)
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 24))
    x = centers[r.integers(0, 12, 3000)] + 0.7 * r.normal(size=(3000, 24))
    x *= r.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    out = nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, 20, list_rows=20).collect()
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = {}
    for a in out:
        got.setdefault(a.query_id, set()).add(a.vec_id)
    assert all(len(v) == 20 for v in got.values())
    recall = np.mean([len(got[q] & {v for v, _ in f}) / 20 for q, f in want.items()])
    assert recall > 0.93


def test_graph_search():
    r = np.random.default_rng(3)
    c = Centroids(r.normal(size=(4000, 16)), 8.0, 20)
    assert 200 <= len(c.points) <= 512
    q = c.direction(r.normal(size=(200, 16)))
    ids, dist = c.search(q, 10)
    exact = np.argsort(c._distance(q), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, exact, strict=True)]) > 0.95
    assert (np.diff(dist, axis=1) >= 0).all()


def test_few(spark):
    make = lambda rows: sorted(tuple(x) for x in nearest(spark.createDataFrame(rows, SCHEMA), F.lit(True)).collect())
    assert make([]) == [] and make([(1, [1.0, 0.0], 0)]) == []
    assert make([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 2.0], 0)]) == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]


def test_no_cap_on_vectors_without_clusters(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    # 512 lists, far more than MOST_LISTS
    out = nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 80 == 0, 20, list_rows=8).collect()
    want = brute(rows, 20, lambda i: i % 80 == 0)
    assert {q: [v for v, _ in f] for q, f in want.items()} == {q: [a.vec_id for a in sorted(out, key=lambda a: a["rank"]) if a.query_id == q] for q in want}


@pytest.mark.parametrize("list_rows", [200, 5])
def test_ties_go_to_smaller_ids(spark, list_rows):
    """Different vectors of equal score: the ids decide, however many they are."""
    rows = [(i, [1.0, float(i), 0.0]) for i in range(1, 200)] + [(0, [5.0, 0.0, 0.0]), (1000, [0.5, 0.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = nearest(frame, F.col("vec_id") == 0, 20, list_rows=list_rows, most_lists=0).collect()
    assert [a.vec_id for a in sorted(out, key=lambda a: a["rank"])] == list(range(1, 21)) and {a.score for a in out} == {5.0}


def test_long_vectors_do_not_flatten_the_index(spark):
    r = np.random.default_rng(7)
    centers = r.normal(size=(12, 24))
    x = centers[r.integers(0, 12, 3000)] + 0.5 * r.normal(size=(3000, 24))
    x[17] *= 1e5
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    out = nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, 20, list_rows=20).collect()
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = {}
    for a in out:
        got.setdefault(a.query_id, set()).add(a.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in f}) / 20 for q, f in want.items()]) > 0.93
    assert all((17 in {v for v, _ in f}) == (17 in got[q]) for q, f in want.items())


def test_lengths_beyond_double_precision(spark):
    rows = [(i, [1.0, float(i % 7), 2.0], 0) for i in range(60)] + [(100, [1e200, 1.0, 1.0], 0), (120, [-1e200, 1.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = nearest(frame, F.col("vec_id") % 20 == 0, 3).collect()
    first = {a.query_id: a.vec_id for a in out if a["rank"] == 1}
    assert len(out) == 5 * 3 and all(first[q] == 100 for q in (0, 20, 40)) and 120 not in {a.vec_id for a in out if a.query_id < 60}
