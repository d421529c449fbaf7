import numpy as np
from pyspark.sql import functions as F

from carecolumns.llm import permutation_index as index


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        ok = ids != q
        best = np.lexsort((ids[ok], -s[ok]))[:k]
        out[q] = [(int(i), float(v)) for i, v in zip(ids[ok][best], s[ok][best], strict=True)]
    return out


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(5)
    for n in (300, 1500, 6000):
        x = rng.normal(size=(n, 32)).astype(np.float32).astype(float)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {}
        for r in index.nearest(df, F.col("vec_id") % 60 == 0, 20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        want = brute(np.arange(n), x, range(0, n, 60), 20)
        assert all(len(got[q]) == 20 for q in want) and sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_footrule():
    rng = np.random.default_rng(2)
    mine, theirs = (np.array([rng.permutation(40)[:12] for _ in range(n)], np.int16) for n in (50, 9))
    saved = index.footrule_saved(mine, theirs, 40)
    for i, a in enumerate(mine.tolist()):
        for j, b in enumerate(theirs.tolist()):
            assert saved[i, j] == sum(12 - abs(a.index(p) - b.index(p)) for p in a if p in b)


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(index, "SPLIT", 200)
    monkeypatch.setattr(index, "BLOCK", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 64))
    x = centres[rng.integers(0, 10, 3000)] * rng.choice([0, 0.15, 1], 3000)[:, None] + rng.normal(size=(3000, 64))
    x[5:900] = x[5]  # a very common vector
    x = x.astype(np.float32).astype(float)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in index.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, x, ids[::20], 20)
    hit = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [r for r, _, _ in g] == list(range(1, 21)) and all(v != q for _, v, _ in g)
        assert [(-s, v) for _, v, s in g] == sorted((-s, v) for _, v, s in g)
        assert all(np.isclose(s, x[v] @ x[q], rtol=1e-12) for _, v, s in g)
        hit += len({v for _, v, _ in g} & {v for v, _ in w})
    assert hit >= 0.9 * 20 * len(want)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [9.0, 9.0]), (20, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in index.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 8, 2.0), (0, 2, 8, 2.0), (0, 3, 1, 0.5), (0, 4, 7, -1.0)]
    assert index.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
