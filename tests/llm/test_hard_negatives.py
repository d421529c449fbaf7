import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from carecolumns.llm import hard_negatives as mining


def test_strassen_is_exact():
    r = np.random.default_rng(1)
    for sides in ((33, 64, 70), (17, 5, 300), (100, 101, 99), (1, 64, 9), (64, 1, 64), (0, 4, 5), (40, 0, 40), (130, 64, 257)):
        for size in (300, 2**40, 2**62):  # beyond 2^63 products are taken modulo 2^64
            a, b = r.integers(-300, 300, sides[:2]), r.integers(-size, size, sides[1:])
            assert (mining.strassen(a, b, 4) == a @ b).all() and (mining.strassen(a, b) == a @ b).all()


def test_heaps_merge_in_any_order():
    r = random.Random(2)
    rows = [(r.randrange(7), i, r.randrange(-5, 5)) for i in range(300)]
    whole = mining.Heap(7, 4)
    for k in range(0, 300, 23):
        part = np.array(rows[k : k + 23])
        whole.push(part[:, 0], part[:, 1], part[:, 2])
    got = sorted(zip(whole.key.tolist(), (-whole.score).tolist(), whole.id.tolist(), strict=True))
    want = []
    for key in range(7):
        want += [(key, -s, i) for s, i in sorted(((s, i) for k, i, s in rows if k == key), key=lambda x: (-x[0], x[1]))[:4]]
    assert got == sorted(want)


def plain(rows, k=5, m=3):
    rows = {i: ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=False))
    out = []
    for a in (i for i in rows if i % 50 == 0):
        order = sorted((i for i in rows if i != a), key=lambda i: (-score(a, i), i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:k]:
            s = score(a, p)
            found = [n for n in order if rows[n][0] != rows[a][0] and 50 * s <= 100 * score(a, n) <= 95 * s][:m]
            out += [(a, p, rank, n, s, score(a, n)) for rank, n in enumerate(found, 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("sizes", [(1024, 32_768, 64, 1024), (2, 16, 3, 7)])
def test_against_a_plain_version(spark, monkeypatch, sizes):
    for name, value in zip(("ANCHORS", "CANDIDATES", "STRIPES", "STEP"), sizes, strict=True):
        monkeypatch.setattr(mining, name, value)
    r = np.random.default_rng(7)
    # a label of a third of all rows, many equal vectors, small numbers for ties
    rows = [(i, 1 if r.random() < 0.33 else int(r.integers(0, 6)), (r.integers(-2, 3, 9) / 8).tolist()) for i in range(-60, 420)]
    rows[5:120] = [(i, label, [0.25] * 9) for i, label, _ in rows[5:120]]
    df = spark.createDataFrame([(i, label, v, 1, {"a": 1}) for i, label, v in rows], "vec_id long, label int, embedding array<float>, anchor_id int, v map<string,int>")
    got = sorted(tuple(x[c] for c in COLUMNS) for x in mining.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())
    want = plain(rows)
    assert got == want and len(want) > 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 1.0]), (2, 2, [1.0]), (3, 2, [0.5, 0.5, 9.0]), (4, 2, None), (5, None, [1.0, 1.0]), (6, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [None, 1.0]), (None, 1, [9.0, 9.0]), (10, 2, []), (1, 1, [1.0, 1.0]), (3, 2, [0.75, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    # row 0 has label 2 then; its positives are 2, 3 (the least of its vectors) and 10, its negatives rows of label 1
    got = sorted(tuple(x[c] for c in COLUMNS) for x in mining.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())
    want = plain([(0, 1, [1.0, 0.5]), (1, 1, [1.0, 1.0]), (2, 2, [1.0]), (3, 2, [0.5, 0.5, 9.0]), (10, 2, [])])
    assert got == want
    assert mining.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({mining.SQL})").fetchall()
    got = mining.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(want)
