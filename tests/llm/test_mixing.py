import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from carecolumns.llm import mixing


def rows():
    r = random.Random(6)
    out = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 30, 200]))), r.choice(["a", "b", "c", "c", "c", "d", "é", None])) for i in range(900)]
    return [*out, (900, None, "a"), (901, "", "z"), (902, "x\ty\x0bz\xa0q", "b"), (902, "x\ty\x0bz\xa0q", "b"), (None, "one two", "c")]


def test_matches_sql(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.copies(df.withColumn("size", F.lit("clash"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", data)
    want = con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.SQL})").fetchall()
    key = lambda x: (x[0] if x[0] is not None else -1, *x[1:])
    assert [key(x) for x in sorted(map(tuple, got), key=key)] == [key(x) for x in sorted(want, key=key)]


def test_targets_and_closeness(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    out = mixing.copies(df).select("source", "size", "source_size", "target", "copies").collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.copies in (0, 1, 2)
    total = sum(r.size for r in out)
    target = {s: v[0].target for s, v in by.items()}
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for s, v in by.items():
        assert v[0].source_size == sum(r.size for r in v) and target[s] <= 2 * v[0].source_size + 1e-9
        assert abs(sum(r.size * r.copies for r in v) - target[s]) <= 101
    free = [target[s] / w for s, w in zip(sorted((s for s in by if s is not None)) + [None], [5, 2, 1] * 9, strict=False) if target[s] < 2 * by[s][0].source_size - 1e-9]
    assert max(free) == pytest.approx(min(free))


def test_mixed_keeps_columns_and_reruns_agree(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    a, b = mixing.mixed(df), mixing.mixed(df.repartition(7))
    assert a.columns == df.columns
    assert sorted(r.doc_id or -1 for r in a.collect()) == sorted(r.doc_id or -1 for r in b.collect())
    assert mixing.mixed(df.limit(0)).count() == 0


def test_uneven_sources(spark):
    # weights 5, 2, 1 over many sources of like size: some reach their cap, some do not
    rows = [(k * 100 + j, "w " * (20 + (k * 7 + j) % 13), f"s{k:02d}") for k in range(20) for j in range(8)]
    out = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("words"), F.sum(F.col("copies") * F.col("size")).alias("taken")).orderBy("source").collect()
    # the rule itself: cap what is above, reshare the excess by weight, until nothing is above
    weight, total = {r.source: (5, 2, 1)[k % 3] for k, r in enumerate(out)}, 1.5 * sum(r.words for r in out)
    full: set[str] = set()
    while True:
        level = (total - sum(2 * r.words for r in out if r.source in full)) / sum(weight[r.source] for r in out if r.source not in full)
        above = {r.source for r in out if r.source not in full and level * weight[r.source] > 2 * r.words}
        if not above:
            break
        full |= above
    assert 0 < len(full) < 20
    for r in out:
        assert r.target == pytest.approx(2 * r.words if r.source in full else level * weight[r.source])
        assert abs(r.taken - r.target) <= 33


def test_repeated_rows_at_the_cut(spark):
    # one row a hundred times, and clusters of repeated ids of many sizes: as many equal rows are taken as fit
    data = [(1, "w " * 10, "a", 0)] * 100 + [(k, "v " * n, s, 0) for s in ("b", "c") for k, n, m in ((10, 7, 40), (11, 3, 5), (12, 30, 20)) for _ in range(m)]
    data += [(50, "x y z", "d", k) for k in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.copies(df).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")).collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [d[:3] for d in data])
    assert got == sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.SQL})").fetchall())
    by, cuts = defaultdict(int), defaultdict(set)
    for doc, size, _, target, taken in got:
        by[target] += taken
        cuts[doc].add(taken)
    assert len(got) == len(data) and all(abs(taken - target) <= 15 for target, taken in by.items()) and max(map(len, cuts.values())) == 2
    mix = mixing.mixed(df)
    assert mix.schema == df.schema and sorted(r.doc_id for r in mix.collect()) == sorted(doc for doc, size, *_, taken in got for _ in range(taken // size if size else 0))
    assert sorted(map(tuple, mixing.mixed(df).collect())) == sorted(map(tuple, mixing.mixed(df.repartition(3)).collect()))
