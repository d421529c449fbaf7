"""The as-of join and interpolation against plain loops, with odd rows; its time on one key."""

import random
import time

from pyspark.sql import functions as F

from carecolumns.operators.asof import interpolated, ladder_join


def test_against_a_loop(spark):
    r = random.Random(4)
    steps = [(r.choice("abc"), float(r.randrange(40)), i) for i in range(60)] + [(None, 3.0, 90), ("a", None, 91), ("a", float("nan"), 92)]
    rows = [(i, r.choice(["a", "b", "c", "d", None]), r.choice([float(r.randrange(45)), r.random() * 45, None, float("nan")])) for i in range(300)] + [(1, "a", 7.0)] * 150
    df, ladder = spark.createDataFrame(rows, "step_id int, key string, x double"), spark.createDataFrame(steps, "key string, threshold double, step int")
    for operator in ("<", "<="):
        for ranges in (1, 4, 30):
            got = sorted(map(repr, ((o.step_id, o.key, o.x, o.threshold, o.step) for o in ladder_join(df, ladder, "x", ["key"], operator, ranges).collect())))
            want = []
            for i, k, x in rows:
                ahead = [(t, s) for key, t, s in steps if key == k and k is not None and x is not None and t is not None and (x < t or x == t and operator == "<=")]
                t, s = min(ahead, default=(None, None))
                want.append((i, k, x, t, s))
            assert got == sorted(map(repr, want)), (operator, ranges)


def test_interpolation_against_a_loop(spark):
    r = random.Random(5)
    steps = {(k, float(t)): r.random() for k in "ab" for t in r.sample(range(50), 12)}
    rows = [(i, r.choice("abc"), r.choice([r.random() * 60 - 5, float(r.randrange(50)), None])) for i in range(200)]
    df, ladder = spark.createDataFrame(rows, "id int, key string, x double"), spark.createDataFrame([(k, t, v, None) for (k, t), v in steps.items()], "key string, threshold double, v double, gap double")
    got = {o.id: (o.v, o.gap) for o in interpolated(df, ladder, "x", ["v", "gap"], ["key"], 7).collect()}
    for i, k, x in rows:
        own = sorted((t, v) for (key, t), v in steps.items() if key == k)
        if x is None or not own:
            assert got[i] == (None, None)
            continue
        low, high = [p for p in own if p[0] < x], [p for p in own if p[0] >= x]
        want = high[0][1] if not low else low[-1][1] if not high else low[-1][1] + (high[0][1] - low[-1][1]) * (x - low[-1][0]) / (high[0][0] - low[-1][0])
        assert abs(got[i][0] - want) < 1e-12 and got[i][1] is None


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2.0, {"a": 1})], "range int, key double, row map<string,int>")
    ladder = spark.createDataFrame([(3.0, 7)], "threshold double, next int")
    assert [tuple(o) for o in ladder_join(df, ladder, "key").collect()] == [(1, 2.0, {"a": 1}, 3.0, 7)]
    assert [tuple(o) for o in ladder_join(df, ladder.limit(0), "key").collect()] == [(1, 2.0, {"a": 1}, None, None)]
    assert ladder_join(df.limit(0), ladder, "key").count() == 0


def test_one_key_takes_linear_time(spark):
    def seconds(n):
        df = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 0.5).alias("x"))
        ladder = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 0.25).alias("threshold"), F.col("id").alias("step"))
        began = time.time()
        assert ladder_join(df, ladder, "x", ["key"]).where("threshold is not null").count() in (n // 2 - 1, n // 2, n // 2 + 1, n)
        return time.time() - began

    seconds(2_000)
    small, large = seconds(100_000), seconds(1_000_000)
    assert large < 30 * max(small, 2.0), (small, large)
