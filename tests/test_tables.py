"""Units, ladders from branches, requirements and trees against plain loops, with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from carecolumns.operators import ordered, reconstruction, requirements, trees, units
from carecolumns.sources.units import canonical_rows


def test_rebased_lists_round_trip(spark):
    rows = [(d, c, f, o) for _, d, _, c, f, o in canonical_rows()]
    lists = sorted({(f"{d}/{c}", d, c) for d, c, _, _ in rows})
    own = spark.createDataFrame([(k, c2, f, o) for k, d, c in lists for d2, c2, f, o in rows if d2 == d], "list string, code string, factor double, offset double")
    there = units.rebased(own, spark.createDataFrame([(k, c) for k, _, c in lists], "list string, base string"))
    got = {(r["list"], r.code): (r.factor, r.offset) for r in there.collect()}
    known = {(d, c): (f, o) for d, c, f, o in rows}
    for k, d, base in lists:
        assert got[k, base] == (1.0, 0.0)
        fb, ob = known[d, base]
        for (d2, c), (f, o) in known.items():
            if d2 == d:  # 37 of a unit, in the list's base and from there in the dimension's
                x = 37 * got[k, c][0] + got[k, c][1]
                assert abs(x * fb + ob - (37 * f + o)) <= 1e-9 * max(1, abs(37 * f + o))


def test_odd_lists(spark):
    own = spark.createDataFrame([("a", "kg", 2.0, None), ("a", "g", None, 1.0), ("b", "cm", 0.0, 0.0), ("c", None, 1.0, 0.0), (None, "kg", 1.0, 0.0)], "list string, code string, factor double, offset double")
    lists = spark.createDataFrame([("a", "KG"), ("b", "cm"), ("c", "m"), ("d", "m")], "list string, base string")
    got = sorted(((r["list"], r.code, r.factor, r.offset, r.rebased) for r in units.rebased(own, lists).collect()), key=repr)
    assert got == sorted([("a", "kg", 1.0, 0.0, True), ("a", "g", None, None, True), ("b", "cm", 0.0, 0.0, False), ("c", None, 1.0, 0.0, False)], key=repr)
    assert units.rebased(own.limit(0), lists).count() == 0


def test_paths_take_the_shortest_and_end_in_circles(spark):
    pairs = [("a", "b", 2.0, 1.0), ("b", "c", 3.0, 0.0), ("c", "a", 0.5, 0.0), ("c", "d", 10.0, -5.0), ("x", "y", 0.0, 0.0), (None, "a", 1.0, 0.0), ("e", "a", None, 0.0), ("a", "a", 2.0, 0.0)]
    df = spark.createDataFrame(pairs, "from string, to string, factor double, offset double")
    got = {r.unit: (r.factor, r.offset, r.steps) for r in units.along_paths(df, spark.createDataFrame([("d",), (None,)], "base string")).collect()}
    # b to c to d: 10 (3 x) - 5; a to c is 2 x backwards
    assert got == {"d": (1.0, 0.0, 0), "c": (10.0, -5.0, 1), "b": (30.0, -5.0, 2), "a": (20.0, -5.0, 2)}


def test_scans_cross_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.randrange(9)) for i in range(500)]
    df = ordered.placed(spark.createDataFrame(rows, "i int, k string, v int"), ["k", "i"], 13)
    df = ordered.with_running_sum(ordered.with_before(df, ["k", "i"], F.struct("k", "v"), "last"), ["k", "i"], F.col("v"), "total")
    got, total, last = {x.i: (x.last and tuple(x.last), x.total) for x in df.collect()}, 0, None
    for i, k, v in sorted(rows, key=lambda x: (x[1], x[0])):
        total += v
        assert got[i] == (last, total)
        last = (k, v)


def plain_ladders(branches, least):
    """The same rules in a loop over one source."""
    runs = []
    for b in sorted(branches, key=lambda b: b[0]):
        if runs and runs[-1][-1][1] == b[1] and b[2] >= runs[-1][-1][2]:
            runs[-1].append(b)
        else:
            runs.append([b])
    tables = []
    for run in runs:
        steps = {}
        for p, k, t, m, s in run:
            if t not in steps or (m is not None) + (s is not None) >= sum(x is not None for x in steps[t]):
                steps[t] = (m, s)
        if len(steps) >= least and not any(k2 == run[0][1] and steps == other for k2, other, *_ in tables):
            tables.append((run[0][1], steps))
    out = []
    for k, steps in tables:
        low, high = min(steps), max(steps)
        restarts = False
        if out and out[-1][0] == k:
            before = out[-1]
            if low >= before[3] - 1e-9 and high > before[3] and low > before[2]:
                before[1] = {**steps, **before[1]}
                before[2], before[3] = low, high
                continue
            restarts = True
        out.append([k, dict(steps), low, high, restarts])
    return sorted((n, k, t, *v, restarts) for n, (k, steps, _, _, restarts) in enumerate(out, 1) for t, v in steps.items())


def test_ladders_against_a_loop(spark):
    r = random.Random(8)
    rows = []
    for source in ("s1", "s2", "hot"):
        at = 0
        for piece in range(6 if source != "hot" else 40):
            key, t = r.choice(["age", "age", "length"]), r.randrange(20)
            for _ in range(r.randrange(1, 9)):
                rows.append((source, at, key, float(t), round(r.random(), 2) if r.random() < 0.8 else None, float(t)))
                at, t = at + 1, t + r.choice([0, 1, 1, 2])
    copy = [(s, p + 10_000, k, t, m, x) for s, p, k, t, m, x in rows if s == "s1"]  # the script drawn twice
    df = spark.createDataFrame([(s, p, k, "<", t, m, x) for s, p, k, t, m, x in rows + copy] + [("s1", 3, "age", "<", None, 1.0, 1.0), ("s1", 4, "age", "<", 2.0, None, None)], "source string, position int, key string, operator string, threshold double, m double, s double")
    for ranges in (1, 9):
        got = {}
        for o in reconstruction.ladders(df, ["m", "s"], 3, ranges).collect():
            got.setdefault(o.source, []).append((o.ladder, o.key, o.threshold, o.m, o.s, o.restarts))
        for source in ("s1", "s2", "hot"):
            want = plain_ladders([(p, k, t, m, x) for s, p, k, t, m, x in rows + copy if s == source], 3)
            assert sorted(got[source], key=repr) == sorted(want, key=repr), source
    assert reconstruction.ladders(df.limit(0), ["m", "s"]).count() == 0


def test_requirements_of_rows_that_do_not_compute(spark):
    spec = {"inputs": [{"key": "mode", "required": True}, {"key": "x", "required": True}, {"key": "y", "required": True, "default": 5.0}], "compute": {"steps": [], "outputs": [{"key": "z", "expr": "x if mode == 1 else 1 / y"}]}, "renderer": "formula", "slug": "s"}
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, None, 4.0), (2.0, 1.0, 0.0), (None, 1.0, 1.0), (1.0, 2.0, None)], "mode double, x double, y double")
    found = requirements.leave_one_out(df, spec, "mode")
    assert sorted(map(tuple, found.collect())) == [("1.0", "x", 2, 0), ("1.0", "y", 1, 1), ("2.0", "y", 1, 0)]
    assert {r.field: (r.needed, r.spare, r.rule) for r in requirements.requirements(found).collect()} == {"x": (["1.0"], [], "always"), "y": (["2.0"], ["1.0"], "sometimes")}


def test_trees_deeper_than_a_hundred_and_circles(spark):
    deep = [("deep", f"n{i}", True, f"n{i + 1}") for i in range(130)] + [("deep", f"n{i}", False, "out") for i in range(130)]
    round_ = [("round", "a", True, "b"), ("round", "b", True, "a"), ("round", "b", False, None), ("round", "c", True, "a"), ("round", None, True, "a")]
    edges = spark.createDataFrame(deep + round_, "tree string, node string, yes boolean, to string")
    roots = spark.createDataFrame([("deep", "n0"), ("round", "a")], "tree string, root string")
    asks = [(1, "deep", ["yes"] * 200), (2, "deep", [" Y ", "true", "1", "no", "yes"]), (3, "round", ["yes"] * 7), (4, "round", ["yes", None]), (5, "none", ["yes"]), (6, "deep", None), (7, "round", ["no"]), (1, "deep", ["yes"] * 200)]
    got = sorted(((r.subject, r.node, r.steps) for r in trees.walk(spark.createDataFrame(asks, "subject int, tree string, answers array<string>"), edges, roots).collect()), key=repr)
    assert got == sorted([(1, "n130", 130), (1, "n130", 130), (2, "out", 4), (3, "b", 7), (4, None, 2), (5, None, 0), (6, "n0", 0), (7, "a", 0)], key=repr)
    assert sorted(map(tuple, trees.circles(edges).collect())) == [("round", "a"), ("round", "b")]
    assert trees.circles(edges.limit(0)).count() == 0


def test_compound_units_are_read_once_a_row(spark):
    known = units.simple_units()
    codes = ["mcg/kg/minute", "MG/KG/hr", "g/dL", "mg/mL", "hr", "mg/mg", "mg/fortnight", "", None, "mL/kg/day", "day/kg", "kg/mL/mL", "/kg"]
    plain = lambda p: known.get("".join(c for c in p.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789%"))

    def read(code):
        parts = [plain(p) for p in code.split("/")] if code is not None else [None]
        if None in parts:
            return None, None
        vector, factor = {}, 1.0
        for i, (d, f) in enumerate(parts):
            vector[d], factor = vector.get(d, 0) + (1 if i == 0 else -1), factor * f ** (1 if i == 0 else -1)
        return {d: e for d, e in vector.items() if e}, factor

    df = spark.createDataFrame([(a, b, 3.5) for a in codes for b in codes], "a string, b string, v double")
    vector, factor = units.compound(F.col("a"), known)
    for r in units.converted(df, "v", "a", "b").select("*", vector.alias("vector"), factor.alias("factor")).collect():
        (va, fa), (vb, fb) = read(r.a), read(r.b)
        assert r.vector == va and r.factor == (None if fa is None else pytest.approx(fa, rel=1e-14))
        assert r.converted == (None if va is None or va != vb else pytest.approx(3.5 * fa / fb, rel=1e-14)), (r.a, r.b)
    plan = units.converted(df, "v", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # each code is cut once
