"""Requests of odd shapes, vectors and their comparison, forms."""

import math

from pyspark.sql import functions as F

from carecolumns.operators import differential, forms
from carecolumns.sources import requests

SPEC = {"slug": "s", "renderer": "formula", "inputs": [{"key": "x", "label": "First Field", "constraints": {"min": 0, "max": 9}}, {"key": "y", "label": "x!", "options": [{"value": 1.0, "label": "a"}, {"value": 2.0, "label": "b"}]}], "compute": {"steps": [], "outputs": [{"key": "z", "expr": "10 / (x - 5) * y"}]}}


def test_requests_of_any_shape(spark):
    bodies = ['{"x": 1, "inputs": {"x": 2, "y": "b"}}', '{"inputs": [1], "first field": true}', '{"inputs": {"FIRST-FIELD": 1.5e3}, "units": 7, "answers": "yes", "value": "4", "reverse": "no", "pair_index": 1.9}', "", None, "null", '"text"', "{}", '{"x": {"deep": [1, {"a": null}]}, "_x": 3, "": 1}', '{"X": 1, "x": 2}', "nonsense", '{"selections": {"a": ["p", "q"], "b": "r", "c": null, "d": {"e": 1}}}']
    df = spark.createDataFrame([(i, b, 1) for i, b in enumerate(bodies)], "i int, body string, request int")
    got = {r.i: r for r in requests.as_columns(requests.parsed(df, "body"), SPEC).collect()}
    assert (got[0].x, got[0].y, got[0].problem) == ("1", "b", None)
    assert (got[1].x, got[1].y, got[1].unknown) == ("true", None, [])
    assert got[2].x == "1500.0" and got[2].request.units == {} and got[2].request.answers == [] and got[2].request.value == 4.0 and got[2].request.reverse is False
    assert [got[i].problem for i in (3, 4, 7)] == [None] * 3 and [got[i].problem for i in (5, 6)] == ["no object"] * 2 and got[10].problem == "no JSON"
    assert got[8].x == '{"deep":[1,{"a":null}]}' and got[8].unknown == [""]
    assert got[9].x == "2"
    assert got[11].request.selections["a"] == ["p", "q"] and got[11].request.selections["b"] == ["r"]
    assert requests.parsed(df.limit(0), "body").count() == 0


def test_vectors_stay_inside_and_repeat(spark):
    drawn = differential.vectors(spark.range(300), "id", SPEC)
    rows = drawn.collect()
    assert rows == differential.vectors(spark.range(300), "id", SPEC).collect() and rows != differential.vectors(spark.range(300), "id", SPEC, 8).collect()
    assert all(0.001 <= r.x <= 9 and r.y in ("1.0", "2.0") for r in rows) and len({r.x for r in rows}) > 290


def test_differences_are_told_apart(spark):
    df = spark.createDataFrame([(1, 6.0, "1.0"), (2, 5.0, "1.0"), (3, 7.0, "2.0"), (4, None, "1.0"), (5, 5.0, "2.0")], "turn int, x double, y string")
    other = SPEC | {"compute": {"steps": [], "outputs": [{"key": "w", "expr": "10 / (x - 5) * y if y == 1 else 3 + 0 * x"}]}}
    got = {r.turn: (r.built, r.published, r.status) for r in differential.differences(df, SPEC, other, {"z": "w"}).collect()}
    assert got == {1: (10.0, 10.0, "agree"), 2: (None, None, "both fail"), 3: (10.0, 3.0, "differ"), 4: (None, None, "both fail"), 5: (None, 3.0, "built fails")}
    r = differential.agreement(differential.differences(df, SPEC, other, {"z": "w"})).first()
    assert (r.vectors, r.compared, r.mismatches, r.built_failures, r.published_failures) == (5, 2, 1, 3, 2) and math.isclose(r.agreement, 50.0)


def test_units_for_fields_of_odd_names(spark):
    lists = spark.createDataFrame([("a_mass", 2, "kg"), ("b_weight", 1, "kg"), ("c_height", 3, "cm"), ("d_xy", 4, None)], "stem string, position int, code string")
    fields = spark.createDataFrame([("anything", "KG"), ("body_height", None), ("hei", "?"), ("xy", ""), (None, None), ("", "cm")], "field string, base string")
    got = {(r.field, r.base): r.stem for r in forms.units_for_fields(fields, lists).collect()}
    assert got == {("anything", "KG"): "b_weight", ("body_height", None): "c_height", ("hei", "?"): "c_height", ("xy", ""): None, (None, None): None, ("", "cm"): "c_height"}


def test_review_is_ordered_and_complete(spark):
    df = spark.createDataFrame([("low", 1), ("medium", 2), ("critical", 3), (None, 4), ("high", 5)], "severity string, n int")
    assert [r.n for r in forms.review_queue(df).collect()] == [3, 5, 2, 1, 4] or [r.n for r in forms.review_queue(df).collect()][:3] == [3, 5, 2]
    assert forms.review_queue(df, 2).count() == 2 and forms.review_queue(df.where(F.lit(False))).count() == 0
