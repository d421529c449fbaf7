import json

import pytest
from pyspark.sql import functions as F

from carecolumns.functions.values import number
from carecolumns.operators.asof import ladder_join
from carecolumns.operators import checks, evaluation, tables
from carecolumns.plans.schedule import Item, ScheduleError, run, schedule
from carecolumns.sources import catalog
from carecolumns.sources.definitions import specifications

SPECS = specifications()


def one(spark, slug, **given):
    df = spark.createDataFrame([tuple(str(v) for v in given.values())], ", ".join(f"`{k}` string" for k in given))
    return evaluation.formula(df, SPECS[slug]).first()


def test_published_values(spark):
    r = one(spark, "creatinine-clearance-by-cockcroft-gault-age-16-years", age=70, weight=70, serum_creatinine="1.0", sex="0.85")
    assert r.ok and r.outputs.estimated_creatinine_clearance.value == 58.0
    r = one(spark, "glomerular-filtration-rate-by-mdrd", age=60, standardized_serum_creat=1.1, sex=0.742, race="1.0")
    assert r.outputs.glomerular_filtration_rate.value == 50.67
    args = {"dose": 5, "weight": 70, "concentration": 1000, "drug_amount": 250, "infusate_volume": 250}
    assert one(spark, "dobutamine", **args).outputs.infuse_rate.value == 21.0
    assert one(spark, "dobutamine", **args | {"weight": 154.324, "weight__unit": "lbs"}).outputs.infuse_rate.value == 21.0
    assert one(spark, "dobutamine", **args | {"concentration": "other"}).outputs.infuse_rate.value == 21.0
    r = one(spark, "gestational-age", crown_rump_length=40, biparietal_diameter=50, head_circumference=200, current_time="2026-09-01T12:00:00Z", us_time="2026-09-01T12:00:00Z", lmp_time="2026-01-01T12:00:00Z")
    assert r.ok and [round(r.outputs[k].value) for k in ("lmpweeks", "bpdweeks", "hcweeks", "crlweeks")] == [35, 21, 22, 11]


def test_errors_are_data(spark):
    slug = "creatinine-clearance-by-cockcroft-gault-age-16-years"
    r = one(spark, slug, age=4, weight=70, serum_creatinine="abc", sex="0.85")
    assert not r.ok and r.outputs.estimated_creatinine_clearance.value is None
    assert [(e.field, "at least 16" in e.message or "number" in e.message) for e in r.errors] == [("age", True), ("serum_creatinine", True)]
    assert [e.field for e in one(spark, slug, age=" ", weight=70, sex="2").errors] == ["sex", "age", "serum_creatinine"]
    assert one(spark, slug, age="nan", weight=70, serum_creatinine=1, sex=1).ok is False
    assert [e.message for e in one(spark, slug, age=20, weight=70, weight__unit="stone", serum_creatinine=1, sex=1).errors] == ["unknown unit stone"]


def test_conditions_defaults_and_texts(spark):
    assert one(spark, "bivalirudin", use_bolus="No", infusion_dose=1, weight=70, infusion_conc=1).outputs.bolus_dose_output_mg.value == 0
    assert [e.field for e in one(spark, "bivalirudin", use_bolus="Yes", infusion_dose=1, weight=70, infusion_conc=1).errors] == ["bolus_dose"]
    assert one(spark, "adjusted-body-weight", height=70, weight=40, method_list="Devine", gender_list="male").outputs.abw.text == "N/A"
    r = one(spark, "qt-interval-correction-ekg-multi-equation", qt_interval=400, heart_rate_measure=60)
    assert r.ok and r.outputs.qt_interval_corrected_bazett.value == 400.0
    r = one(spark, "qt-interval-correction-ekg-multi-equation", heart_rate_measure_unit_mode=1, qt_interval=400, heart_rate_measure=500)
    assert r.outputs.qt_interval_corrected_hodges.value == 400 + 1.75 * 60
    assert one(spark, "qt-interval-correction-ekg", qt_interval="0.4", heart_rate=60).outputs.qti_corrected.value == 0.4


def test_schedule_rules(spark):
    items = [Item("b", "a + 1", False), Item("a", "x * 2", False), Item("a", "a + b", True)]
    assert [i.key for i, _ in schedule(items, {"x"})] == ["a", "a", "b"] or [i.key for i, _ in schedule(items, {"x"})] == ["a", "b", "a"]
    with pytest.raises(ScheduleError):
        schedule([Item("a", "b + 1", True)], set())
    df = spark.range(1)
    done = run(df, {"x": number(0.0)}, [Item("bad", "1 / x", False), Item("y", "x + 1", True)])
    assert done.df.select(done.failed).first()[0] is True


def test_every_specification_evaluates(spark):
    rows = checks.evaluate_all(spark.range(12), "id", [s for k, s in SPECS.items() if k in ("anion-gap", "dopamine", "meld-score", "epinephrine-weight-based", "water-deficit-in-hypernatremia", "valganciclovir", "bivalirudin", "body-mass-index-bmi")]).collect()
    assert len(rows) == 8 and all(r.ok > 0 for r in rows)
    assert {(r.slug, r.rule) for r in checks.invariants(catalog.built_in(spark)).collect()} <= {("pulmonary-embolism-wells-score", "band"), ("cha2ds2-vasc-score", "band")}


def test_scores_bands_and_tree(spark):
    spec = SPECS["4t-score"]
    subjects = spark.createDataFrame([(1,), (2,), (3,), (4,)], "subject_id long")
    keys = [g["key"] for g in spec["scoring"]["groups"]]
    picks = [(1, k, f"opt_{i}_0") for i, k in enumerate(keys)] + [(2, k.upper(), "option 3") for k in keys] + [(3, keys[0], "nothing"), (4, keys[0], "opt_0_0"), (4, keys[0], "opt_0_1")] + [(4, "who", "x")]
    got = {r.subject_id: r for r in evaluation.score(subjects, spark.createDataFrame(picks, "subject_id long, group string, option string"), spec).collect()}
    assert (got[1].total, got[1].band, got[2].total, got[2].band) == (8.0, "High probability", 0.0, "Low probability")
    assert len(got[3].errors) == 5 and not got[3].ok and any("one choice" in e.message for e in got[4].errors) and any("group" in e.message for e in got[4].errors)
    assert evaluation.score_range(spec) == (0.0, 8.0) and evaluation.score_range(SPECS["modified-wells-score-for-dvt"]) == (-2.0, 9.0)
    df = spark.createDataFrame([([],), (["no"],), (["yes", "Y", "1", "true", "no"],), (None,)], "answers array<string>")
    assert [(r.node, r.done, r.steps) for r in evaluation.tree(df, SPECS["rabies-post-exposure-prophylaxis-treecalc"]).collect()] == [("q1", False, 0), ("none", True, 1), ("give_tested", True, 4), ("q1", False, 0)]


def test_convert_titration_and_tables(spark):
    df = spark.createDataFrame([(0, 70.0, False), (0, 154.323583, True), (9, 1.0, False)], "pair_index int, value double, reverse boolean")
    assert [r.result for r in evaluation.convert(df, SPECS["unit-conversions-weight"]).collect()] == [154.323583, 70.0, None]
    df = spark.createDataFrame([(1, 500, 250, 1, 70), (2, 0, 0, 1, 70)], "id int, drug_amount int, infusate_volume int, dose int, weight int")
    rows = evaluation.titration(df, SPECS["cisatracurium"]).collect()
    assert len(rows) == 20 and rows[0].dose == 0.5 and rows[0].value == 1.05
    assert evaluation.titration(df, SPECS["epinephrine"]).count() == 0 and evaluation.titration(df, SPECS["epinephrine"], always=True).count() > 0
    drugs = [{"name": "n", "routes": [{"label": "IV", "conc": 4.0, "doses": [{"phase": "s", "amt": [0.1, 0.5], "perKg": True, "unit": "mcg"}, {"phase": "t", "amt": 6.0, "perKg": True, "max": 12.0}]}]}]
    rows = tables.dose_table(spark.createDataFrame([(70.0,), (None,)], "weight double"), drugs).collect()
    assert [(r.low, r.high, r.capped) for r in rows] == [(7.0, 35.0, False), (12.0, 12.0, True), (0.0, 0.0, False), (0.0, 0.0, False)]
    doses = spark.createDataFrame([(1, "Methadone", 240.0), (1, "oxycodone", 45.0), (2, "unknown", 1.0)], "subject_id int, drug string, dose double")
    got = {r.subject_id: r.total for r in tables.equivalents(doses, {"oxycodone": 1.5}).collect()}
    assert got == {1: 240 * 12 + 67.5, 2: None}
    x = F.col("x")
    df = spark.createDataFrame([(5.0,), (10.0,), (99.0,), (None,)], "x double")
    ladder = [{"threshold": 10.0, "l": 1.0}, {"threshold": 20.0, "l": 2.0}]
    assert [r[0] for r in df.select(tables.ladder_value(x, ladder, ["l"])["l"]).collect()] == [1.0, 2.0, None, None]
    assert [r[0] for r in df.select(tables.ladder_value(x, ladder, ["l"], "<=", {"l": 9.0})["l"]).collect()] == [1.0, 1.0, 9.0, None]
    joined = ladder_join(df, spark.createDataFrame([(10.0, 1), (20.0, 2)], "threshold double, step int"), "x")
    assert sorted(((r.x or -1, r.step) for r in joined.collect())) == [(-1, None), (5.0, 1), (10.0, 2), (99.0, None)]


def test_catalogue(spark, tmp_path):
    rows = catalog.built_in(spark).cache()
    assert catalog.resolve(rows, "4T score")["slug"] == "4t-score" and catalog.resolve(rows, "ANIONGAP")["slug"] == "anion-gap"
    with pytest.raises(LookupError, match="did you mean"):
        catalog.resolve(rows, "creatinine")
    titles = [r.title for r in catalog.search(rows, "anion gap").collect()]
    assert titles[0] == "Anion Gap" and len(titles) == 4
    assert catalog.search(rows, None, category="Unit Conversions").count() == 9 == catalog.categories(rows).where("category = 'Unit Conversions'").first().specifications
    assert {r.renderer: r.specifications for r in catalog.renderers(rows).collect()}["score"] == 13
    assert catalog.page(catalog.names(rows), 5, 2).count() == 5
    with pytest.raises(ValueError):
        catalog.page(rows, 0)
    assert catalog.children(rows, "units").count() > 10 and catalog.children(rows, "group_options").count() > 50 and catalog.children(rows, "pairs").count() > 20
    for k in ("anion-gap", "4t-score"):
        (tmp_path / f"{k}.json").write_text(json.dumps(SPECS[k]))
    (tmp_path / "index.json").write_text("{}")
    assert {r.slug for r in catalog.load(spark, str(tmp_path)).collect()} == {"anion-gap", "4t-score"}


def test_normal_distribution_equals_the_library(spark):
    import math

    from carecolumns.functions.normal import normal_cdf

    xs = [k / 23 for k in range(-600, 600)] + [0.0, math.inf, -math.inf]
    df = spark.createDataFrame([(x,) for x in [*xs, None, math.nan]], "x double")
    plan = df.select(normal_cdf(F.col("x")).alias("p"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    got = [r.p for r in plan.collect()]
    assert all(math.isclose(p, 0.5 * math.erfc(-x / math.sqrt(2)), rel_tol=1e-12, abs_tol=1e-300) for x, p in zip(xs, got, strict=False))
    assert got[-2] is None and math.isnan(got[-1])


def test_ladders_choose_fall_back_and_fail(spark):
    rows = [{"threshold": float(t), "a": float(10 * t)} for t in range(1, 101)]
    spec = {"slug": "s", "renderer": "formula", "inputs": [{"key": "x", "required": True}, {"key": "who", "required": True, "options": [{"value": 1.0, "label": "one"}, {"value": 2.0, "label": "two"}, {"value": 3.0, "label": "none"}]}],
            "compute": {"steps": [{"key": "month_age", "expr": "x * 2"}], "outputs": [{"key": "y", "expr": "a + 1"}]},
            "tables": {"lookups": [{"key": "Month_Age", "operator": "<", "columns": ["a"], "rows": rows, "select_key": "who", "select_value": 1.0}, {"key": "monthage", "operator": "<=", "columns": ["a"], "rows": rows[:5], "select_key": "who", "select_value": 2.0, "fallback": {"a": -1.0}}]}}
    # the second table's key is no name of a step: it is never looked up, and with it the columns that both write
    with pytest.raises(ScheduleError):
        evaluation.formula(spark.createDataFrame([(1.0, "one")], "x double, who string"), spec)
    spec["tables"]["lookups"][1]["key"] = "MONTH_AGE"
    data = [(1.0, "one"), (1.0, "two"), (0.25, "two"), (49.9, "one"), (50.0, "one"), (9.0, "two"), (1.0, "none")]
    out = evaluation.formula(spark.createDataFrame(data, "x double, who string"), spec, lookups=True).collect()
    assert [r.outputs.y.value for r in out] == [31.0, 21.0, 11.0, 1001.0, None, 0.0, None] and [r.ok for r in out] == [True, True, True, True, False, True, False]
    assert [(u.row_index, u.outside) for r in out[:6] for u in r.lookups_used or []] == [(2, False), (1, False), (0, False), (99, False), (4, True)] and len(out[5].warnings) == 1
    assert tables.ladder_value(F.lit(1.0), rows[:3], ["a"]) is not None


def test_bounds_and_units_of_a_form():
    from carecolumns.operators.inputs import bounds_in, units_of

    f = {"key": "t", "base_unit": "C", "constraints": {"min": 30.0, "exclusive_max": 45.0}, "units": [{"code": "F", "factor": 5 / 9, "offset": -160 / 9}, {"code": "C", "factor": 1.0}, {"code": "rev", "factor": -1.0, "offset": 0.0}]}
    assert [bounds_in(f, "F")[k] for k in ("min", "max", "open_min", "open_max")] == [86.0, 113.0, False, True]
    assert [bounds_in(f, "rev")[k] for k in ("min", "max", "open_min", "open_max")] == [-45.0, -30.0, True, False] and bounds_in(f, None)["min"] == 30.0
    assert [(u["code"], u["is_base"]) for u in units_of(f)] == [("C", True), ("F", False), ("rev", False)] and units_of({"key": "x", "base_unit": "mg"})[0]["label"] == "mg"


def test_random_vectors_against_plain_python(spark):
    import math
    import random

    r = random.Random(7)
    plain = {
        "anion-gap": lambda v: {"ag": v["na"] - v["cl"] - v["hco3"]},
        "creatinine-clearance-by-cockcroft-gault-age-16-years": lambda v: {"estimated_creatinine_clearance": v["sex"] * (140 - v["age"]) * v["weight"] / (72 * v["serum_creatinine"])},
        "meld-score": lambda v: {"meld_score": 9.57 * math.log(4 if v["hemodialysis_twice_in_week_prior"] == 1 else v["creatinine"]) + 3.78 * math.log(v["bilirubin"]) + 11.2 * math.log(v["inr"]) + 6.43},
        "body-surface-area-mosteller-method": lambda v: {"bsa": math.sqrt(v["height"] * v["weight"] / 3600)},
    }
    for slug, formula in plain.items():
        spec = dict(SPECS[slug]) | {"display": {}}
        vectors = []
        for _ in range(200):
            v = {}
            for f in spec["inputs"]:
                c = f.get("constraints") or {}
                v[f["key"]] = r.choice([o["value"] for o in f["options"]]) if f.get("options") else round(r.uniform(max(c.get("min", 0.5), 0.1), c.get("max", 90)), 4)
            vectors.append(v)
        df = spark.createDataFrame([(i, *v.values()) for i, v in enumerate(vectors)], ", ".join(["i int", *[f"`{k}` double" for k in vectors[0]]]))
        for row in evaluation.formula(df, spec).collect():
            for k, want in formula(vectors[row.i]).items():
                assert row.ok and math.isclose(row.outputs[k].value, want, rel_tol=1e-6, abs_tol=1e-6), (slug, vectors[row.i])


def test_publish_and_load(spark, tmp_path):
    made = catalog.frame(spark, [SPECS[k] for k in ("anion-gap", "4t-score")])
    checks.publish(made, str(tmp_path / "out"))
    assert checks.difference(made, spark.read.text(str(tmp_path / "out" / "specifications")).select(F.get_json_object("value", "$.slug").alias("slug"), F.col("value").alias("document"))).count() == 0
    assert {r.slug for r in spark.read.json(str(tmp_path / "out" / "index")).collect()} == {"anion-gap", "4t-score"}


def test_rows_without_errors_read_each_input_once(spark):
    # outside of array functions, which are a call a row and compute their arguments uncompiled, a text is turned into a number in one place
    spec = SPECS["anion-gap"]
    plan = evaluation.formula(checks.probes(spark.range(3), "id", spec), spec).select("ok")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast(") == len(spec["inputs"])
    # errors keep their order, bounds after what cannot be read, whatever else holds
    df = spark.createDataFrame([("abc", "stone", "9"), ("0", "kg", "1.7"), (None, None, "0.85")], "weight string, weight__unit string, height string")
    made = {"inputs": [{"key": "weight", "required": True, "base_unit": "kg", "units": [{"code": "kg", "factor": 1.0}], "constraints": {"min": 1}}, {"key": "height", "options": [{"value": 0.85, "label": "Low"}, {"value": 1.7}]}], "compute": {"outputs": [{"key": "y", "expr": "weight"}]}}
    assert [[e.message for e in r.errors] for r in evaluation.formula(df, made).collect()] == [["weight must be a number", "unknown unit stone", "height: unknown choice 9"], ["weight must be at least 1 kg"], ["weight is required"]]
