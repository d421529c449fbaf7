"""Registered queries of the specifications, over cohorts derived from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecolumns.operators import asof, evaluation, tables
from carecolumns.operators.inputs import validate
from carecolumns.sources import catalog
from carecolumns.sources.definitions import specifications

#: Tables to read by name: the columns a query needs are pruned by the plan.
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cohort(spark: SparkSession, sf_dir: str, **fields: str) -> DataFrame:
    """One subject a customer, with fields as SQL over c_custkey (k) that both engines read alike."""
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return df.select("k", *[F.expr(v).alias(n) for n, v in fields.items()])


def _cohort_sql(**fields: str) -> str:
    inner = ", ".join(f"{v} as {n}" for n, v in fields.items())
    return f"(select k, {inner} from (select c_custkey as k from customer))"


QUERIES, ORACLE = {}, {}


def _register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _formula(name: str, slug: str, fields: dict[str, str], outputs: dict[str, str], digits: int = 6) -> None:
    """Register a formula over a cohort: each output unrounded by the display, rounded to `digits` on both sides, null unless the row is ok (`valid`)."""
    valid = outputs.pop("valid", "true")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = dict(specifications()[slug]) | {"display": {"decimal_precision": None}}
        out = evaluation.formula(_cohort(spark, sf_dir, **fields), spec)
        return out.select(F.col("k").alias("subject_id"), "ok", *[F.round(F.col(f"outputs.`{k}`.value"), digits).alias(k) for k in outputs])

    sql = ", ".join(f"case when {valid} then round({e}, {digits}) end as {k}" for k, e in outputs.items())
    QUERIES[name] = run
    ORACLE[name] = f"select k as subject_id, coalesce({valid}, false) as ok, {sql} from {_cohort_sql(**fields)}"


D = lambda s: f"cast({s} as double)"
_formula("formula_cockcroft_gault", "creatinine-clearance-by-cockcroft-gault-age-16-years",
    {"age": D("10 + k % 120"), "weight": D("45 + (k * 7) % 80"), "serum_creatinine": D("5 + (k * 13) % 30") + " / 10", "sex": "case when k % 2 = 0 then cast(0.85 as double) else cast(1.0 as double) end"},
    {"estimated_creatinine_clearance": "sex * ((140 - age) / serum_creatinine) * (weight / 72)", "valid": "age between 16 and 120"})
_formula("formula_anion_gap_delta_ratio", "anion-gap-and-delta-delta-ratio",
    {"na": D("70 + k % 140"), "cl": D("60 + k % 121"), "hco3": D("k % 31"), "baseline_gap": D("k % 51")},
    {"anion_gap": "na - (cl + hco3)", "delta_gap": "na - (cl + hco3) - baseline_gap", "delta_hco3": "25 - hco3", "delta_delta_ratio": "(na - (cl + hco3) - baseline_gap) / nullif(25 - hco3, 0)", "valid": "(na between 80 and 200 and hco3 <> 25)"})
_formula("formula_osmolal_gap", "osmolal-gap",
    {"serum_na": D("100 + k % 60"), "serum_glucose": D("k % 400"), "serum_bun": D("k % 151"), "serum_ethanol": D("k % 300"), "measured_osm": D("250 + k % 100")},
    {"calculated_osm": "serum_na * 2 + serum_glucose / 18 + serum_bun / 2.8 + serum_ethanol / 3.7", "osmolal_gap": "measured_osm - (serum_na * 2 + serum_glucose / 18 + serum_bun / 2.8 + serum_ethanol / 3.7)"})
_formula("formula_meld_required_when", "meld-score",
    {"hemodialysis_twice_in_week_prior": "cast(k % 2 as double)", "creatinine": "case when k % 3 = 0 then null else cast(1 + k % 3 as double) end", "bilirubin": D("1 + k % 40"), "inr": D("10 + k % 30") + " / 10"},
    {"meld_score": "10 * (0.957 * ln(case when hemodialysis_twice_in_week_prior = 1 then 4.0 else creatinine end) + 0.378 * ln(bilirubin) + 1.12 * ln(inr)) + 6.43", "valid": "(hemodialysis_twice_in_week_prior = 1 or creatinine is not null)"})
_formula("formula_mosteller_gehan", "dose-adjustment-for-body-surface-area",
    {"standard_dose": D("100 + k % 500"), "height": D("100 + k % 100"), "weight": D("20 + k % 90")},
    {"bsa": "0.007184 * pow(height, 0.725) * pow(weight, 0.425)", "adjusted_dose": "standard_dose * (0.007184 * pow(height, 0.725) * pow(weight, 0.425)) / 1.73"})
_formula("formula_qt_cycle", "qt-interval-correction-ekg-multi-equation",
    {"heart_rate_measure_unit_mode": "cast(k % 2 as double)", "qt_interval": D("300 + k % 300"), "heart_rate_measure": D("50 + k % 450")},
    {"qt_interval_corrected_bazett": "qt_interval / sqrt((case when heart_rate_measure_unit_mode = 1 then heart_rate_measure else 60000 / heart_rate_measure end) / 1000)", "qt_interval_corrected_hodges": "qt_interval + 1.75 * ((case when heart_rate_measure_unit_mode = 1 then 60000 / heart_rate_measure else heart_rate_measure end) - 60)"})
_formula("formula_maintenance_fluid", "maintenance-fluid-calculation-for-children",
    {"weight": D("1 + k % 220")},
    {"daily_volume": "case when weight < 10 then 100 * weight when weight < 20 then 1000 + 50 * (weight - 10) else 1500 + 20 * (weight - 20) end", "fluid_infusion_rate": "(case when weight < 10 then 100 * weight when weight < 20 then 1000 + 50 * (weight - 10) else 1500 + 20 * (weight - 20) end) / 24", "valid": "weight between 3.499 and 200"})
_formula("formula_eptifibatide", "eptifibatide",
    {"cr_cl": D("10 + k % 140"), "weight": D("37 + k % 160"), "bolus_conc": D("2"), "infusion_conc": "cast(0.75 as double)"},
    {"bolus": "case when weight > 121 then 22.6 / bolus_conc else 180 * weight / (1000 * bolus_conc) end", "rate": "case when weight > 121 then case when cr_cl >= 50 then 15 / infusion_conc else 7.5 / infusion_conc end else case when cr_cl >= 50 then 60 * weight / (1000 * infusion_conc) * 2 else 60 * weight / (1000 * infusion_conc) end end"})
_formula("formula_free_water", "water-deficit-in-hypernatremia",
    {"age_sex_factor": "case k % 3 when 0 then cast(0.6 as double) when 1 then cast(0.5 as double) else cast(0.45 as double) end", "normal_weight": D("40 + k % 80"), "serum_na": D("130 + k % 40")},
    {"wdef": "age_sex_factor * normal_weight * (serum_na - 140) / 140"})
_formula("formula_ckd_epi_round", "egfr-by-ckd-epi-creatinine-equation-egfrcr-2021-in-adults",
    {"sex": D("1 + k % 2"), "age": D("18 + k % 80"), "serum_creatinine": D("4 + k % 60") + " / 10", "height": D("150 + k % 50"), "weight": D("45 + k % 70")},
    {"bsa": "0.007184 * pow(height, 0.725) * pow(weight, 0.425)", "egfrcr": "round_even(142 * pow(least(serum_creatinine / (case when sex = 1 then 0.7 else 0.9 end), 1), case when sex = 1 then -0.241 else -0.302 end) * pow(greatest(serum_creatinine / (case when sex = 1 then 0.7 else 0.9 end), 1), -1.2) * pow(0.9938, age) * (case when sex = 1 then 1.012 else 1 end), 0)"})


@_register("validate_errors", """
select field, message, count(*) as subjects from (
  select 'age' as field, 'age must be at least 16 years' as message from customer where c_custkey % 120 < 16
  union all select 'serum_creatinine', 'serum_creatinine is required' from customer where c_custkey % 7 = 0
  union all select 'serum_creatinine', 'serum_creatinine must be a number' from customer where c_custkey % 7 = 1
  union all select 'sex', 'sex: unknown choice 2' from customer where c_custkey % 5 = 0
  union all select 'weight', 'unknown unit stone' from customer where c_custkey % 11 = 0
  union all select 'weight', 'weight must be at most 250 kg' from customer where c_custkey % 11 <> 1 and 100 + c_custkey % 200 > 250
) group by all""")
def validate_errors(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 120).alias("age"), F.expr("case c_custkey % 7 when 0 then '  ' when 1 then 'abc' else '1.0' end").alias("serum_creatinine"), F.expr("case when c_custkey % 5 = 0 then '2' else '0.85' end").alias("sex"),
        F.expr("100 + c_custkey % 200").alias("weight"), F.expr("case c_custkey % 11 when 0 then 'stone' when 1 then 'LBS' end").alias("weight__unit"),
    )
    rows, _ = validate(df, specifications()["creatinine-clearance-by-cockcroft-gault-age-16-years"])
    return rows.select(F.explode("errors").alias("e")).groupBy("e.field", "e.message").agg(F.count("*").alias("subjects"))


@_register("units_to_base", """
select c_custkey as subject_id, round((100 + c_custkey % 100) * (case c_custkey % 3 when 0 then 1.0 when 1 then 0.45359237 else 1.0 end) * 15, 6) as ld from customer""")
def units_to_base(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr("100 + c_custkey % 100").alias("weight"), F.expr("case c_custkey % 3 when 0 then 'kg' when 1 then 'lbs' end").alias("weight__unit"))
    spec = dict(specifications()["fomepizole"]) | {"display": {}, "compute": {"steps": [], "outputs": [{"key": "ld", "expr": "15 * weight"}]}}
    return evaluation.formula(df, spec).select(F.col("c_custkey").alias("subject_id"), F.round("outputs.ld.value", 6).alias("ld"))


@_register("titration_table", """
select subject_id, cast(step * 0.5 as double) as dose, round_even(step * 0.5 * weight / 2.0 * 60 / 1000, 2) as value from (
  select c_custkey as subject_id, cast(50 + 2 * (c_custkey % 30) as double) as weight from customer), (select unnest(range(1, 21)) as step)""")
def titration_table(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.lit(500).alias("drug_amount"), F.lit(250).alias("infusate_volume"), F.lit(1).alias("dose"), F.expr("50 + 2 * (c_custkey % 30)").alias("weight"))
    return evaluation.titration(df, specifications()["cisatracurium"]).select("subject_id", "dose", "value")


def _score_sql(points: str) -> str:
    return f"""
with p as (select o_custkey as subject_id, o_orderkey % 4 as g, max(o_orderkey) % 3 as o from orders group by 1, 2),
t as (select subject_id, count(*) as n, sum({points}) as total from p group by 1)
select c_custkey as subject_id, coalesce(n, 0) = 4 as ok, cast(case when n = 4 then total end as double) as total,
  case when n = 4 then case when total <= 3 then 'Low probability' when total <= 5 then 'Intermediate probability' else 'High probability' end end as band
from customer left join t on c_custkey = subject_id"""


@_register("score_4t", _score_sql("2 - o"))
def score_4t(spark, sf_dir):
    spec = specifications()["4t-score"]
    keys = F.array(*[F.lit(g["key"]) for g in spec["scoring"]["groups"]])
    picks = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject_id"), (F.col("o_orderkey") % 4).alias("g")).agg((F.max("o_orderkey") % 3).alias("o"))
    picks = picks.select("subject_id", F.get(keys, F.col("g").cast("int")).alias("group"), F.format_string("opt_%d_%d", "g", "o").alias("option"))
    subjects = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"))
    return evaluation.score(subjects, picks, spec).select("subject_id", "ok", "total", "band")


@_register("score_bands_first_match", """
select l_orderkey, l_linenumber, l_quantity / 5 as total, case when l_quantity / 5 >= 6 then 'High probability' when l_quantity / 5 >= 2 then 'Moderate probability' else 'Low probability' end as band from lineitem""")
def score_bands_first_match(spark, sf_dir):
    total = F.col("l_quantity") / 5
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", total.alias("total"), evaluation.band(specifications()["pulmonary-embolism-wells-score"]["scoring"]["bands"], total).alias("band"))


@_register("convert_temperature", """
select l_orderkey, l_linenumber, l_linenumber % 3 as pair_index, round(case l_linenumber % 3
  when 0 then case when l_orderkey % 2 = 0 then l_quantity * 1.8 + 32 else (l_quantity - 32) / 1.8 end
  when 1 then case when l_orderkey % 2 = 0 then l_quantity + 273.15 else l_quantity - 273.15 end
  else case when l_orderkey % 2 = 0 then l_quantity * 0.5555555556 + 255.372222 else (l_quantity - 255.372222) / 0.5555555556 end end, 5) as result from lineitem""")
def convert_temperature(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("pair_index"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") % 2 == 1).alias("reverse"))
    return evaluation.convert(df, specifications()["unit-conversions-temperature"]).select("l_orderkey", "l_linenumber", "pair_index", F.round("result", 5).alias("result"))


@_register("tree_walk", """
select c_custkey as subject_id, case
  when c_custkey % 2 = 0 then 'none'
  when c_custkey % 3 = 0 then case when c_custkey % 5 = 0 then 'observe' else 'give_domestic' end
  when c_custkey % 5 <> 0 then 'give_untested' when c_custkey % 7 = 0 then 'give_tested' else 'none_tested' end as node from customer""")
def tree_walk(spark, sf_dir):
    say = lambda c: F.when(c, "Yes").otherwise("no")
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select(k.alias("subject_id"), F.array(say(k % 2 != 0), say(k % 3 != 0), say(k % 5 == 0), say(k % 7 == 0)).alias("answers"))
    return evaluation.tree(df, specifications()["rabies-post-exposure-prophylaxis-treecalc"]).select("subject_id", "node")


LADDER = [{"threshold": float(10 * (i + 1)), "l": 0.5 + i / 10, "m": 10.0 + 3 * i, "s": 0.1 + i / 100} for i in range(10)]
_LADDER_ROWS = ", ".join(f"({r['threshold']}, {r['l']}, {r['m']}, {r['s']})" for r in LADDER)


@_register("ladder_chain", f"""
with r(t, l, m, s) as (values {_LADDER_ROWS})
select p_partkey, (select m from r where p_size * 2.5 < t order by t limit 1)::double as m, (select l from r where p_size * 2.5 < t order by t limit 1)::double as l from part""")
def ladder_chain(spark, sf_dir):
    row = tables.ladder_value(F.col("p_size") * F.lit(2.5), LADDER, ["l", "m"])
    return _table(spark, sf_dir, "part").select("p_partkey", row.alias("r")).select("p_partkey", "r.m", "r.l")


@_register("ladder_join", """
with r as (select p_brand as brand, p_retailprice as threshold, min(p_partkey) as step from part group by 1, 2), k as (select p_partkey, p_brand, p_retailprice * 0.97 as x from part)
select p_partkey, x, threshold, step from k asof left join r on k.p_brand = r.brand and k.x <= r.threshold""")
def ladder_join(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    ladder = part.groupBy(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("threshold")).agg(F.min("p_partkey").alias("step"))
    rows = part.select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_retailprice") * F.lit(0.97)).alias("x"))
    return asof.ladder_join(rows, ladder, "x", ["brand"], "<=").select("p_partkey", "x", "threshold", "step")


@_register("ladder_join_one_key", """
with r as (select p_retailprice as threshold, min(p_partkey) as step from part where p_partkey % 3 = 0 group by 1), k as (select l_orderkey, l_linenumber, l_extendedprice / 40 as x from lineitem)
select l_orderkey, l_linenumber, threshold, step from k asof left join r on k.x < r.threshold""")
def ladder_join_one_key(spark, sf_dir):
    ladder = _table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_retailprice").alias("threshold"), F.col("p_partkey").alias("step"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 40).alias("x"))
    return asof.ladder_join(rows, ladder, "x").select("l_orderkey", "l_linenumber", "threshold", "step")


@_register("ladder_interpolated", """
with r as (select p_brand as brand, p_size::double as threshold, min(p_retailprice) as price from part group by 1, 2), k as (select p_partkey, p_brand as brand, p_retailprice % 60 - 5 as x from part),
h as (select k.*, n.threshold as high, n.price as high_price from k asof left join r n on k.brand = n.brand and k.x <= n.threshold),
b as (select h.*, l.threshold as low, l.price as low_price from h asof left join r l on h.brand = l.brand and h.x > l.threshold)
select p_partkey, round(case when low is null then high_price when high is null then low_price else low_price + (high_price - low_price) * (x - low) / (high - low) end, 6) as price from b""")
def ladder_interpolated(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    ladder = part.groupBy(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("threshold")).agg(F.min("p_retailprice").alias("price"))
    rows = part.select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_retailprice") % 60 - 5).alias("x"))
    return asof.interpolated(rows, ladder, "x", ["price"], ["brand"]).select("p_partkey", F.round("price", 6).alias("price"))


@_register("lms_scores", f"""
with r(t, l, m, s) as (values {_LADDER_ROWS}), k as (select p_partkey, p_size::double as x, p_size + 1.0 as y from part)
select p_partkey, round((pow(y / m, l) - 1) / (l * s), 6) as z from k, lateral (select * from r where x < t order by t limit 1)""")
def lms_scores(spark, sf_dir):
    row = tables.ladder_value(F.col("p_size").cast("double"), LADDER, ["l", "m", "s"])
    z, _ = tables.lms(F.col("p_size") + F.lit(1.0), F.col("r"))
    return _table(spark, sf_dir, "part").select("p_partkey", "p_size", row.alias("r")).select("p_partkey", F.round(z, 6).alias("z"))


NOMOGRAM = [{"h": h, "low": {"photo": p, "exchange": p + 7.0}, "high": {"photo": p - 2.0, "exchange": p + 4.0}} for h, p in ((0.0, 6.0), (24.0, 11.0), (48.0, 14.5), (96.0, 19.0))]


@_register("nomogram", """
with k as (select c_custkey, (c_custkey % 120)::double as age, (5 + c_custkey % 25)::double as level, c_custkey % 3 = 0 as risk from customer),
t as (select *, case when age <= 24 then 6 + age / 24 * 5 when age <= 48 then 11 + (age - 24) / 24 * 3.5 when age <= 96 then 14.5 + (age - 48) / 48 * 4.5 else 19 end as p from k)
select c_custkey as subject_id, round(p - case when risk then 2 else 0 end, 6) as threshold_photo,
  case when level >= p + case when risk then 4 else 7 end then 'exchange' when level >= p - case when risk then 2 else 0 end then 'photo' end as above from t""")
def nomogram(spark, sf_dir):
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select(k.alias("subject_id"), (k % 120).cast("double").alias("age"), (k % 25 + 5).cast("double").alias("level"))
    out = tables.nomogram(df, NOMOGRAM, "age", "level", F.col("subject_id") % 3 == 0, ("photo", "exchange"))
    return out.select("subject_id", F.round("threshold_photo", 6).alias("threshold_photo"), "above")


DRUGS = [
    {"name": "norepinephrine", "routes": [{"label": "IV", "conc": 5.0, "doses": [{"phase": "start", "amt": [0.25, 0.5], "perKg": True, "max": 30.0, "decimals": 2, "unit": "mcg/min"}]}]},
    {"name": "adenosine", "routes": [{"label": "IV", "conc": 3.0, "doses": [{"phase": "first", "amt": 6.0, "perKg": False, "unit": "mg"}, {"phase": "second", "amt": 12.0, "perKg": False, "unit": "mg"}]}]},
]


@_register("dose_table", """
select c_custkey as subject_id, drug, phase, low, high, volume_low from (select c_custkey, 40.0 + c_custkey % 80 as w from customer), lateral (values
  ('norepinephrine', 'start', least(0.25 * w, 30)::double, least(0.5 * w, 30)::double, round((least(0.25 * w, 30) / 5)::double, 2)), ('adenosine', 'first', 6.0::double, 6.0::double, 2.0::double), ('adenosine', 'second', 12.0::double, 12.0::double, 4.0::double)) v(drug, phase, low, high, volume_low)""")
def dose_table(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 80 + 40).alias("weight"))
    out = tables.dose_table(df, DRUGS)
    return out.select("subject_id", "drug", "phase", F.col("low"), F.col("high"), "volume_low")


@_register("equivalents_total", """
select l_orderkey as subject_id, sum(l_quantity * case when l_linenumber % 2 = 0 then 1.5 when l_quantity <= 20 then 4.0 when l_quantity <= 40 then 8.0 when l_quantity <= 60 then 10.0 else 12.0 end)::double as total from lineitem group by 1""")
def equivalents_total(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject_id"), F.expr("case when l_linenumber % 2 = 0 then 'Oxycodone' else 'methadone' end").alias("drug"), F.col("l_quantity").alias("dose"))
    return tables.equivalents(df, {"oxycodone": 1.5})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["formula_cockcroft_gault"](spark, sf_dir)




from carecolumns import form_queries, rule_queries, table_queries, text_queries  # noqa: E402, F401  (they register their queries here)
