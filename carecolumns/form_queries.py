"""Registered queries of requests, random vectors, forms and build reports over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from carecolumns.operators import differential, evaluation, forms
from carecolumns.queries import _register, _table
from carecolumns.rule_queries import _OF_PARTS, _catalogue
from carecolumns.sources import requests
from carecolumns.sources.definitions import specifications

_BODY = """case c_custkey % 6
  when 0 then '{"inputs": {"na": ' || (140 + c_custkey % 9) || ', "cl": "100"}, "units": {"na": "mEq/L"}}'
  when 1 then '{"NA": 141, "Chloride": ' || (100 + c_custkey % 7) || ', "hco3": 20, "_trace": "x", "weird": [1, 2]}'
  when 2 then '{"na": 1' when 3 then '[1, 2]'
  when 4 then '{"inputs": {"na": 1, "cl": 2, "hco3": null}, "na": ' || c_custkey || ', "answers": ["yes", "no"], "value": 3.5, "reverse": true, "pair_index": 2, "selections": {"g": "a", "h": ["b", "c"]}}'
  else case when c_custkey % 4 = 1 then '  ' end end"""


def _labelled():
    spec = dict(specifications()["anion-gap"])
    return spec | {"display": {}, "inputs": [{**f, "label": label} for f, label in zip(spec["inputs"], ("Serum Sodium", "Chloride", "Bicarbonate"), strict=True)]}


@_register("requests_nested_or_flat", """
with k as (select c_custkey as subject_id, c_custkey % 6 as m from customer)
select subject_id, case m when 2 then 'no JSON' when 3 then 'no object' end as problem, case m when 0 then (140 + subject_id % 9)::varchar when 1 then '141' when 4 then subject_id::varchar end as na, case m when 0 then '100' when 1 then (100 + subject_id % 7)::varchar when 4 then '2' end as cl,
  case m when 1 then '20' end as hco3, case m when 0 then 'mEq/L' end as unit, case m when 1 then 'weird' else '' end as unknown, case m when 4 then 'yes,no' else '' end as answers, case m when 4 then 3.5::double end as value, m = 4 as reverse, case m when 4 then 2 end as pair_index, case m when 4 then 'a|b,c' else '' end as picks,
  case m when 1 then round((21 - subject_id % 7)::double, 6) end as gap from k""")
def requests_nested_or_flat(spark, sf_dir):
    body = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.expr(_BODY).alias("body"))
    rows = requests.as_columns(requests.parsed(body, "body"), _labelled())
    out = evaluation.formula(rows.withColumn("cl__unit", F.lit(None).cast("string")).drop("na__unit").withColumn("unit", F.try_element_at("request.units", F.lit("na"))), _labelled(), strict_units=False)
    picks = F.concat_ws("|", F.array_join(F.try_element_at("request.selections", F.lit("g")), ","), F.array_join(F.try_element_at("request.selections", F.lit("h")), ","))
    return out.select(
        "subject_id", "problem", "na", "cl", "hco3", "unit", F.array_join("unknown", ",").alias("unknown"), F.array_join("request.answers", ",").alias("answers"), "request.value", "request.reverse", "request.pair_index", picks.alias("picks"),
        F.when(F.col("ok") & (F.col("subject_id") % 6 == 1), F.round("outputs.ag.value", 6)).alias("gap"),
    )


def _published() -> dict:
    """The anion gap with a fault of its own above 150 of sodium."""
    spec = dict(specifications()["anion-gap"]) | {"display": {}}
    return spec | {"compute": {"steps": [], "outputs": [{"key": "gap", "expr": "na - cl if na > 150 else na - (cl + hco3)"}]}}


def _drawn(spec: dict, seed: int) -> str:
    """SQL of the vectors of a specification over customers."""
    cells = []
    for f in spec["inputs"]:
        c = f.get("constraints") or {}
        low = float(c.get("min", c.get("exclusive_min", 1.0)))
        high = float(c.get("max", c.get("exclusive_max", max(low + 100, 100.0))))
        low = max(low, 1e-3) if low <= 0 < high else low
        cells.append(f"round({low!r}::double + {high - low!r}::double * (('0x' || substr(md5('{seed}:{f['key']}:' || c_custkey), 1, 12))::bigint / {float(16**12)!r}::double), 4) as {f['key']}")
    return f"(select c_custkey, {', '.join(cells)} from customer)"


@_register("differential_vectors", f"""
with v as (select *, na - (cl + hco3) as a, case when na > 150 then na - cl else na - (cl + hco3) end as b from {_drawn(specifications()["anion-gap"], 7)})
select 'ag' as output, count(*) as vectors, count(*) as compared, count(*) filter (abs(a - b) > 1e-6 * greatest(1, abs(a), abs(b))) as mismatches, 0 as built_failures, 0 as published_failures,
  round(100.0::double * count(*) filter (abs(a - b) <= 1e-6 * greatest(1, abs(a), abs(b))) / count(*), 4) as agreement from v""")
def differential_vectors(spark, sf_dir):
    spec = dict(specifications()["anion-gap"]) | {"display": {}}
    drawn = differential.vectors(_table(spark, sf_dir, "customer"), "c_custkey", spec)
    return differential.agreement(differential.differences(drawn, spec, _published(), {"ag": "gap"}))


@_register("primary_outputs", """
with p as (select p_partkey, p_partkey % 4 as m, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part)
select 'part-' || p_partkey as slug, case m when 0 then 'second' when 1 then case when length(b) > 3 then 'second' else 'first' end when 2 then 'first' else case when length(b) > length(a) and length(b) > 3 then 'second' else 'first' end end as output from p""")
def primary_outputs(spark, sf_dir):
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    first = F.when(k % 4 == 3, a).otherwise("Qqqq zz")
    second = F.when(k % 4 == 0, F.upper("p_name")).when((k % 4 == 1) | (k % 4 == 3), b).otherwise("Xxxx yy")
    document = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("first").alias("key"), first.alias("label")), F.struct(F.lit("second").alias("key"), second.alias("label"))).alias("outputs")).alias("compute")))
    return forms.primary_outputs(part.select(F.concat(F.lit("part-"), k).alias("slug"), F.col("p_name").alias("title"), document.alias("document")))


@_register("form_steps", """
select p_partkey, case when p_size % 4 = 0 then 0.1::double when p_partkey % 4 < 2 and abs(p_size - 20) between 1 and 10 then 0.1 when p_partkey % 3 = 0 then 0.1 when p_partkey % 2 = 0 then 1.0 else 0.1 end as step from part""")
def form_steps(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    fields = _table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "number").otherwise("select").alias("widget"), F.when(k % 3 == 0, "mass").otherwise("length").alias("dimension"), F.when(s % 4 == 0, 1.0).when(k % 4 < 2, 20.0).alias("low"), F.when(s % 4 == 0, 5.5).otherwise(s.cast("double")).alias("high"))
    return forms.step_sizes(fields).select("p_partkey", "step")


@_register("build_coverage", f"""
with p as (select * from {_OF_PARTS})
select 'specifications' as measure, count(*) as n from p union all select 'specifications with a category', count(category) from p union all select 'fields', 3 * count(*) from p where renderer = 'formula'
union all select 'fields with bounds', 2 * count(*) from p where renderer = 'formula' union all select 'fields with units', 0 union all select 'renderer ' || renderer, count(*) from p group by renderer""")
def build_coverage(spark, sf_dir):
    return forms.coverage(_catalogue(spark, sf_dir))


_SEVERITY = "case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end"


@_register("review_queue", f"""
select severity, o_orderkey, urgency from (select {_SEVERITY} as severity, o_orderkey, case left(o_orderpriority, 1) when '1' then 0 when '2' then 1 when '3' then 2 else 3 end as urgency from orders)
order by urgency, '{{"severity":"' || severity || '","o_orderkey":' || o_orderkey || '}}' limit 2000""")
def review_queue(spark, sf_dir):
    return forms.review_queue(_table(spark, sf_dir, "orders").select(F.expr(_SEVERITY).alias("severity"), "o_orderkey"), 2000)


@_register("units_for_fields", """
with f as (select p_partkey, replace(p_name, ' ', '_') as field, case p_partkey % 3 when 0 then left(split_part(p_name, ' ', 2), 2) when 1 then 'zz' end as base, regexp_replace(p_name, '[^a-z0-9]', '', 'g') as name from part),
l as (select 'of_' || split_part(p_name, ' ', 2) as stem, split_part(p_name, ' ', 2) as word, min(p_partkey) as position, left(split_part(p_name, ' ', 2), 2) as code from part where p_partkey % 2 = 0 group by all),
c as (select code, arg_min(stem, position) as stem from l group by 1),
n as (select f.p_partkey, arg_min(l.stem, l.position) as stem from f join l on length(l.word) >= 3 and length(f.name) >= 3 and (contains(f.name, l.word) or contains(l.word, f.name)) group by 1)
select f.p_partkey, coalesce(c.stem, n.stem) as stem from f left join c on c.code = f.base left join n on n.p_partkey = f.p_partkey""")
def units_for_fields(spark, sf_dir):
    part, k, noun = _table(spark, sf_dir, "part"), F.col("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(2))
    lists = part.where(k % 2 == 0).groupBy(noun.alias("noun")).agg(F.min(k).alias("position")).select(F.concat(F.lit("of_"), "noun").alias("stem"), "position", F.upper(F.substring("noun", 1, 2)).alias("code"))
    fields = part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("field"), F.when(k % 3 == 0, F.substring(noun, 1, 2)).when(k % 3 == 1, "zz").alias("base"))
    return forms.units_for_fields(fields, lists).select("p_partkey", "stem")
