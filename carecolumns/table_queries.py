"""Registered queries of operators on tables of definitions: units, ladders from branches, requirements, trees. With their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from carecolumns.operators import reconstruction, requirements, trees, units
from carecolumns.queries import D, _cohort, _cohort_sql, _register, _table
from carecolumns.rule_queries import _spec
from carecolumns.sources.units import canonical, canonical_rows

_KNOWN = "(values " + ", ".join(f"({p}, '{d}', '{b}', '{c}', {f!r}::double, {o!r}::double)" for p, d, b, c, f, o in canonical_rows()) + ") k(place, dimension, base, code, factor, offset_)"
#: A list of units for each part: those of a dimension in turn, its base one of them.
_LISTS = f"(select p_partkey, p_partkey % 12 as place, c.code as base, d.dimension from part join (select *, row_number() over (partition by place order by code) as n, count(*) over (partition by place) as m from {_KNOWN}) c on c.place = p_partkey % 12 and (p_partkey // 12) % c.m + 1 = c.n join (select distinct place, dimension from {_KNOWN}) d on d.place = c.place)"


def _lists(spark, sf_dir):
    """(list, dimension, base): a field for each part, whose base unit is one of a dimension's units in turn."""
    known = canonical(spark)
    names = known.groupBy("place", "dimension").agg(F.sort_array(F.collect_list("code")).alias("codes"))  # twelve rows
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("list"), (F.col("p_partkey") % 12).cast("int").alias("place"))
    return part.join(F.broadcast(names), "place").select("list", "dimension", F.get("codes", (F.floor(F.col("list") / 12) % F.size("codes")).cast("int")).alias("base"))


@_register("units_rebased", f"""
select l.p_partkey as list, k.code, round(k.factor / b.factor, 9) as factor, round((k.offset_ - b.offset_) / b.factor, 9) as added from {_LISTS} l join {_KNOWN} on k.place = l.place join {_KNOWN.replace('k(place', 'b(place')} on b.place = l.place and b.code = l.base""")
def units_rebased(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    own = lists.join(F.broadcast(canonical(spark).select("dimension", "code", "factor", "offset")), "dimension").select("list", "code", "factor", "offset")
    out = units.rebased(own, lists)
    return out.select("list", "code", F.round("factor", 9).alias("factor"), F.round("offset", 9).alias("added"))


@_register("units_offered", f"""
with r as (select l.p_partkey as list, l.base, k.code, k.factor / b.factor as factor, (k.offset_ - b.offset_) / b.factor as o from {_LISTS} l join {_KNOWN} on k.place = l.place join {_KNOWN.replace('k(place', 'b(place')} on b.place = l.place and b.code = l.base)
select list, code from r qualify row_number() over (partition by list, round(factor, 12), round(o, 12) order by case when code = base then 0 else 1 end, length(code) desc, code) = 1""")
def units_offered(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    own = lists.join(F.broadcast(canonical(spark).select("dimension", "code", "factor", "offset")), "dimension").select("list", "code", "factor", "offset")
    return units.one_per_scale(units.rebased(own, lists)).select("list", "code")


@_register("units_filled", f"""
with u as (select p_partkey, dimension, upper(base) as code, case when p_partkey % 3 = 0 then 2.5::double end as factor from {_LISTS} l union all select p_partkey, 'fraction', case when p_partkey % 2 = 0 then 'Litres O2' else 'nothing' end, null from part)
select u.p_partkey as list, u.code, round(coalesce(u.factor, k.factor, case when u.code = 'Litres O2' then 1.0::double end), 12) as factor, case when u.factor is not null then 'stated' when k.factor is not null then 'canonical' when u.code = 'Litres O2' then 'passed through' end as source
from u left join {_KNOWN} on k.dimension = u.dimension and k.code = regexp_replace(lower(u.code), '[^a-z0-9%]', '', 'g')""")
def units_filled(spark, sf_dir):
    own = _lists(spark, sf_dir).select("list", "dimension", F.upper("base").alias("code"), F.when(F.col("list") % 3 == 0, 2.5).alias("factor"), F.lit(None).cast("double").alias("offset"))
    more = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("list"), F.lit("fraction").alias("dimension"), F.when(F.col("p_partkey") % 2 == 0, "Litres O2").otherwise("nothing").alias("code"), F.lit(None).cast("double").alias("factor"), F.lit(None).cast("double").alias("offset"))
    return units.filled(own.unionByName(more)).select("list", "code", F.round("factor", 12).alias("factor"), "source")


@_register("dimensions_inferred", f"""
with c as (select p_partkey as list, unnest([base, case when p_partkey % 4 = 0 then 'mg/dL' else base end, case when p_partkey % 5 = 0 then 'stones' end, case when p_partkey % 5 = 0 then 'rods' end, case when p_partkey % 10 = 0 then 'furlongs' end]) as code from {_LISTS} l),
n as (select list, regexp_replace(lower(code), '[^a-z0-9%]', '', 'g') as code from c where code is not null),
h as (select n.list, k.place, k.dimension, count(*) as hits from n join {_KNOWN} on k.code = n.code group by all),
t as (select list, count(*) as codes from n group by 1),
b as (select * from h qualify row_number() over (partition by list order by hits desc, place) = 1)
select t.list, case when b.hits >= greatest(1, t.codes // 2) then b.dimension end as dimension from t left join b using (list)""")
def dimensions_inferred(spark, sf_dir):
    n, base = F.col("list"), F.col("base")
    codes = _lists(spark, sf_dir).select("list", F.explode(F.array(base, F.when(n % 4 == 0, "mg/dL").otherwise(base), F.when(n % 5 == 0, "stones"), F.when(n % 5 == 0, "rods"), F.when(n % 10 == 0, "furlongs"))).alias("code"))
    return units.dimension_of(codes)


@_register("compound_units", """
with u as (select l_orderkey, l_linenumber, l_quantity as v, (l_orderkey + l_linenumber) % 5 as k from lineitem)
select l_orderkey, l_linenumber, round(case k when 0 then v * 60 / 1000 when 1 then v * 100 when 2 then v * 0.45359237 / 24 when 4 then null else null end, 9) as converted from u""")
def compound_units(spark, sf_dir):
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    say = lambda *names: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), say("mcg/kg/minute", "g/dL", "lbs/day", "mg/kg", "mg/fortnight").alias("a"), say("mg/kg/hr", "mg/mL", "kg/hour", "mg/mL", "mg/hr").alias("b"))
    # 10 mg/mL make a g/dL
    df = df.withColumn("v", F.when(k == 1, F.col("v") * 10).otherwise(F.col("v")))
    return units.converted(df, "v", "a", "b").select("l_orderkey", "l_linenumber", F.round("converted", 9).alias("converted"))


@_register("units_along_paths", """
with recursive e as (select s_suppkey as a, s_suppkey - 1 as b, 1 + (s_suppkey % 7) / 8.0 as f, (s_suppkey % 3)::double as o from supplier where s_suppkey % 10 <> 0),
w as (select s_suppkey as unit, s_suppkey as base, 1.0::double as factor, 0.0::double as o, 0 as steps from supplier where s_suppkey % 10 = 0
  union all select e.a, w.base, e.f * w.factor, e.o * w.factor + w.o, w.steps + 1 from w join e on e.b = w.unit)
select 'u' || unit as unit, 'u' || base as base, round(factor, 6) as factor, round(o, 6) as added, steps from w""")
def units_along_paths(spark, sf_dir):
    k = F.col("s_suppkey")
    supplier = _table(spark, sf_dir, "supplier")
    unit = lambda c: F.concat(F.lit("u"), c.cast("string"))
    # every second pair is stated backwards
    f, o = 1 + (k % 7) / 8, (k % 3).cast("double")
    back = k % 2 == 1
    pairs = supplier.where(k % 10 != 0).select(F.when(back, unit(k - 1)).otherwise(unit(k)).alias("from"), F.when(back, unit(k)).otherwise(unit(k - 1)).alias("to"), F.when(back, 1 / f).otherwise(f).alias("factor"), F.when(back, -o / f).otherwise(o).alias("offset"))
    bases = supplier.where(k % 10 == 0).select(unit(k).alias("base"))
    return units.along_paths(pairs, bases).select("unit", "base", F.round("factor", 6).alias("factor"), F.round("offset", 6).alias("added"), "steps")


@_register("ladders_reconstructed", """
with b as (select user_id as source, event_id as position, case when event_type in ('view', 'click', 'error') then 'age' else 'length' end as key, floor(value * 2)::double as threshold, case when event_id % 5 <> 0 then round(value, 1) end as m, (event_id % 7)::double as s from events),
r as (select *, sum(case when key = lk and threshold >= lt then 0 else 1 end) over (partition by source order by position) as run from (select *, lag(key) over w as lk, lag(threshold) over w as lt from b window w as (partition by source order by position))),
st as (select * from r qualify row_number() over (partition by source, run, threshold order by (m is not null)::int desc, position desc) = 1),
u as (select source, run, any_value(key) as key, min(threshold) as low, max(threshold) as high, list(threshold || ' ' || coalesce(m::varchar, '') || ' ' || s order by threshold) as sig from st group by 1, 2 having count(*) >= 2),
d as (select * from u qualify row_number() over (partition by source, key, sig order by run) = 1),
g as (select *, sum(case when fwd then 0 else 1 end) over (partition by source order by run) as ladder from (select *, coalesce(key = lag(key) over w and low >= lag(high) over w - 1e-9 and high > lag(high) over w and low > lag(low) over w, false) as fwd, coalesce(key = lag(key) over w, false) as alike from d window w as (partition by source order by run))),
f as (select source, ladder, arg_min(alike, run) as restarts from g group by 1, 2)
select st.source, g.ladder::int as ladder, st.key, st.threshold, st.m, st.s, f.restarts from st join g on g.source = st.source and g.run = st.run join f on f.source = g.source and f.ladder = g.ladder
qualify row_number() over (partition by st.source, g.ladder, st.threshold order by st.run) = 1""")
def ladders_reconstructed(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    branches = e.select(F.col("user_id").alias("source"), F.col("event_id").alias("position"), F.when(F.col("event_type").isin("view", "click", "error"), "age").otherwise("length").alias("key"), F.lit("<").alias("operator"), F.floor(F.col("value") * 2).cast("double").alias("threshold"), F.when(F.col("event_id") % 5 != 0, F.round("value", 1)).alias("m"), (F.col("event_id") % 7).cast("double").alias("s"))
    return reconstruction.ladders(branches, ["m", "s"], 2).select("source", "ladder", "key", "threshold", "m", "s", "restarts")


_INFUSION = _spec([{"key": "concentration", "required": True}, {"key": "weight", "required": True}, {"key": "rate", "required": True}, {"key": "amount", "required": True}, {"key": "volume", "required": True}, {"key": "note", "required": True}],
    {"dose": "rate * strength / weight"}, {"strength": "amount / volume if concentration == 0 else concentration"})
_INFUSED = {"concentration": D("k % 3"), "weight": D("40 + k % 50"), "rate": D("1 + k % 9"), "amount": "case when k % 7 <> 0 then " + D("k % 20 * 5") + " end", "volume": "case when k % 5 <> 0 then " + D("k % 4 * 50") + " end", "note": D("7")}


_LEFT_OUT = f"""
with k as (select *, case when concentration = 0 then amount is not null and coalesce(volume, 0) <> 0 else true end as whole from {_cohort_sql(**_INFUSED)}),
f as (select concentration, field, given, case field when 'note' then true when 'amount' then concentration <> 0 when 'volume' then concentration <> 0 else false end as computes from k, lateral (values ('weight', true), ('rate', true), ('amount', amount is not null), ('volume', volume is not null), ('note', true)) v(field, given) where whole)
select case concentration when 0 then '0.0' when 1 then '1.0' else '2.0' end as option, field, count(*) as rows, count(*) filter (computes) as computes from f where given group by 1, 2"""


@_register("fields_left_out", _LEFT_OUT)
def fields_left_out(spark, sf_dir):
    return requirements.leave_one_out(_cohort(spark, sf_dir, **_INFUSED), _INFUSION, "concentration")


@_register("requirements_inferred", f"""
with g as (select field, coalesce(string_agg(option, ',' order by option) filter (computes < rows), '') as needed, coalesce(string_agg(option, ',' order by option) filter (computes = rows), '') as spare from ({_LEFT_OUT}) group by 1)
select *, case when needed = '' then 'never' when spare = '' then 'always' else 'sometimes' end as rule from g""")
def requirements_inferred(spark, sf_dir):
    found = requirements.leave_one_out(_cohort(spark, sf_dir, **_INFUSED), _INFUSION, "concentration")
    return requirements.requirements(found).select("field", F.array_join("needed", ",").alias("needed"), F.array_join("spare", ",").alias("spare"), "rule")


#: A tree a nation: from node n, yes leads to 2 n + 1 and no to n + 3, up to 40 + the nation's key.
@_register("tree_tables_walked", """
with recursive s as (select c_custkey as subject, c_nationkey as tree, 40 + c_nationkey as top from customer),
w as (select subject, tree, top, 0 as node, 0 as steps from s
  union all select subject, tree, top, case when (subject // (1 + steps)) % 3 = 0 then 2 * node + 1 else node + 3 end, steps + 1 from w where node <= top and steps < 12 + subject % 5)
select subject, tree, 'n' || node as node, steps from w qualify row_number() over (partition by subject order by steps desc) = 1""")
def tree_tables_walked(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tree"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = nation.select("tree", F.explode(F.sequence(F.lit(0), (F.col("tree") + 40).cast("int"))).alias("n"))
    edges = nodes.select("tree", name(F.col("n")).alias("node"), F.explode(F.array(F.struct(F.lit(True).alias("yes"), name(2 * F.col("n") + 1).alias("to")), F.struct(F.lit(False).alias("yes"), name(F.col("n") + 3).alias("to")))).alias("x")).select("tree", "node", "x.yes", "x.to")
    k = F.col("c_custkey")
    answers = F.transform(F.sequence(F.lit(0), (11 + k % 5).cast("int")), lambda i: F.when(F.floor(k / (1 + i)) % 3 == 0, "Yes").otherwise("no"))
    subjects = _table(spark, sf_dir, "customer").select(k.alias("subject"), F.col("c_nationkey").cast("long").alias("tree"), answers.alias("answers"))
    return trees.walk(subjects, edges, nation.select("tree", F.lit("n0").alias("root")))


#: Suppliers point to one another: circles where the keys go round.
@_register("tree_circles", """
with recursive n as (select s_suppkey as a, (s_suppkey * 7 + 3) % (select count(*) from supplier) as b, 1 as tree from supplier where s_suppkey % 25 <> 0),
e as (select * from n), r as (select tree, a as origin, b as here, 1 as steps from e union all select r.tree, r.origin, e.b, steps + 1 from r join e on e.tree = r.tree and e.a = r.here where steps < 200)
select distinct tree, origin as node from r where origin = here""")
def tree_circles(spark, sf_dir):
    supplier = _table(spark, sf_dir, "supplier")
    n = supplier.agg(F.count("*").alias("n"))
    k = F.col("s_suppkey")
    edges = supplier.where(k % 25 != 0).join(F.broadcast(n)).select(F.lit(1).alias("tree"), k.alias("node"), ((k * 7 + 3) % F.col("n")).alias("to"))
    return trees.circles(edges)
