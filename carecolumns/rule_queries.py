"""Registered queries of single rules: functions, conditions, reference tables, the catalogue and its checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from carecolumns.operators import checks, evaluation
from carecolumns.operators.inputs import by_any_name
from carecolumns.queries import D, QUERIES, ORACLE, _cohort, _cohort_sql, _formula, _register, _table
from carecolumns.sources import catalog
from carecolumns.sources.definitions import specifications


def _spec(inputs: list[dict], outputs: dict[str, str], steps: dict[str, str] | None = None, **more) -> dict:
    compute = {"steps": [{"key": k, "expr": e} for k, e in (steps or {}).items()], "outputs": [{"key": k, "expr": e} for k, e in outputs.items()]}
    return {"slug": "made", "title": "Made", "renderer": "formula", "inputs": inputs, "compute": compute | more.pop("compute", {}), **more}


def _made(name: str, spec: dict, fields: dict[str, str], sql: dict[str, str], digits: int = 6) -> None:
    """Register a specification over a cohort: ok and every output, numbers rounded to `digits` on both sides."""
    texts = {k for k in sql if k.endswith("_text")}

    def run(spark, sf_dir):
        out = evaluation.formula(_cohort(spark, sf_dir, **fields), spec)
        shown = [F.col(f"outputs.`{k}`.text").alias(k) if k in texts else F.round(F.col(f"outputs.`{k}`.value"), digits).alias(k) for k in sql if k != "ok"]
        return out.select(F.col("k").alias("subject_id"), "ok", *shown)

    ok = sql.get("ok", "true")
    parts = ", ".join(f"case when {ok} then {e if k in texts else f'round({e}, {digits})'} end as {k}" for k, e in sql.items() if k != "ok")
    QUERIES[name] = run
    ORACLE[name] = f"select k as subject_id, coalesce({ok}, false) as ok, {parts} from {_cohort_sql(**fields)}"


X, Y = {"key": "x", "required": True}, {"key": "y", "required": True}
XY = {"x": D("1 + k % 90") + " / 10", "y": D("k % 61 - 30")}

_made("functions_arithmetic", _spec([X, Y], {
    "power": "x ** 2", "powered": "pow(x, 0.5)", "remainder": "y % 7", "turned": "-x + +y", "denied": "1 if not x > 5 else 0", "both_hold": "1 if x > 2 and y < 3 else 0", "either_holds": "1 if x > 8 || y < 0 else 0",
    "chained": "1 if 2 < x <= 6 else 0", "least_of": "min(x, y, 3)", "most_of": "max(x, y)", "size": "abs(y)", "circle": "pi * x", "rest": "doCalc + retval", "unit": "getOutputUnit('mg')",
}), XY, {
    "power": "x * x", "powered": "sqrt(x)", "remainder": "y - 7 * floor(y / 7)", "turned": "y - x", "denied": "case when x > 5 then 0 else 1 end", "both_hold": "case when x > 2 and y < 3 then 1 else 0 end", "either_holds": "case when x > 8 or y < 0 then 1 else 0 end",
    "chained": "case when x > 2 and x <= 6 then 1 else 0 end", "least_of": "least(x, y, 3)", "most_of": "greatest(x, y)", "size": "abs(y)", "circle": "pi() * x", "rest": "1::double", "unit": "1::double",
})

_made("functions_transcendental", _spec([X, Y], {
    "growth": "exp(x / 3)", "natural_log": "ln(x)", "natural_log_too": "log(x)", "common": "log10(x)", "root": "sqrt(x)", "sine": "sin(x)", "cosine": "cos(x)", "tangent": "tan(x / 9)", "angle": "atan(y)", "below": "floor(y / 4)", "above": "ceil(y / 4)",
    "percentile": "z_to_percentile(y / 10)", "percentile_too": "ZtoPercentile(x - 4)",
}), XY, {
    "growth": "exp(x / 3)", "natural_log": "ln(x)", "natural_log_too": "ln(x)", "common": "log10(x)", "root": "sqrt(x)", "sine": "sin(x)", "cosine": "cos(x)", "tangent": "tan(x / 9)", "angle": "atan(y)", "below": "floor(y / 4)", "above": "ceil(y / 4)",
    # the normal distribution as the series of its odd powers over double factorials
    **{n: f"100 * (0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum([pow({z}, 2 * n + 1) * sqrt(pi()) / (pow(2::double, n + 1) * gamma(n + 1.5)) for n in range(0, 80)]))" for n, z in (("percentile", "y / 10"), ("percentile_too", "x - 4"))},
})

_made("functions_rounding_and_units", _spec([X, Y], {
    "whole": "round(x)", "places": "round(x / 7, 2)", "tens": "round(100 * x, -1)", "decimals": "roundToNumberOfDecimals(y / 7, 3)", **{f"nearest{n}": f"roundToNearest{n}(37 * x)" for n in (5, 10, 25, 50, 100)},
    "kg": "lbs_to_kg(x)", "lbs": "kg_to_lbs(x)", "cm": "in_to_cm(x)", "inches": "cm_to_in(x)", "spoons": "mL_to_tsp(x)", "ml": "tsp_to_mL(x)",
}), XY, {
    "whole": "round_even(x, 0)", "places": "round_even(x / 7, 2)", "tens": "round_even(100 * x / 10, 0) * 10", "decimals": "round_even(y / 7, 3)", **{f"nearest{n}": f"round_even(37 * x / {n}.0::double, 0) * {n}" for n in (5, 10, 25, 50, 100)},
    "kg": "x * 0.45359237", "lbs": "x / 0.45359237", "cm": "x * 2.54", "inches": "x / 2.54", "spoons": "x / 4.92892159375", "ml": "x * 4.92892159375",
})

_made("functions_failing_rows", _spec([X, Y], {"ratio": "x / y if y != 0 else 0", "logarithm": "ln(y)", "root": "sqrt(y + 10)"}), XY, {"ok": "y > 0", "ratio": "x / nullif(y, 0)", "logarithm": "ln(case when y > 0 then y end)", "root": "sqrt(case when y > -10 then y + 10 end)"})

_made("option_order", _spec([
    # an earlier option's label equals a later one's value: options are tried one by one
    {"key": "c", "required": True, "options": [{"value": 1.0, "label": "2", "key": "a"}, {"value": 2.0, "label": "two", "key": "b"}, {"value": 3.0, "label": "Three", "key": "2.0"}, {"value": "x", "label": "4", "key": "d"}]},
], {"number": "1 if c == 'x' else 10 * c", "means_text": "c if c == 'x' else 'number'"}), {"c": "case k % 9 when 0 then '2' when 1 then '2.0' when 2 then 'two' when 3 then 'Three' when 4 then 'three' when 5 then '4' when 6 then 'd' when 7 then '3' else '5' end"}, {
    "ok": "c <> '5'", "number": "case when c in ('4', 'd') then 1 when c = '2' then 10 when c in ('2.0', 'two') then 20 else 30 end::double", "means_text": "case when c in ('4', 'd') then 'x' else 'number' end",
})

_made("defaults_and_unanswered_controls", _spec([
    {"key": "mode", "options": [{"value": 0.0, "label": "off"}, {"value": 1.0, "label": "on"}], "default": 1.0},
    {"key": "extra", "required": False, "required_when": {"field": "mode", "equals": ["1.0"]}, "default": 7.0},
    {"key": "base", "required": True},
], {"total": "base + extra * mode"}), {"mode": "case k % 3 when 0 then '1' when 1 then 'off' end", "extra": "case when k % 4 = 0 then cast(k % 50 as varchar(9)) end", "base": D("k % 10")}, {
    # a control that is not answered asks for nothing, whatever its default
    "ok": "(extra is not null or mode is null or mode <> '1')", "total": "base + case when mode = 'off' then 0 else 1 end * coalesce(cast(extra as double), 7)",
})

_made("variants", _spec([{"key": "kind", "required": True, "options": [{"value": 1.0, "label": "one"}, {"value": 2.0, "label": "two"}]}, X], {"line": "slope * x + offset"}, compute={"variants": {"kind": {"variables": ["slope", "offset"], "options": [
    {"value": 1.0, "constants": {"slope": 0.5, "offset": -3.0}}, {"value": 2.0, "constants": {"slope": 4.0, "offset": 0.25}}]}}}),
    {"kind": "case when k % 2 = 0 then 'one' else '2' end", "x": D("k % 40")}, {"line": "case when kind = 'one' then 0.5 * x - 3 else 4 * x + 0.25 end"})

_CLEARANCE = "least(150, case when id_gender = 'MALE' then id_k_age_m else id_k_age_f end * height / sr_cr)"
_MG = f"(7 * {_CLEARANCE} * sqrt(weight * height / 3600))"
_formula("formula_visible_when", "valganciclovir",
    {"form": D("2"), "height": D("60 + k % 120"), "weight": D("5 + k % 60"), "sr_cr": D("3 + k % 12") + " / 10", "id_gender": "case when k % 2 = 0 then 'MALE' else 'FEMALE' end", "id_k_age_m": "case when k % 4 < 3 then cast(0.45 as double) end", "id_k_age_f": "case when k % 6 <> 1 then cast(0.55 as double) end"},
    {"output_dose_mg": f"case when {_MG} > 900 then 900 when {_MG} >= 20 then round_even({_MG} / 10, 0) * 10 else round_even({_MG} / 5, 0) * 5 end", "valid": "(case when id_gender = 'MALE' then id_k_age_m else id_k_age_f end is not null)"})

_DAY = 86_400_000
_formula("formula_dates", "gestational-age",
    {"crown_rump_length": D("10 + k % 80"), "biparietal_diameter": D("20 + k % 70"), "head_circumference": D("80 + k % 240"), "current_time": "case when k % 2 = 0 then '2026-09-01' else '2026-10-15T00:00:00Z' end", "us_time": "'2026-08-01'", "lmp_time": "'2026-01-01T12:00:00Z'"},
    {"lmpweeks": "(case when k % 2 = 0 then epoch_ms(timestamp '2026-09-01') else epoch_ms(timestamp '2026-10-15') end - epoch_ms(timestamp '2026-01-01 12:00:00')) / 604800000.0", "bpdweeks": "(2 * biparietal_diameter + 44.2) / 7", "crlweeks": "5.2876 + 0.1584 * crown_rump_length - 0.0007 * crown_rump_length * crown_rump_length",
     "edc_lmp": f"(epoch_ms(timestamp '2026-01-01 12:00:00') + 280::bigint * {_DAY})::double"}, 4)


GROWTH = [{"key": "months", "operator": "<", "columns": ["L", "M", "S"], "select_key": "sex", "select_value": float(s), "fallback": None if s == 1 else {"L": 1.0, "M": 80.0, "S": 0.05}, "rows": [{"threshold": float(m + 1), "L": 0.4 + m / 200 + s / 10, "M": 45.0 + 0.8 * m - s, "S": 0.03 + m / 5000} for m in range(90)]} for s in (1, 2)]
GROWTH_SPEC = _spec([{"key": "years", "required": True}, {"key": "height", "required": True}, {"key": "sex", "required": True, "options": [{"value": 1.0, "label": "boy"}, {"value": 2.0, "label": "girl"}]}],
    {"z": "(pow(height / M, L) - 1) / (L * S)", "percentile": "z_to_percentile(z)", "median": "M"}, {"months": "years * 12"}, tables={"lookups": GROWTH})
_GROWTH_ROWS = ", ".join(f"({t['select_value']}, {i}, {r['threshold']}, {r['L']!r}, {r['M']!r}, {r['S']!r})" for t in GROWTH for i, r in enumerate(t["rows"]))
_GROWTH = {"years": D("k % 97") + " / 12", "height": D("40 + k % 90"), "sex": D("1 + k % 2")}
_GROWTH_SQL = f"""
with r(sex, i, t, l, m, s) as (select sex::double, i::int, t::double, l::double, m::double, s::double from (values {_GROWTH_ROWS}) v(sex, i, t, l, m, s)),
k as (select k, sex, height, years, years * 12 as months from {_cohort_sql(**_GROWTH)}),
j as (select k.*, coalesce(r.l, case when k.sex = 2 then 1.0::double end) as l, coalesce(r.m, case when k.sex = 2 then 80.0::double end) as m, coalesce(r.s, case when k.sex = 2 then 0.05::double end) as s, r.i, r.t
  from k left join lateral (select * from r where r.sex = k.sex and k.months < r.t order by r.t limit 1) r on true)"""


@_register("formula_lms_ladder", _GROWTH_SQL + "select k as subject_id, m is not null as ok, round((pow(height / m, l) - 1) / (l * s), 6) as z, round(m, 6) as median from j")
def formula_lms_ladder(spark, sf_dir):
    out = evaluation.formula(_cohort(spark, sf_dir, **_GROWTH), GROWTH_SPEC)
    return out.select(F.col("k").alias("subject_id"), "ok", F.round("outputs.z.value", 6).alias("z"), F.round("outputs.median.value", 6).alias("median"))


@_register("lookups_used", _GROWTH_SQL + """
select k as subject_id, case when m is not null then coalesce(i, 89) end as row_index, case when m is not null then coalesce(t, 90.0) end as threshold, case when m is not null then i is null end as outside,
  case when m is not null and i is null then 1 else 0 end as warnings from j""")
def lookups_used(spark, sf_dir):
    out = evaluation.formula(_cohort(spark, sf_dir, **_GROWTH), GROWTH_SPEC, lookups=True)
    row = F.get("lookups_used", F.lit(0))
    return out.select(F.col("k").alias("subject_id"), row["row_index"].alias("row_index"), row["threshold"].alias("threshold"), row["outside"].alias("outside"), F.size("warnings").alias("warnings"))


@_register("fields_by_label", f"select k as subject_id, round(142 + k % 9 - (100 + k % 7 + 22), 6) as ag, 'extra' as unknown from {_cohort_sql(z='0')}")
def fields_by_label(spark, sf_dir):
    spec = dict(specifications()["anion-gap"]) | {"display": {}, "inputs": [{**f, "label": label} for f, label in zip(specifications()["anion-gap"]["inputs"], ("Serum Sodium", "Chloride", "Bicarbonate"), strict=True)]}
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("extra"), F.expr("142 + c_custkey % 9").alias("serum sodium"), F.expr("100 + c_custkey % 7").alias("CL"), F.lit(22).alias("bicarbonate"))
    named, unknown = by_any_name(df, spec)
    return evaluation.formula(named, spec).select(F.col("extra").alias("subject_id"), F.round("outputs.ag.value", 6).alias("ag"), F.lit(",".join(unknown)).alias("unknown"))


def _parts(spark, sf_dir):
    """Parts as a catalogue: names as titles, types as categories."""
    return _table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("category"), F.lit("part").alias("renderer"))


_PARTS = "(select p_name as title, 'part-' || p_partkey as slug, case when p_partkey % 11 <> 0 then p_type end as category from part)"


@_register("catalog_search", rf"""
with n as (select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as t, trim(regexp_replace(lower(title || ' ' || slug || ' ' || coalesce(category, '')), '[^a-z0-9]+', ' ', 'g')) as hay from {_PARTS})
select slug, title, case when t like '{{0}}%' then 0 when t like '%{{0}}%' then 1 when t like '%{{1}}%' and t like '%{{2}}%' then 2 else 3 end as rank from n where hay like '%{{1}}%' and hay like '%{{2}}%'""".format("part 1", "part", "1"))
def catalog_search(spark, sf_dir):
    return catalog.search(_parts(spark, sf_dir), "Part: 1").select("slug", "title", F.col("rank").cast("int").alias("rank"))


@_register("catalog_filter", f"select slug, title from {_PARTS} where category is null")
def catalog_filter(spark, sf_dir):
    return catalog.search(_parts(spark, sf_dir), None, category="Uncategorised", renderer="part").select("slug", "title")


@_register("catalog_page", f"select slug, title from {_PARTS} order by lower(title), slug limit 20 offset 30")
def catalog_page(spark, sf_dir):
    return catalog.page(catalog.names(_parts(spark, sf_dir)), 20, 30)


@_register("catalog_counts", f"select coalesce(category, 'Uncategorised') as category, count(*) as specifications from {_PARTS} group by 1")
def catalog_counts(spark, sf_dir):
    return catalog.categories(_parts(spark, sf_dir))


@_register("score_ranges", """
with o as (select p_brand as slug, p_type as key, case when length(p_type) % 2 = 0 then 'multiple' else 'single' end as selection, p_size - 25.0 as points from part),
g as (select slug, key, any_value(selection) as selection, min(points) as least, max(points) as most, coalesce(sum(points) filter (points < 0), 0) as minus, coalesce(sum(points) filter (points > 0), 0) as plus from o group by 1, 2)
select slug, sum(case when selection = 'multiple' then minus else least end)::double as low, sum(case when selection = 'multiple' then plus else most end)::double as high from g group by 1""")
def score_ranges(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    options = part.select(F.col("p_brand").alias("slug"), F.col("p_type").alias("parent"), (F.col("p_size") - F.lit(25.0)).alias("points"))
    groups = part.select(F.col("p_brand").alias("slug"), F.col("p_type").alias("key"), F.when(F.length("p_type") % 2 == 0, "multiple").otherwise("single").alias("selection")).distinct()
    return checks.score_ranges(groups, options)


@_register("catalog_difference", """
with a as (select p_partkey as k, p_name as d from part where p_partkey % 7 <> 0), b as (select p_partkey as k, case when p_partkey % 13 = 0 then upper(p_name) || '!' else p_name end as d from part where p_partkey % 5 <> 0)
select 'part-' || coalesce(a.k, b.k) as slug, case when b.d is null then 'built' when a.d is null then 'published' else 'changed' end as status from a full join b on a.k = b.k where a.d is distinct from b.d""")
def catalog_difference(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_name").alias("document"))
    changed = F.when(F.col("p_partkey") % 13 == 0, F.concat(F.upper("document"), F.lit("!"))).otherwise(F.col("document"))
    return checks.difference(part.where("p_partkey % 7 <> 0"), part.where("p_partkey % 5 <> 0").withColumn("document", changed))


@_register("catalog_search_ranks", rf"""
with d as (select 'part-' || p_partkey as slug, case p_partkey % 4 when 0 then upper(p_name) || '!' when 1 then 'the ' || p_name when 2 then split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) else 'item' end as title, case when p_partkey % 4 = 3 then p_name else p_type end as category from part),
n as (select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as t, trim(regexp_replace(lower(title || ' ' || slug || ' ' || category), '[^a-z0-9]+', ' ', 'g')) as hay from d)
select slug, title, case when t like 'small ring%' then 0 when t like '%small ring%' then 1 when t like '%small%' and t like '%ring%' then 2 else 3 end as rank from n where hay like '%small%' and hay like '%ring%'""")
def catalog_search_ranks(spark, sf_dir):
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(k % 4 == 1, F.concat(F.lit("the "), "p_name")).when(k % 4 == 2, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise("item")
    rows = part.select(F.concat(F.lit("part-"), k).alias("slug"), title.alias("title"), F.when(k % 4 == 3, F.col("p_name")).otherwise(F.col("p_type")).alias("category"), F.lit("part").alias("renderer"))
    return catalog.search(rows, "Small  Ring").select("slug", "title", F.col("rank").cast("int").alias("rank"))


#: A specification a part, of each kind in turn, with faults by the part's key: (kind, its document as SQL over k, s and name, without the head that all share).
_KINDS = {
    "formula": """'"inputs": [{"key": "x", "label": "X", "constraints": {"min": ' || s || ', "max": ' || (s + k % 7 - 1) || '}}, {"key": "y", "label": "' || case when k % 4 = 0 then '' else 'Y' end || '", "constraints": {"min": 0, "max": 9}, "default": ' || k % 12
      || '}, {"key": "z", "label": "Z", "options": [{"label": "1", "value": "1"}, {"label": "one", "value": "' || case when k % 3 = 0 then '1' else '2' end || '"}]}], "compute": {"steps": [], "outputs": [' || case when k % 2 = 0 then '{"key": "r", "expr": "x"}' else '' end || ']}'""",
    "score": """'"scoring": {"groups": [{"key": "g", "selection": "multiple", "options": [{"key": "o", "points": 2}, {"key": "p", "points": -1}]}], "bands": [{"min": 0, "max": 1, "label": "low"}, {"min": 0, "max": 1, "label": "less"}, '
      || case when k % 3 = 0 then '{"min": 3, "max": 4, "label": "never"}' else '{"min": 2, "max": 2, "label": "some"}' end || ', {"min": 2, "max": 2, "label": "' || case when k % 4 = 0 then '3% ** 5%' else 'more' end || '"}]}'""",
    "titration_table": """'"tables": {"dose_ladder": {"values": [1, 2, ' || (2 + k % 2) || ']}, "lookups": [{"key": "age", "select_value": "1", "rows": [{"threshold": 1}, {"threshold": 3}]}, {"key": "age", "select_value": "2", "rows": [{"threshold": 4}, {"threshold": ' || (3 + k % 3) || '}]}]}'""",
    "convert": """'"tables": {"pairs": [{"from": "u' || k % 40 || '", "to": "lb", "factor": ' || s || '}, {"from": "u' || k % 40 || '", "to": "' || case when k % 2 = 0 then 'lb' else 'oz' end || '", "factor": 2.5}]}'""",
    "tree": """'"tables": {"nodes": {"q": {"yes": "end", "no": "' || case when k % 3 = 0 then 'nowhere' else 'end' end || '"}}, "outcomes": {"end": "x"}}'""",
}
_OF_PARTS = "(select p_partkey as k, p_size as s, 'part-' || p_partkey as slug, case when p_partkey % 13 <> 0 then p_name else ' ' end as title, case when p_partkey % 11 <> 0 then p_type end as category, case p_partkey % 5 " + " ".join(f"when {i} then '{kind}'" for i, kind in enumerate(_KINDS)) + " end as renderer from part)"


def _catalogue(spark, sf_dir):
    """The specifications of all parts."""
    body = "case k % 5 " + " ".join(f"when {i} then {sql}" for i, sql in enumerate(_KINDS.values())) + " end"
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = part.select(k.alias("k"), F.col("p_size").alias("s"), F.concat(F.lit("part-"), k).alias("slug"), F.when(k % 13 != 0, F.col("p_name")).otherwise(" ").alias("title"), F.when(k % 11 != 0, F.col("p_type")).alias("category"), F.get(F.array(*map(F.lit, _KINDS)), (k % 5).cast("int")).alias("renderer"))
    return rows.select("slug", "title", "category", "renderer", F.concat(F.lit("{"), F.expr(body), F.lit("}")).alias("document"))


@_register("catalog_categories", f"select coalesce(category, 'Uncategorised') as category, count(*) as specifications from {_OF_PARTS} group by 1")
def catalog_categories(spark, sf_dir):
    return catalog.categories(_catalogue(spark, sf_dir))


@_register("catalog_renderers", f"select renderer, count(*) as specifications from {_OF_PARTS} group by 1")
def catalog_renderers(spark, sf_dir):
    return catalog.renderers(_catalogue(spark, sf_dir))


@_register("invariants", f"""
with p as (select * from {_OF_PARTS})
select slug, 'bounds' as rule, 'x' as detail from p where renderer = 'formula' and k % 7 <= 1
union all select slug, 'default', 'y' from p where renderer = 'formula' and k % 12 > 9
union all select slug, 'options', 'z' from p where renderer = 'formula' and k % 3 = 0
union all select slug, 'band', 'never' from p where renderer = 'score' and k % 3 = 0
union all select slug, 'span', 'less' from p where renderer = 'score'
union all select slug, 'span', case when k % 4 = 0 then '3% ** 5%' else 'more' end from p where renderer = 'score' and k % 3 <> 0
union all select slug, 'label', '3% ** 5%' from p where renderer = 'score' and k % 4 = 0
union all select slug, 'ladder', 'dose' from p where renderer = 'titration_table' and k % 2 = 0
union all select slug, 'ladder', 'age 2' from p where renderer = 'titration_table' and k % 3 <= 1
union all select slug, 'pair', 'u' || k % 40 from p where renderer = 'convert' and k % 2 = 0
union all select slug, 'edge', 'q' from p where renderer = 'tree' and k % 3 = 0""")
def invariants(spark, sf_dir):
    return checks.invariants(_catalogue(spark, sf_dir))


@_register("invariants_of_broken", f"""
with p as (select * from {_OF_PARTS}), n as (select unnest([case when renderer = 'formula' and k % 7 <= 1 then 'bounds' end, case when renderer = 'formula' and k % 12 > 9 then 'default' end, case when renderer = 'formula' and k % 3 = 0 then 'options' end,
  case when renderer = 'score' and k % 3 = 0 then 'band' end, case when renderer = 'score' then 'span' end, case when renderer = 'score' and k % 3 <> 0 then 'span' end, case when renderer = 'score' and k % 4 = 0 then 'label' end,
  case when renderer = 'titration_table' and k % 2 = 0 then 'ladder' end, case when renderer = 'titration_table' and k % 3 <= 1 then 'ladder' end, case when renderer = 'convert' and k % 2 = 0 then 'pair' end, case when renderer = 'tree' and k % 3 = 0 then 'edge' end]) as rule from p)
select rule, count(*) as broken from n where rule is not null group by 1""")
def invariants_of_broken(spark, sf_dir):
    return checks.invariants(_catalogue(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("broken"))


@_register("merged_pairs", f"""
with x as (select slug, 0 as position, 'u' || k % 40 as from_unit, 'lb' as to_unit, s::double as factor from {_OF_PARTS} where renderer = 'convert' union all select slug, 1, 'u' || k % 40, case when k % 2 = 0 then 'lb' else 'oz' end, 2.5 from {_OF_PARTS} where renderer = 'convert')
select from_unit, to_unit, factor, slug from x qualify row_number() over (partition by from_unit, to_unit order by slug, position) = 1""")
def merged_pairs(spark, sf_dir):
    return checks.merged_pairs(_catalogue(spark, sf_dir)).select(F.col("from").alias("from_unit"), F.col("to").alias("to_unit"), "factor", "slug")


@_register("completeness", f"""
with m as (select slug, (k % 13 <> 0)::int + (k % 11 <> 0)::int + case renderer when 'formula' then (k % 4 <> 0)::int + 1 + (k % 2 = 0)::int when 'score' then 1 when 'convert' then 1 else 0 end as passed, case renderer when 'formula' then 5 when 'tree' then 2 else 3 end as applicable from {_OF_PARTS})
select slug, passed, applicable, round(100.0 * passed / applicable, 1) as completeness from m""")
def completeness(spark, sf_dir):
    return checks.graded(_catalogue(spark, sf_dir))


_SHIPPED = specifications()
_SLUGS = lambda specs: "(values " + ", ".join(f"('{s['slug']}', '{s['renderer']}')" for s in specs) + ") s(slug, renderer)"


def _turns(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("turn"))


#: Nine tenths at least of the probes of every formula and table, one a customer, have all their outputs.
@_register("evaluate_all", f"select slug, renderer, count(*) as probes, true as evaluates from customer, {_SLUGS(s for s in _SHIPPED.values() if s['renderer'] in ('formula', 'titration_table'))} group by 1, 2")
def evaluate_all(spark, sf_dir):
    return checks.evaluate_all(_turns(spark, sf_dir), "turn", _SHIPPED.values()).select("slug", "renderer", "probes", (F.col("ok") * 10 >= F.col("probes") * 9).alias("evaluates"))


_SOME = [_SHIPPED[k] for k in ("anion-gap", "meld-score", "osmolal-gap", "valganciclovir", "water-deficit-in-hypernatremia", "dopamine", "cisatracurium")]


@_register("evaluation_summary", f"select renderer, count(distinct slug) as specifications, count(distinct slug) filter (c_custkey is not null) as evaluating from {_SLUGS(_SOME)} left join customer on true group by 1")
def evaluation_summary(spark, sf_dir):
    return checks.summary(checks.evaluate_all(_turns(spark, sf_dir), "turn", _SOME))


_DEAD = _spec([{"key": "used", "options": [{"value": 1.0}, {"value": 2.0}]}, {"key": "unused", "options": [{"value": 1.0}, {"value": 2.0}, {"value": 3.0}]}, {"key": "x", "constraints": {"min": 1, "max": 2}}], {"y": "used * x"})
_CONSTANT = _spec([{"key": "x", "constraints": {"min": 1, "max": 2}}], {"y": "x * 0"}) | {"slug": "constant"}


@_register("dead_parts", f"""
with t as (select c_custkey as turn, (1 + c_custkey % 2) * (1 + (0.04::double + 0.92::double * (((c_custkey + 1) * {checks.GOLDEN!r}::double + {2 / 7!r}::double) % 1.0::double))) as y from customer)
select 'made' as slug, 'used' as part, count(*) as bases, count(*) as live from t union all select 'made', 'unused', count(*), 0 from t union all select 'made', '*', count(*), count(distinct y) - 1 from t union all select 'constant', '*', count(*), 0 from t""")
def dead_parts(spark, sf_dir):
    return checks.dead_parts(_turns(spark, sf_dir), "turn", [_DEAD, _CONSTANT])
