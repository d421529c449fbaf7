"""Evaluate a specification over a DataFrame of subjects, one row a subject. Errors and warnings are columns; no row fails the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.functions.values import MIXED, STR, Value, python_round
from carecolumns.operators.inputs import error, validate
from carecolumns.operators import tables
from carecolumns.plans import schedule

FAILED = "the calculation has no value for these inputs"


def items(spec: dict) -> list[schedule.Item]:
    compute = spec.get("compute") or {}
    return [schedule.Item(s["key"], s["expr"], False) for s in compute.get("steps") or [] if s.get("expr")] + [schedule.Item(o["key"], o["expr"], True) for o in compute.get("outputs") or [] if o.get("expr")]


def with_variants(spec: dict, env: dict[str, Value]) -> dict[str, Value]:
    """Constants that a chosen option brings along."""
    env = dict(env)
    for key, v in ((spec.get("compute") or {}).get("variants") or {}).items():
        for name in v["variables"]:
            x = F.lit(None).cast("double")
            for o in v["options"]:
                x = F.when(F.abs(env[key].num - float(o["value"])) < 1e-9, F.lit(float(o["constants"][name]))).otherwise(x)
            env[name] = Value("number", x, None, x.isNull())
    return env


def _output(o: dict, v: Value, ok: Column, decimals: int | None) -> Column:
    num = v.num
    places = o.get("decimals") if o.get("decimals") is not None else decimals
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != float("inf"))
    value = F.when(finite, num if places is None else python_round(num, int(places))).otherwise(num)
    text = v.str if v.kind in (STR, MIXED) else F.lit(None).cast("string")
    return F.struct(F.when(ok, value).alias("value"), F.when(ok, text).alias("text"), F.lit(o.get("base_unit")).cast("string").alias("unit"), F.when(ok, finite).alias("finite"))


def ladders(spec: dict) -> list[schedule.Ladders]:
    """The reference tables of a specification as steps: those that write the same columns are one step, chosen between by their selectors."""
    by_columns: dict[tuple[str, ...], list[dict]] = {}
    for t in (spec.get("tables") or {}).get("lookups") or []:
        columns = tuple(t.get("columns") or sorted({k for r in t["rows"] for k in r if k != "threshold"}))
        by_columns.setdefault(columns, []).append(t)
    return [schedule.Ladders(columns, tables) for columns, tables in by_columns.items()]


def lookups_used(spec: dict, env: dict[str, Value]) -> Column:
    """The row of each reference table that applies to a subject: (key, row_index, lookup_value, threshold, select_value, outside). Values above every threshold
    show the last row, with `outside` set."""
    found = []
    for group in ladders(spec):
        for t in group.tables:
            name = group.key_of(t, env)
            if name is None or not t["rows"]:
                continue
            x, error = env[name].numeric()
            index = tables.ladder_index(x, t["rows"], t.get("operator") or "<")
            last = len(t["rows"]) - 1
            at = F.coalesce(index, F.lit(last))
            row = F.struct(
                F.lit(t["key"]).alias("key"), at.alias("row_index"), x.alias("lookup_value"), F.get(F.array(*[F.lit(r.get("threshold")).cast("double") for r in t["rows"]]), at).alias("threshold"),
                F.lit(None if t.get("select_value") is None else str(t["select_value"])).cast("string").alias("select_value"), index.isNull().alias("outside"),
            )
            found.append(F.when(group.chosen(t, env) & ~error & x.isNotNull(), row))
    empty = F.array().cast("array<struct<key:string,row_index:int,lookup_value:double,threshold:double,select_value:string,outside:boolean>>")
    return F.array_compact(F.array(*found)) if found else empty


def formula(df: DataFrame, spec: dict, strict_units: bool = True, lookups: bool = False) -> DataFrame:
    """df with ok, errors, warnings and outputs: a struct of (value, text, unit, finite) by output key. Outputs are null where a row has any error.

    Ladders among the specification's tables are looked up as soon as the value that they are keyed by is known. With lookups=True a column lookups_used tells the
    rows that were read, and values outside a table are warned of, as are the specification's own notes.
    """
    columns = df.columns
    rows, env = validate(df, spec, strict_units)
    done = schedule.run(rows, with_variants(spec, env), [*ladders(spec), *items(spec)])
    valid = F.size("errors") == 0
    errors = F.when(valid & done.failed, F.array(error("", FAILED))).otherwise(F.col("errors"))
    ok = valid & ~done.failed
    decimals = (spec.get("display") or {}).get("decimal_precision")
    outs = [(o, done.outputs[o["key"]]) for o in (spec.get("compute") or {}).get("outputs") or [] if o["key"] in done.outputs]
    outputs = F.struct(*[_output(o, v, ok, decimals).alias(o["key"]) for o, v in outs])
    endless = [F.when(ok & v.num.isNotNull() & (F.isnan(v.num) | (F.abs(v.num) == float("inf"))), F.lit(f"{o.get('label') or o['key']} is not finite")) for o, v in outs]
    used = F.when(ok, lookups_used(spec, done.env)).alias("lookups_used")
    if lookups:
        endless.append(F.when(ok & F.exists(lookups_used(spec, done.env), lambda x: x["outside"]), F.lit("a value is outside its printed table; the nearest row is shown")))
        endless += [F.lit(n if isinstance(n, str) else n.get("text")) for n in (spec.get("content") or {}).get("conditional_notes") or []]
    found = F.struct(ok.alias("ok"), errors.alias("errors"), F.array_compact(F.array(*endless)).cast("array<string>").alias("warnings"), outputs.alias("outputs"), *[used] * lookups)
    # a generator: filters on what is computed here do not copy the computation into themselves, step into step
    held = done.df.select(*[f"`{c}`" for c in columns], F.explode(F.array(found)).alias("__found"))
    return held.select(*[f"`{c}`" for c in columns], "__found.*")


def titration(df: DataFrame, spec: dict, strict_units: bool = True, always: bool = False) -> DataFrame:
    """A row for each subject without errors and each dose of the ladder: df's columns, dose, and the steps that depend on the dose, rounded to 2 places.

    The table needs a step of its own for rows (`value`); without one it is given only if `always` is set, from the outputs. A dose that fails has null cells.
    """
    columns, compute = df.columns, spec["compute"]
    ladder = ((spec.get("tables") or {}).get("dose_ladder") or {}).get("values") or []
    rows, env = validate(df, spec, strict_units)
    by_row = [s for s in compute.get("steps") or [] if s["key"] == "value"]
    if not by_row and not always:
        ladder = []
    rows = rows.where(F.size("errors") == 0).withColumn("__dose", F.explode(F.array(*[F.lit(float(x)) for x in ladder]) if ladder else F.array().cast("array<double>")))
    env = with_variants(spec, env) | {compute["row_variable"]: Value("number", F.col("__dose"), None, F.lit(False))}
    done = schedule.run(rows, env, [*ladders(spec), *items(spec)])
    shown = [s["key"] for s in by_row] or [o["key"] for o in compute["outputs"]]
    cells = [F.when(~done.env[k].error, python_round(done.env[k].num, 2)).alias(k) for k in shown]
    keep = [c for c in columns if c not in {"dose", *shown}]
    return done.df.select(*[f"`{c}`" for c in keep], F.col("__dose").alias("dose"), *cells)


def band(bands: list[dict], total: Column) -> Column:
    """The label of the first band in file order that holds the total, ends widened by 1e-9."""
    out = F.lit(None).cast("string")
    for b in reversed(bands):
        holds = F.lit(True)
        if b.get("min") is not None:
            holds = holds & (total >= float(b["min"]) - 1e-9)
        if b.get("max") is not None:
            holds = holds & (total <= float(b["max"]) + 1e-9)
        out = F.when(holds, F.lit(b["label"])).otherwise(out)
    return out


def bands_all(bands: list[dict], total: Column) -> Column:
    """Labels of all bands that hold the total."""
    return F.array_compact(F.array(*[F.when(band([b], total).isNotNull(), F.lit(b["label"])) for b in bands]))


def score(subjects: DataFrame, picks: DataFrame, spec: dict, key: str = "subject_id", multiple: bool | None = None) -> DataFrame:
    """Points of each subject: (key, ok, errors, total, band). picks: (key, group, option), one row a choice, `group` and `option` by key or label.

    A required group without a choice, an unknown group or option, and a second choice in a single group are errors; of several choices in a single group
    the first in option order counts. multiple=True or False overrides every group's own kind. Subjects without picks have the errors of required groups.
    """
    groups = spec["scoring"]["groups"]
    many = [(g.get("selection") == "multiple") if multiple is None else multiple for g in groups]
    # literal maps of one specification, keys before labels: picks meet no other table
    group_of = {(g.get("label") or g["key"]).lower(): i for i, g in enumerate(groups)} | {g["key"].lower(): i for i, g in enumerate(groups)}
    by_label = {f"{i}|{(o.get('label') or o['key']).lower()}": (j, float(o["points"])) for i, g in enumerate(groups) for j, o in reversed(list(enumerate(g["options"])))}
    by_key = {f"{i}|{o['key']}": (j, float(o["points"])) for i, g in enumerate(groups) for j, o in reversed(list(enumerate(g["options"])))}
    literal = lambda m, value: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), value(v))])
    option = lambda v: F.struct(F.lit(v[0]).alias("o"), F.lit(v[1]).alias("points"))
    at = picks.select(F.col(key).alias("__id"), F.try_element_at(literal(group_of, F.lit), F.lower(F.trim("group"))).alias("g"), F.trim("option").alias("option"))
    name = lambda c: F.concat(F.col("g").cast("string"), F.lit("|"), c)
    at = at.select("__id", "g", F.coalesce(F.try_element_at(literal(by_key, option), name(F.col("option"))), F.try_element_at(literal(by_label, option), name(F.lower("option")))).alias("x")).select("__id", "g", "x.o", "x.points")
    each = at.groupBy("__id").agg(
        *[F.min(F.when(F.col("g") == i, F.struct("o", "points"))).alias(f"first{i}") for i in range(len(groups))],
        *[F.sum(F.when((F.col("g") == i) & F.col("o").isNotNull(), F.col("points"))).alias(f"sum{i}") for i in range(len(groups))],
        *[F.count_if((F.col("g") == i) & F.col("o").isNotNull()).alias(f"n{i}") for i in range(len(groups))],
        *[F.count_if((F.col("g") == i) & F.col("o").isNull()).alias(f"bad{i}") for i in range(len(groups))],
        F.count_if(F.col("g").isNull()).alias("bad_groups"),
    )
    rows = subjects.select(F.col(key).alias("__id")).join(each, "__id", "left")
    errors, parts = [F.when(F.col("bad_groups") > 0, error("", "unknown group"))], []
    for i, g in enumerate(groups):
        n, name = F.coalesce(F.col(f"n{i}"), F.lit(0)), g.get("label") or g["key"]
        if g.get("required"):
            errors.append(F.when(n == 0, error(g["key"], f"{name} needs a choice")))
        errors.append(F.when(F.col(f"bad{i}") > 0, error(g["key"], f"{name}: unknown choice")))
        if not many[i]:
            errors.append(F.when(n > 1, error(g["key"], f"{name} takes one choice")))
        parts.append(F.coalesce(F.col(f"sum{i}") if many[i] else F.col(f"first{i}.points"), F.lit(0.0)))
    total = reduce(lambda a, b: a + b, parts)
    found = F.array_compact(F.array(*errors))
    out = rows.select(F.col("__id").alias(key), found.alias("errors"), total.alias("total"))
    return out.select(key, (F.size("errors") == 0).alias("ok"), "errors", F.when(F.size("errors") == 0, F.col("total")).alias("total"), F.when(F.size("errors") == 0, band(spec["scoring"].get("bands") or [], F.col("total"))).alias("band"))


def score_range(spec: dict) -> tuple[float, float]:
    """Least and greatest total that a specification allows."""
    low = high = 0.0
    for g in spec["scoring"]["groups"]:
        points = [float(o["points"]) for o in g["options"]]
        if g.get("selection") == "multiple":
            low, high = low + sum(p for p in points if p < 0), high + sum(p for p in points if p > 0)
        else:
            low, high = low + min(points), high + max(points)
    return low, high


def convert(df: DataFrame, spec: dict, pair: str = "pair_index", value: str = "value", reverse: str = "reverse") -> DataFrame:
    """df with result (rounded to 6 places), from_unit, to_unit; null where there is no such pair. A factor of 0 or null counts as 1."""
    pairs = spec["tables"]["pairs"]
    x, factor, offset, a, b = F.col(value).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, p in enumerate(pairs):
        hit = F.col(pair) == i
        factor, offset = F.when(hit, F.lit(float(p.get("factor") or 1.0))).otherwise(factor), F.when(hit, F.lit(float(p.get("offset") or 0.0))).otherwise(offset)
        a, b = F.when(hit, F.lit(p["from"])).otherwise(a), F.when(hit, F.lit(p["to"])).otherwise(b)
    back = F.coalesce(F.col(reverse), F.lit(False)) if reverse in df.columns else F.lit(False)
    out = F.when(back, F.try_divide(x - offset, factor)).otherwise(x * factor + offset)
    return df.withColumns({"result": python_round(out, 6), "from_unit": F.when(back, b).otherwise(a), "to_unit": F.when(back, a).otherwise(b)})


def tree(df: DataFrame, spec: dict, answers: str = "answers") -> DataFrame:
    """df with node (where the answers lead), done (whether it is an outcome) and steps (answers used). Anything but yes, y, true and 1 counts as no."""
    nodes, outcomes = spec["tables"]["nodes"], spec["tables"]["outcomes"]
    root = next(iter(nodes))
    yes = F.create_map(*[x for k, n in nodes.items() for x in (F.lit(k), F.lit(n["yes"]))])
    no = F.create_map(*[x for k, n in nodes.items() for x in (F.lit(k), F.lit(n["no"]))])

    def step(state: Column, answer: Column) -> Column:
        at, positive = state["node"], F.coalesce(F.lower(F.trim(answer)).isin("yes", "y", "true", "1"), F.lit(False))
        leaf = ~at.isin(*nodes)
        return F.struct(F.when(leaf, at).when(positive, F.try_element_at(yes, at)).otherwise(F.try_element_at(no, at)).alias("node"), F.when(leaf, state["steps"]).otherwise(state["steps"] + 1).alias("steps"))

    start = F.struct(F.lit(root).alias("node"), F.lit(0).alias("steps"))
    walked = F.aggregate(F.coalesce(F.col(answers), F.array().cast("array<string>")), start, step)
    return df.withColumn("__walk", walked).withColumns({"node": F.col("__walk.node"), "done": F.col("__walk.node").isin(*outcomes), "steps": F.col("__walk.steps")}).drop("__walk")

