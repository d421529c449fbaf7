"""Inputs of a specification over rows of subjects: coercion, options, units, defaults, requirement and bounds, with every error as data.

A row gives a field in a column of its key (any type; texts are read as numbers) and, if its unit varies, the unit's code in `<key>__unit`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.functions.values import MIXED, NUM, STR, Value

CLOSE = 1e-9


def error(field: str, message: Column | str) -> Column:
    return F.struct(F.lit(field).alias("field"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def shown(x: float) -> str:
    return f"{x:g}"


def _same(a: Column, b: str) -> Column:
    return F.lower(F.trim(a)) == b.strip().lower()


def given(df: DataFrame, key: str) -> Column:
    """What a row gives for a field, as text; null if it is missing or blank."""
    if key not in df.columns:
        return F.lit(None).cast("string")
    raw = F.col(f"`{key}`").cast("string")
    return F.when(F.trim(raw) != "", F.trim(raw))


def as_number(raw: Column) -> Column:
    """Numbers, true and false, and ISO dates as epoch milliseconds of midnight UTC."""
    date = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(F.try_to_timestamp(raw)).cast("double"))
    plain = F.when(raw.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"), raw.try_cast("double"))
    return F.when(F.lower(raw) == "true", 1.0).when(F.lower(raw) == "false", 0.0).otherwise(F.coalesce(plain, date))


def _option(raw: Column, x: Column, options: list[dict]) -> Column:
    """The place of the first option, in their order, that a row's value means by its value, a number within 1e-9 (x is the value's), its label or its key; failing
    all of them, of the first with that label in other letter case. Null if there is none."""
    tests = []
    for o in options:
        means = raw.isin(*{str(o["value"]), str(o.get("label", "")), str(o.get("key") or o["value"])})
        if isinstance(o["value"], (int, float)):
            means = means | (F.abs(x - float(o["value"])) < CLOSE)
        tests.append(means)
    tests += [_same(raw, str(o.get("label", ""))) for o in options]
    at = F.lit(None).cast("int")
    for n, test in reversed(list(enumerate(tests))):
        at = F.when(test, n % len(options)).otherwise(at)
    return at


def _of_options(at: Column, options: list[dict]) -> tuple[Column, Column]:
    """(number, text) of the option at a place: it has one of them."""
    numbers = [None if isinstance(o["value"], bool) or not isinstance(o["value"], (int, float)) else float(o["value"]) for o in options]
    texts = [str(o["value"]) if x is None else None for o, x in zip(options, numbers, strict=True)]
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at) if any(v is not None for v in values) else F.lit(None).cast(kind)
    return pick(numbers, "double"), pick(texts, "string")


def to_base(x: Column, df: DataFrame, f: dict, strict: bool) -> tuple[Column, tuple[Column, Column] | None]:
    """x in the field's base unit; unit codes that it does not have, and their error (only if strict, else they mean the display unit)."""
    units = f.get("units") or []
    if not units:
        return x, None
    default = next((u for u in units if u["code"] == (f.get("display_unit") or f.get("base_unit"))), None) or {"factor": 1.0, "offset": 0.0}
    out = x * F.lit(float(default.get("factor") or 1.0)) + F.lit(float(default.get("offset") or 0.0))
    if f"{f['key']}__unit" not in df.columns:
        return out, None
    code = given(df, f"{f['key']}__unit")
    known = code.isNull()
    for u in reversed(units):
        hit = F.coalesce(_same(code, u["code"]) | _same(code, u.get("label") or u["code"]), F.lit(False))
        out = F.when(hit, x * F.lit(float(u["factor"])) + F.lit(float(u.get("offset") or 0.0))).otherwise(out)
        known = known | hit
    return out, (~known, error(f["key"], F.concat(F.lit("unknown unit "), code))) if strict else None


def _matches(raw: Column, fields: dict[str, dict], when: dict) -> Column:
    """Whether the controlling field's answer, as text, is among those asked for; false while it is unanswered."""
    control = fields.get(when["field"], {})
    if control.get("default") is not None:
        raw = F.coalesce(raw, F.lit(str(control["default"])))
    out = F.lit(False)
    for v in when["equals"]:
        out = out | F.coalesce((raw == str(v)) | (F.abs(as_number(raw) - as_number(F.lit(str(v)))) < CLOSE), F.lit(False))
        for o in control.get("options") or []:
            if str(o["value"]) == str(v):
                out = out | F.coalesce(_same(raw, str(o.get("label", v))), F.lit(False))
    return out


def bounds(x: Column, f: dict) -> list[tuple[Column, Column]]:
    """Tests of a number, with their errors, against the field's bounds, closed ones widened by 1e-9; NaN is in no range."""
    c, label, unit = f.get("constraints") or {}, f.get("label") or f["key"], f" {f['base_unit']}" if f.get("base_unit") else ""
    rules = (("min", lambda b: x >= b - CLOSE, "at least"), ("exclusive_min", lambda b: x > b, "greater than"), ("max", lambda b: x <= b + CLOSE, "at most"), ("exclusive_max", lambda b: x < b, "less than"))
    out = []
    for k, holds, words in rules:
        if c.get(k) is not None:
            out.append((x.isNotNull() & (F.isnan(x) | ~holds(F.lit(float(c[k])))), error(f["key"], f"{label} must be {words} {shown(c[k])}{unit}")))
    return out


def _found(errors: list[tuple[Column, Column]]) -> Column:
    """The errors whose tests hold. Rows without any make no array: filtering one is a call a row outside of compiled code, with all that its tests compute."""
    none = F.array_compact(F.array().cast("array<struct<field:string,message:string>>"))
    if not errors:
        return none
    return F.when(reduce(lambda a, b: a | b, [test for test, _ in errors]), F.array_compact(F.array(*[F.when(test, e) for test, e in errors]))).otherwise(none)


def validate(df: DataFrame, spec: dict, strict_units: bool = True) -> tuple[DataFrame, dict[str, Value]]:
    """df with `errors` (array of field, message; empty if none) and the Values of the inputs.

    What a field's text is, the number it reads as, the option or number it means and the errors are columns one after the other, so that each is computed once a row.
    """
    fields = {f["key"]: f for f in spec.get("inputs", [])}
    chosen = {key for key, f in fields.items() if f.get("options") and not f.get("options_incomplete")}
    numeric = {key for key, f in fields.items() if key not in chosen or any(isinstance(o["value"], (int, float)) for o in f["options"])}
    raws, xs = {key: F.col(f"__i{n}_r") for n, key in enumerate(fields)}, {key: F.col(f"__i{n}_x") for n, key in enumerate(fields)}
    rows = df.withColumns({f"__i{n}_r": given(df, key) for n, key in enumerate(fields)})
    rows = rows.withColumns({f"__i{n}_x": as_number(raws[key]) for n, key in enumerate(fields) if key in numeric})
    rows = rows.withColumns({f"__i{n}_o": _option(raws[key], xs[key], f["options"]) for n, (key, f) in enumerate(fields.items()) if key in chosen})
    control = lambda when: raws[when["field"]] if when["field"] in raws else given(df, when["field"])
    env, errors, new = {}, [], {}
    for n, (key, f) in enumerate(fields.items()):
        raw, label = raws[key], f.get("label") or key
        required = F.lit(bool(f.get("required")))
        if f.get("required_when"):
            # while the control is unanswered, nothing is asked for, whatever its default
            answer = control(f["required_when"])
            required = answer.isNotNull() & _matches(answer, fields, f["required_when"])
        if f.get("visible_when"):
            # a hidden field is not asked for; one whose control is unanswered is shown
            answer = control(f["visible_when"])
            required = required & (answer.isNull() | _matches(answer, fields, f["visible_when"]))
        default = f.get("default")
        if default is None or f.get("required"):
            errors.append((raw.isNull() & required, error(key, f"{label} is required")))
        if key in chosen:
            at = F.col(f"__i{n}_o")
            num, text = _of_options(at, f["options"])
            errors.append((raw.isNotNull() & at.isNull(), error(key, F.concat(F.lit(f"{label}: unknown choice "), raw))))
            texts = [not isinstance(o["value"], (int, float)) for o in f["options"]]
            kind = STR if all(texts) else MIXED if any(texts) else NUM
        else:
            number = xs[key]
            sentinel = [o["value"] for o in f.get("options") or [] if isinstance(o["value"], str)] + ["other"] * (key == "concentration")
            is_sentinel = F.coalesce(raw.isin(sentinel), F.lit(False)) if sentinel else F.lit(False)
            errors.append((raw.isNotNull() & number.isNull() & ~is_sentinel, error(key, f"{label} must be a number")))
            num, unit_error = to_base(number, df, f, strict_units)
            if unit_error is not None:
                errors.append((raw.isNotNull() & unit_error[0], unit_error[1]))
            errors += bounds(num, f)
            text, kind = F.when(is_sentinel, raw), MIXED if sentinel else NUM
        if default is not None:
            if isinstance(default, str):
                text, kind = F.when(raw.isNull() & ~required, F.lit(default)).otherwise(text), kind if kind != NUM else MIXED
            else:
                num = F.when(raw.isNull() & ~required, F.lit(float(default))).otherwise(num)
        if kind != STR:
            new[f"__i{n}_n"] = num
        if kind != NUM:
            new[f"__i{n}_s"] = text
        n_col, s_col = F.col(f"__i{n}_n") if kind != STR else None, F.col(f"__i{n}_s") if kind != NUM else None
        missing = s_col.isNull() if n_col is None else n_col.isNull() if s_col is None else n_col.isNull() & s_col.isNull()
        env[key] = Value(kind, n_col, s_col, missing)
    new["errors"] = _found(errors)
    return rows.withColumns(new), env


def unknown_keys(df: DataFrame, spec: dict, also: tuple[str, ...] = ()) -> list[str]:
    """Columns that no input of the specification reads."""
    keys = {f["key"] for f in spec.get("inputs", [])}
    return [c for c in df.columns if c not in keys and c.removesuffix("__unit") not in keys and c not in also]


def squashed(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def by_any_name(df: DataFrame, spec: dict) -> tuple[DataFrame, list[str]]:
    """df with columns renamed to the keys of the inputs that they mean: the key itself, else the label, else the key in other spelling; and the names of the columns
    that mean none. A unit column keeps its suffix; a key that is there already is not taken a second time."""
    keys = [f["key"] for f in spec.get("inputs", [])]
    labels = {squashed(f["label"]): f["key"] for f in spec.get("inputs", []) if f.get("label")}
    folded = {squashed(k): k for k in keys}
    new, unknown, taken = {}, [], set(df.columns)
    for c in df.columns:
        name, unit, _ = c.partition("__unit")
        to = name if name in keys else labels.get(squashed(name)) or folded.get(squashed(name))
        if to is None:
            unknown.append(c)
        elif to + unit not in taken:
            new[c] = to + unit
            taken.add(to + unit)
    return df.withColumnsRenamed(new), unknown


def bounds_in(f: dict, code: str | None) -> dict:
    """The bounds of an input as its form shows them in a unit: converted back from the base unit to 12 digits, turned round where the factor is negative."""
    c, shown_code = f.get("constraints") or {}, code or f.get("display_unit") or f.get("base_unit")
    low, high = c.get("min", c.get("exclusive_min")), c.get("max", c.get("exclusive_max"))
    out = {"min": low, "max": high, "open_min": "exclusive_min" in c, "open_max": "exclusive_max" in c, "unit": shown_code}
    unit = next((u for u in f.get("units") or [] if squashed(u["code"]) == squashed(shown_code or "")), None)
    if unit is None or squashed(shown_code) == squashed(f.get("base_unit") or ""):
        return out
    back = lambda v: None if v is None else float(f"{(v - (unit.get('offset') or 0.0)) / unit['factor']:.12g}")
    a, b = back(low), back(high)
    if a is not None and b is not None and a > b:
        return out | {"min": b, "max": a, "open_min": out["open_max"], "open_max": out["open_min"]}
    return out | {"min": a, "max": b}


def units_of(f: dict) -> list[dict]:
    """The units of an input, that of its base first, then by code."""
    base = f.get("base_unit") or next((u["code"] for u in f.get("units") or []), None)
    units = f.get("units") or ([{"code": base}] if base else [])
    return [{"code": u["code"], "label": u.get("label") or u["code"], "is_base": u["code"] == base} for u in sorted(units, key=lambda u: (u["code"] != base, u["code"]))]
