"""Requests as JSON text, one a row: nested or flat, read as VARIANT, so that any shape is a row and never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.operators.inputs import squashed

#: Names of a body that are no inputs of their own.
PARTS = ("inputs", "units", "selections", "answers", "pair_index", "value", "reverse")


def _texts(v: Column) -> Column:
    """An object's values as texts, in a map; null for anything else."""
    return F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.try_variant_get(x, "$", "string"))


def parsed(df: DataFrame, body: str) -> DataFrame:
    """df with `request` (inputs, units: maps of texts; selections: a map of arrays of texts; answers: an array of texts; pair_index int, value double, reverse boolean) and
    `problem`: null, `no JSON` or `no object`.

    Inputs stand in `inputs`, beside it, or both; those beside it count. Names that begin with an underscore are left out. A single text is an array of one selection. A null or
    blank body is an empty request. Parts of another shape than theirs count as not given.
    """
    text = F.col(f"`{body}`")
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    v = F.try_parse_json(text)
    every = F.try_variant_get(v, "$", "map<string,variant>")
    part = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    none = F.create_map().cast("map<string,string>")
    flat = F.map_filter(_texts(v), lambda k, x: ~k.isin(*PARTS) & ~k.startswith("_"))
    flat = F.coalesce(flat, none)
    nested = F.map_filter(F.coalesce(_texts(part("inputs")), none), lambda k, x: ~F.map_contains_key(flat, k))
    selections = F.transform_values(F.coalesce(F.try_variant_get(part("selections"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(x, "$", "string")))))
    request = F.struct(
        F.map_concat(nested, flat).alias("inputs"), F.coalesce(_texts(part("units")), none).alias("units"), selections.alias("selections"), F.coalesce(F.try_variant_get(v, "$.answers", "array<string>"), F.array().cast("array<string>")).alias("answers"),
        F.try_variant_get(v, "$.pair_index", "int").alias("pair_index"), F.try_variant_get(v, "$.value", "double").alias("value"), F.coalesce(F.try_variant_get(v, "$.reverse", "boolean"), F.lit(False)).alias("reverse"),
    )
    problem = F.when(blank, None).when(v.isNull(), "no JSON").when(every.isNull(), "no object")
    return df.withColumns({"request": request, "problem": problem})


def as_columns(df: DataFrame, spec: dict) -> DataFrame:
    """parsed() rows with a column for each input of a specification, its unit's column, and `unknown`: names of inputs that mean none, in order.

    An input is meant by its key, else by its label, else by its key in other spelling. Of several names of one input the key itself counts, then the first in byte order.
    """
    names: dict[str, str] = {}
    fields = spec.get("inputs") or []
    for f in fields:
        names.setdefault(squashed(f["key"]), f["key"])
    for f in fields:
        if f.get("label"):
            names[squashed(f["label"])] = f["key"]
    keys = [f["key"] for f in fields]
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    fold = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]+", "")
    meant = lambda k: F.when(k.isin(*keys), k).otherwise(F.try_element_at(table, fold(k)))

    def of(m: Column, key: str) -> Column:
        other = F.array_sort(F.filter(F.map_keys(m), lambda k: meant(k) == key))
        return F.coalesce(F.try_element_at(m, F.lit(key)), F.try_element_at(m, F.get(other, F.lit(0))))

    inputs, units = F.col("request.inputs"), F.col("request.units")
    new = {k: of(inputs, k) for k in keys} | {f"{k}__unit": of(units, k) for k in keys}
    return df.withColumns(new | {"unknown": F.array_sort(F.filter(F.map_keys(inputs), lambda k: meant(k).isNull()))})
