"""Which inputs a specification needs on which path, found by leaving them out: counterfactual evaluation over rows of subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.operators import evaluation
from carecolumns.operators.inputs import given


def _asks_nothing(spec: dict) -> dict:
    """The specification with no input required and no default, so that an input that is not given fails only where it is read."""
    return dict(spec) | {"inputs": [{k: v for k, v in f.items() if k not in ("required_when", "visible_when", "default")} | {"required": False} for f in spec.get("inputs") or []]}


def leave_one_out(df: DataFrame, spec: dict, by: str) -> DataFrame:
    """(option, field, rows, computes): for each answer to the control `by` and each other field, how many rows that compute were tried without the field, and how many
    computed all the same.

    Rows that do not compute with all their fields, or do not answer the control, are not tried. A row is evaluated once whole and once for each field that it gives, by one plan.
    """
    relaxed = _asks_nothing(spec)
    keys = [f["key"] for f in spec.get("inputs") or [] if f["key"] != by and f["key"] in df.columns]
    columns = [F.col(f"`{c}`") for c in df.columns]
    whole = evaluation.formula(df, relaxed).where("ok").select(*columns)
    tried = whole.select(given(df, by).alias("__option"), F.explode(F.array(*[F.when(given(df, k).isNotNull(), F.lit(k)) for k in keys])).alias("__left"), *columns).where("__left is not null and __option is not null")
    tried = tried.select("__option", "__left", *[F.when(F.col("__left") != c, F.col(f"`{c}`")).alias(c) if c in keys else F.col(f"`{c}`") for c in df.columns])
    out = evaluation.formula(tried, relaxed)
    return out.groupBy(F.col("__option").alias("option"), F.col("__left").alias("field")).agg(F.count("*").alias("rows"), F.count_if("ok").alias("computes"))


def requirements(found: DataFrame) -> DataFrame:
    """leave_one_out() rows to (field, needed, spare, rule): the options under which some row fails without the field, those under which none does, and always, sometimes (required
    when the control is one of `needed`) or never."""
    spare = F.col("computes") == F.col("rows")
    each = found.groupBy("field").agg(F.sort_array(F.collect_set(F.when(~spare, F.col("option")))).alias("needed"), F.sort_array(F.collect_set(F.when(spare, F.col("option")))).alias("spare"))  # an entry an option
    rule = F.when(F.size("needed") == 0, "never").when(F.size("spare") == 0, "always").otherwise("sometimes")
    return each.withColumn("rule", rule)
