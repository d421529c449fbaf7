"""What a form and a build report tell of specifications, as tables over a catalogue: the output a specification is named for, steps of inputs, coverage, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.sources import catalog
from carecolumns.sources.catalog import squashed


def primary_outputs(catalogue: DataFrame) -> DataFrame:
    """(slug, output): the output that a specification is named for: the first whose label or key is its title; else that of the longest label or key, of four letters at least, that
    the title holds or that holds the title, the first of equals; else the first."""
    outputs = catalog.children(catalogue, "outputs").select("slug", "position", "key", "label").join(catalogue.select("slug", squashed(F.coalesce("title", F.lit(""))).alias("title")), "slug")
    t = F.col("title")

    def fit(c: str) -> Column:
        s = squashed(F.coalesce(c, F.lit("")))
        return F.when(s == "", 0).when(s == t, 1 << 30).when((F.length(s) > 3) & (F.contains(t, s) | F.contains(s, t)), F.length(s)).otherwise(0)

    best = F.max_by("key", F.struct(F.greatest(fit("label"), fit("key")), -F.col("position")))
    return outputs.groupBy("slug").agg(best.alias("output"))


#: Dimensions whose inputs move by tenths.
FINE = ("mass", "volume", "concentration")


def step_sizes(fields: DataFrame) -> DataFrame:
    """fields (widget, dimension, low, high, others) with `step`: 0.1 for ranges of 10 at most and for fine dimensions, 1 for other number fields, else 0.1."""
    span = F.abs(F.col("high") - F.col("low"))
    return fields.withColumn("step", F.when((span > 0) & (span <= 10), 0.1).when(F.col("dimension").isin(*FINE), 0.1).when(F.col("widget") == "number", 1.0).otherwise(0.1))


def coverage(catalogue: DataFrame) -> DataFrame:
    """(measure, n): how many specifications there are, how many of each renderer, with a category, and how many fields there are, with bounds and with units."""
    fields = catalog.children(catalogue, "fields")
    bounded = F.coalesce("constraints.min", "constraints.max", "constraints.exclusive_min", "constraints.exclusive_max").isNotNull()
    of_fields = fields.agg(F.count("*").alias("fields"), F.count_if(bounded).alias("fields with bounds"), F.count_if(F.size("units") > 0).alias("fields with units"))
    of_specs = catalogue.agg(F.count("*").alias("specifications"), F.count("category").alias("specifications with a category"))
    rows = lambda df: df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("measure", "n"))
    return rows(of_specs).unionByName(rows(of_fields)).unionByName(catalogue.groupBy(F.concat(F.lit("renderer "), "renderer").alias("measure")).agg(F.count("*").alias("n")))


#: Severities in order of urgency; anything else comes last.
SEVERITIES = ("critical", "high", "medium")


def review_queue(findings: DataFrame, many: int | None = None) -> DataFrame:
    """findings (severity, others) with `urgency` (0 first), in that order and then by all other columns' JSON; the first `many` of them, or all."""
    urgency = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        urgency = F.when(F.col("severity") == s, i).otherwise(urgency)
    ordered = findings.withColumn("urgency", urgency).orderBy("urgency", F.to_json(F.struct(*[F.col(f"`{c}`") for c in findings.columns])))
    return ordered if many is None else ordered.limit(many)


def units_for_fields(fields: DataFrame, lists: DataFrame) -> DataFrame:
    """fields (field, base) with the unit list (stem, position, code) that fits: the first in order that holds the base unit's code, else the first whose stem's last word
    is in the field's name or holds it, three letters at least; null where none does."""
    folded = lists.select("stem", "position", squashed(F.col("code")).alias("code")).where("code <> ''")
    by_code = folded.groupBy("code").agg(F.min(F.struct("position", "stem")).alias("x")).select("code", F.col("x.stem").alias("by_code"))
    stems = lists.select("stem", "position").groupBy("stem").agg(F.min("position").alias("position")).withColumn("word", squashed(F.element_at(F.split("stem", "_"), -1)))
    rows = fields.withColumns({"__base": squashed(F.coalesce("base", F.lit(""))), "__name": squashed(F.col("field"))})
    found = rows.join(by_code, F.col("__base") == F.col("code"), "left").drop("code")
    # what no code decides is looked up by parts of names: each part of three letters or more of a name meets the stems that are it
    name = found.where("by_code is null").select("__name").distinct()
    n = F.length("__name")
    parts = name.select("__name", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), n - i + 1)), lambda k: F.substring("__name", i, k)))))).alias("word"))
    inside = parts.join(stems.where("length(word) >= 3"), "word").select("__name", "position", "stem")
    w = F.length("word")
    of_stems = stems.where("length(word) >= 3").select("stem", "position", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), w - 2), lambda i: F.transform(F.sequence(F.lit(3), w - i + 1), lambda k: F.substring("word", i, k)))))).alias("__name"))
    around = of_stems.join(name.where("length(__name) >= 3"), "__name").select("__name", "position", "stem")
    by_name = inside.unionByName(around).groupBy("__name").agg(F.min(F.struct("position", "stem")).alias("y")).select("__name", F.col("y.stem").alias("by_name"))
    return found.join(by_name, "__name", "left").select(*[F.col(f"`{c}`") for c in fields.columns], F.coalesce("by_code", "by_name").alias("stem"))
