"""Specifications and their catalogue.

A specification is one JSON document (keys slug, title, category, renderer, inputs, compute{steps, outputs, row_variable}, scoring{groups, bands}, tables{...},
display). load() reads a folder of such documents by Spark, so it works on any store; built_in() gives those that this package ships, written in a short form
(see definitions.py). The catalogue is a DataFrame of one row a specification: search, counts and names are ordinary queries over it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("slug", "title", "category", "renderer", "document")])
#: Files of a folder that are not specifications.
SKIPPED = ("index.json", "categories.json", "registry.json")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder, one row each: slug, title, category, renderer, document (its JSON)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("document"))
    field = lambda k: F.get_json_object("document", f"$.{k}").alias(k)
    return files.where(~F.col("file").isin(*SKIPPED)).select(field("slug"), field("title"), field("category"), field("renderer"), "document").where("slug is not null")


def frame(spark: SparkSession, specs: Iterable[dict]) -> DataFrame:
    rows = [(s["slug"], s.get("title"), s.get("category"), s.get("renderer"), json.dumps(s)) for s in specs]
    return spark.createDataFrame(rows, SCHEMA)


def built_in(spark: SparkSession) -> DataFrame:
    from carecolumns.sources.definitions import specifications

    return frame(spark, specifications().values())


def normal(c):
    """Lower case, all but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def squashed(c):
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def search(catalog: DataFrame, q: str | None = None, category: str | None = None, renderer: str | None = None) -> DataFrame:
    """Rows in order: titles that begin with the query, hold it, hold all its terms, then others that hold all terms anywhere; shorter titles first."""
    if category is not None:
        catalog = catalog.where(F.coalesce("category", F.lit("Uncategorised")) == category)
    if renderer is not None:
        catalog = catalog.where(F.col("renderer") == renderer)
    terms = re.sub(r"[^a-z0-9]+", " ", (q or "").lower()).split()
    if not terms:
        return catalog.orderBy(F.lower("title"), "slug")
    title, whole = normal(F.col("title")), " ".join(terms)
    hay = normal(F.concat_ws(" ", "title", "slug", F.coalesce("category", F.lit(""))))
    in_title, in_all = F.lit(True), F.lit(True)
    for t in terms:
        in_title, in_all = in_title & title.contains(t), in_all & hay.contains(t)
    rank = F.when(title.startswith(whole), 0).when(title.contains(whole), 1).when(in_title, 2).otherwise(3)
    return catalog.where(in_all).withColumn("rank", rank).orderBy("rank", F.length("title"), F.lower("title"), "slug")


def page(rows: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset 0 or more")
    return rows.offset(offset).limit(limit)


def names(catalog: DataFrame) -> DataFrame:
    return catalog.select("slug", "title").orderBy(F.lower("title"), "slug")


def categories(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.coalesce("category", F.lit("Uncategorised")).alias("category")).agg(F.count("*").alias("specifications")).orderBy("category")


def renderers(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("renderer").agg(F.count("*").alias("specifications")).orderBy("renderer")


def resolve(catalog: DataFrame, name: str) -> dict:
    """The one specification that a name means: its slug, its title or slug in other spelling, or the only hit of a search. LookupError tells five near ones."""
    folded, tight = re.sub(r"[^a-z0-9]+", " ", name.lower()).strip(), re.sub(r"[^a-z0-9]+", "", name.lower())
    for test in (F.col("slug") == name, (normal(F.col("title")) == folded) | (normal(F.col("slug")) == folded), (squashed(F.col("title")) == tight) | (squashed(F.col("slug")) == tight)):
        hit = catalog.where(test).select("document").take(2)
        if len(hit) == 1:
            return json.loads(hit[0][0])
    hits = search(catalog, name).select("title", "document").take(5)
    if len(hits) == 1:
        return json.loads(hits[0][1])
    raise LookupError(f"no specification {name!r}" + (f"; did you mean {', '.join(h[0] for h in hits)}?" if hits else ""))


def children(catalog: DataFrame, what: str) -> DataFrame:
    """Normalised tables of a catalogue: fields, options, units, steps, outputs, groups, group_options, bands, pairs, steps_of_ladders (dose ladders and lookup
    tables), edges and nodes (of trees)."""
    field = "key string, label string, widget string, required boolean, base_unit string, display_unit string, default string, constraints struct<min:double,max:double,exclusive_min:double,exclusive_max:double>, options array<struct<label:string,value:string>>, units array<struct<code:string,label:string,factor:double,offset:double>>"
    schema = f"inputs array<struct<{re.sub(r'(^|, )(\w+) ', r'\1\2:', field)}>>, compute struct<steps:array<struct<key:string,expr:string>>,outputs:array<struct<key:string,label:string,expr:string,decimals:int,base_unit:string,kind:string>>>, scoring struct<groups:array<struct<key:string,label:string,selection:string,required:boolean,options:array<struct<key:string,label:string,points:double>>>>,bands:array<struct<min:double,max:double,label:string>>>, tables struct<pairs:array<struct<from:string,to:string,factor:double,offset:double>>,dose_ladder:struct<values:array<double>>,lookups:array<struct<key:string,select_value:string,rows:array<struct<threshold:double>>>>,nodes:map<string,struct<yes:string,no:string>>,outcomes:map<string,string>>"
    rows = catalog.select("slug", F.from_json("document", schema).alias("d"))
    at = {"fields": "d.inputs", "steps": "d.compute.steps", "outputs": "d.compute.outputs", "groups": "d.scoring.groups", "bands": "d.scoring.bands", "pairs": "d.tables.pairs"}
    if what in at:
        return rows.select("slug", F.posexplode(at[what]).alias("position", "x")).select("slug", "position", "x.*")
    if what == "steps_of_ladders":
        doses = rows.select("slug", F.lit("dose").alias("ladder"), F.posexplode("d.tables.dose_ladder.values").alias("position", "threshold"))
        lookups = rows.select("slug", F.explode("d.tables.lookups").alias("t")).select("slug", F.concat_ws(" ", "t.key", "t.select_value").alias("ladder"), F.posexplode("t.rows.threshold").alias("position", "threshold"))
        return doses.unionByName(lookups)
    if what == "nodes":
        return rows.select("slug", F.explode(F.concat(F.map_keys("d.tables.nodes"), F.map_keys("d.tables.outcomes"))).alias("node"))
    if what == "edges":
        edges = rows.select("slug", F.explode("d.tables.nodes").alias("node", "x"))
        return edges.select("slug", "node", F.explode(F.array("x.yes", "x.no")).alias("to"))
    parent, nested = {"options": ("fields", "options"), "units": ("fields", "units"), "group_options": ("groups", "options")}[what]
    return children(catalog, parent).select("slug", F.col("key").alias("parent"), F.posexplode(nested).alias("position", "x")).select("slug", "parent", "position", "x.*")
