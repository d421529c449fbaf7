"""Titles to the entries of a catalogue that they mean, and the best of several rows that mean the same.

A title means the entry of its folded name, else that of an alias, else that of its squashed name, else the entry whose folded name is likest, if it is like enough. The
likeness is that of matching blocks: twice the characters in them over all characters. Pairs to be compared come from a blocked similarity join that loses none: names
that are like enough share so many pairs of letters that one of them is among the rarest of both.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from carecolumns.functions.text import folded
from carecolumns.shipping import ship

#: Likeness from which a name is a candidate, and from which it is almost certain.
FLOOR, ACCEPT = 0.82, 0.93


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _grams(names: DataFrame) -> DataFrame:
    """(name, size, gram): each pair of neighbouring letters of a name, equal ones numbered."""
    pairs = names.select("name", F.length("name").alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", i, F.lit(2)))).alias("pair"))
    times = pairs.groupBy("name", "size", "pair").agg(F.count("*").alias("times"))
    return times.select("name", "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda k: F.concat("pair", k.cast("string")))).alias("gram"))


def like_names(left: DataFrame, right: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(name, other, score): all pairs of distinct names of two tables (name) whose likeness is at least `floor`, which must be above 0.8.

    With sizes a and b, likeness r leaves (1 - r)(a + b) letters unmatched at most, so the matched ones stand in no more blocks than that and one, and share
    (3 r / 2 - 1)(a + b) - 1 pairs of neighbours at least; sizes differ by a factor of r / (2 - r) at most. Of a name's pairs in order of rarity, that many may be left out at the
    end. Above 0.8 that is one pair at least, and names of one or two letters are like none but themselves.
    """
    if floor <= 0.8:
        raise ValueError("likeness must be above 0.8")
    ship(left.sparkSession)
    least = floor / (2 - floor)
    sides = [df.where(F.length("name") > 2).select("name").distinct() for df in (left, right)]
    grams = [_grams(s) for s in sides]
    rare = grams[0].unionByName(grams[1]).groupBy("gram").agg(F.count("*").alias("n"))

    def prefix(g: DataFrame, to: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("name").orderBy("n", "gram"))
        shared = F.greatest(F.lit(1), F.ceil((1.5 * floor - 1) * (1 + least) * F.col("size") - 1 - 1e-9))
        return g.join(rare, "gram").withColumn("place", place).where(F.col("place") <= F.col("size") - 1 - shared + 1).select("gram", F.col("name").alias(to[0]), F.col("size").alias(to[1]))

    pairs = prefix(grams[0], ["name", "a"]).join(prefix(grams[1], ["other", "b"]), "gram").where((F.col("a") >= least * F.col("b") - 1e-9) & (F.col("b") >= least * F.col("a") - 1e-9))
    return pairs.select("name", "other").distinct().withColumn("score", _ratio("name", "other")).where(F.col("score") >= floor)


def match_titles(titles: DataFrame, catalogue: DataFrame, aliases: DataFrame | None = None, floor: float = FLOOR) -> DataFrame:
    """titles (title, others) to their rows with slug, method (exact, alias, squashed, fuzzy, none), score and review (whether a reader should confirm it).

    catalogue: (slug, title, others ignored); aliases: (written, meant), titles and the entries' titles that they stand for. Of entries of the same name that of the least slug counts; of equally like names the first in byte order. Null titles and those without a letter
    or digit match none, nor does such an entry. Each row stays, repeated ones too.
    """
    entries = catalogue.select("slug", folded(F.col("title")).alias("name")).where("name <> ''")
    by_name = entries.groupBy("name").agg(F.min("slug").alias("slug"))
    by_squash = entries.groupBy(F.replace("name", F.lit(" "), F.lit("")).alias("tight")).agg(F.min("slug").alias("slug"))
    wanted = titles.select("title").distinct().withColumn("name", folded(F.col("title")))
    names = wanted.select("name").where("name <> ''").distinct()
    also = aliases if aliases is not None else titles.sparkSession.createDataFrame([], "written string, meant string")
    also = also.select(folded(F.col("written")).alias("name"), folded(F.col("meant")).alias("meant")).groupBy("name").agg(F.min("meant").alias("meant"))
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    found = names.join(by_name.withColumnRenamed("slug", "exact"), "name", "left").join(also, "name", "left")
    found = found.join(by_name.select(F.col("name").alias("meant"), F.col("slug").alias("alias")), "meant", "left")
    found = found.join(by_squash.select(F.col("tight").alias("meant_tight"), F.col("slug").alias("alias_too")), tight(F.col("meant")) == F.col("meant_tight"), "left")
    found = found.join(by_squash.select("tight", F.col("slug").alias("squashed")), tight(F.col("name")) == F.col("tight"), "left")
    ways = [("exact", F.col("exact"), 1.0), ("alias", F.coalesce("alias", "alias_too"), 1.0), ("squashed", F.col("squashed"), 0.99)]
    method, slug, score = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, hit, value in reversed(ways):
        method, slug, score = F.when(hit.isNotNull(), name).otherwise(method), F.coalesce(hit, slug), F.when(hit.isNotNull(), value).otherwise(score)
    found = found.select("name", method.alias("method"), slug.alias("slug"), score.alias("score"))
    open_ = found.where("method is null").select("name")
    best = like_names(open_, by_name.select("name"), floor).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("less"), "other")).alias("x")).select("name", F.col("x.other").alias("other"), (-F.col("x.less")).alias("near"))
    best = best.join(by_name.select(F.col("name").alias("other"), F.col("slug").alias("near_slug")), "other").drop("other")
    found = found.join(best, "name", "left").select("name", F.coalesce("method", F.when(F.col("near").isNotNull(), "fuzzy"), F.lit("none")).alias("method"), F.coalesce("slug", "near_slug").alias("slug"), F.coalesce("score", "near").alias("score"))
    every = wanted.join(found, "name", "left").select(F.col("title").alias("t"), F.struct("slug", F.coalesce("method", F.lit("none")).alias("method"), "score", (F.coalesce("method", F.lit("none")) == "fuzzy").alias("review")).alias("m"))
    rows = titles.select(F.struct(*[F.col(f"`{c}`") for c in titles.columns]).alias("row")).join(every, F.col("row.title").eqNullSafe(F.col("t")), "left")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in titles.columns if c not in ("slug", "method", "score", "review")], "m.slug", "m.method", "m.score", "m.review")


#: Parts that the rows of one key are dealt to before its best are brought together.
SALTS = 64


def keep_best(df: DataFrame, keys: list[str], order: list[Column], many: int = 1) -> DataFrame:
    """df with the first `many` rows of each key in an order, and their `rank`. Rows that the order does not tell apart are ordered by their JSON, so the result is always the
    same; null keys are a key. A key of any number of rows is first ranked in SALTS parts, each of which hands on `many` rows at most."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    last = F.to_json(row)
    part = F.pmod(F.xxhash64(last, F.monotonically_increasing_id()), F.lit(SALTS))
    by = [F.col(f"`{k}`") for k in keys]
    held = df.select("*", part.alias("__part"))
    for extra in ([F.col("__part")], []):
        held = held.withColumn("rank", F.row_number().over(Window.partitionBy(*by, *extra).orderBy(*order, last))).where(F.col("rank") <= many)
    return held.drop("__part")


#: The mark that a system adds to a second download of a name, one digit in brackets; a year is none.
COPY = r"\s*\(\d\)\s*$"


def without_copies(df: DataFrame, name: str) -> DataFrame:
    """One row of each name, copies such as `Foo (2)` counting as `Foo`: that of the shortest name, then of the first."""
    base = F.lower(F.trim(F.regexp_replace(F.col(f"`{name}`"), COPY, "")))
    return keep_best(df.withColumn("__base", base), ["__base"], [F.length(f"`{name}`"), F.col(f"`{name}`")]).drop("__base", "rank")
