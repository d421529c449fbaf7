"""Checks over specifications: does each evaluate, do its parts hold together, does every choice matter. Probes and parts are rows of DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.operators import evaluation
from carecolumns.sources import catalog

#: The golden ratio's fraction: multiples of it spread evenly over 0 to 1, whatever their number.
GOLDEN = 0.6180339887498949
TURN = "__turn"


def probe(f: dict, turn: Column, place: int) -> Column:
    """A value of a field for each turn: an option in turn, or a place in its range by a low-discrepancy sequence that starts elsewhere for every field."""
    options = f.get("options") or []
    if options and not f.get("options_incomplete"):
        return F.get(F.array(*[F.lit(str(o["value"])) for o in options]), ((turn + place) % len(options)).cast("int"))
    c = f.get("constraints") or {}
    low = c.get("min", c.get("exclusive_min", 1.0))
    high = c.get("max", c.get("exclusive_max", 4 * abs(low) + 25))
    share = ((turn + 1) * F.lit(GOLDEN) + F.lit(place / 7)) % F.lit(1.0)
    return (F.lit(float(low)) + F.lit(float(high - low)) * (F.lit(0.04) + F.lit(0.92) * share)).cast("string")


def probes(turns: DataFrame, turn: str, spec: dict) -> DataFrame:
    """(TURN, fields): a probe of a specification for each row, by its number (0 or more)."""
    return turns.select(F.col(turn).alias(TURN), *[probe(f, F.col(turn), place).alias(f["key"]) for place, f in enumerate(spec.get("inputs") or [])])


def _computed(specs: Iterable[dict]) -> list[dict]:
    return [s for s in specs if s["renderer"] in ("formula", "titration_table")]


def _together(parts: list[DataFrame]) -> DataFrame:
    """The union of many frames, pair by pair: each is analysed a logarithmic number of times."""
    while len(parts) > 1:
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def evaluate_all(turns: DataFrame, turn: str, specs: Iterable[dict]) -> DataFrame:
    """slug, renderer, probes, ok: how many probes of each formula and table, one a row of `turns`, have all their outputs. Plans are built side by side and run as one."""

    def part(s: dict) -> DataFrame:
        out = evaluation.formula(probes(turns, turn, s), s)
        return out.agg(F.count("*").alias("probes"), F.count_if("ok").alias("ok")).select(F.lit(s["slug"]).alias("slug"), F.lit(s["renderer"]).alias("renderer"), "probes", "ok")

    with ThreadPool(4) as pool:
        return _together(pool.map(part, _computed(specs)))


def summary(evaluated: DataFrame) -> DataFrame:
    """By renderer: specifications, and those of which some probe evaluates."""
    return evaluated.groupBy("renderer").agg(F.count("*").alias("specifications"), F.count_if(F.expr("ok > 0")).alias("evaluating"))


def dead_parts(turns: DataFrame, turn: str, specs: Iterable[dict]) -> DataFrame:
    """slug, part, bases, live: each choice field with the number of base probes, one a row of `turns`, whose results change when only its option does, and `*` for the whole
    specification with the number of different results less one. live = 0 tells a choice that no result depends on, or a result that is always the same."""
    parts = []
    for s in _computed(specs):
        fields = [f["key"] for f in s.get("inputs") or []]
        base = probes(turns, turn, s)
        # a base as it is, and once for each option of each choice
        other = [F.struct(F.lit("*").alias("part"), F.lit(None).cast("string").alias("value"))]
        other += [F.struct(F.lit(f["key"]).alias("part"), F.lit(str(o["value"])).alias("value")) for f in s.get("inputs") or [] for o in f.get("options") or []]
        each = base.withColumn("__x", F.explode(F.array(*other))).select(TURN, F.col("__x.part").alias("__part"), *[F.when(F.col("__x.part") == k, F.col("__x.value")).otherwise(F.col(f"`{k}`")).alias(k) for k in fields])
        out = evaluation.formula(each, s).where("ok").select(TURN, "__part", F.to_json("outputs").alias("result"))
        moved = out.where("__part <> '*'").groupBy("__part", TURN).agg((F.count_distinct("result") > 1).alias("moves")).groupBy("__part").agg(F.count("*").alias("bases"), F.count_if("moves").alias("live"))
        whole = out.where("__part = '*'").agg(F.lit("*").alias("__part"), F.count("*").alias("bases"), (F.count_distinct("result") - 1).alias("live"))
        parts.append(moved.unionByName(whole).select(F.lit(s["slug"]).alias("slug"), F.col("__part").alias("part"), "bases", "live"))
    return _together(parts)


def score_ranges(groups: DataFrame, options: DataFrame) -> DataFrame:
    """slug, low, high: the least and greatest total of each score, group by group: one option of a single choice, any of a multiple one."""
    points = options.groupBy("slug", F.col("parent").alias("key")).agg(
        F.min("points").alias("least"), F.max("points").alias("most"),
        F.coalesce(F.sum(F.when(F.col("points") < 0, F.col("points"))), F.lit(0.0)).alias("minus"), F.coalesce(F.sum(F.when(F.col("points") > 0, F.col("points"))), F.lit(0.0)).alias("plus"),
    )
    many = F.col("selection") == "multiple"
    each = groups.select("slug", "key", "selection").join(points, ["slug", "key"])
    return each.groupBy("slug").agg(F.sum(F.when(many, F.col("minus")).otherwise(F.col("least"))).alias("low"), F.sum(F.when(many, F.col("plus")).otherwise(F.col("most"))).alias("high"))


def invariants(catalogue: DataFrame) -> DataFrame:
    """slug, rule, detail of each broken rule of a catalogue: bounds out of order, options repeated, defaults out of bounds, bands that no total reaches or whose range is there twice
    under labels that do not tell them apart, labels without a word, ladders that do not rise, pairs repeated, tree edges that lead nowhere."""
    part = lambda what: catalog.children(catalogue, what)
    say = lambda df, rule, detail: df.select("slug", F.lit(rule).alias("rule"), F.col(detail).alias("detail"))
    fields = part("fields").withColumns({"low": F.coalesce("constraints.min", "constraints.exclusive_min"), "high": F.coalesce("constraints.max", "constraints.exclusive_max")})
    default = F.col("default").try_cast("double")
    bands = part("bands").join(score_ranges(part("groups"), part("group_options")), "slug")
    spans = bands.groupBy("slug", "min", "max").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.bool_and(F.contains("label", F.lit(":"))).alias("named"), F.min("label").alias("label"))
    steps = part("steps_of_ladders").withColumn("before", F.lag("threshold").over(Window.partitionBy("slug", "ladder").orderBy("position")))
    found = [
        say(fields.where("low >= high"), "bounds", "key"),
        say(part("options").groupBy("slug", "parent", "value").count().where("count > 1").select("slug", "parent").distinct(), "options", "parent"),
        say(fields.where((default < F.col("low")) | (default > F.col("high"))), "default", "key"),
        say(bands.where("min > high or max < low"), "band", "label"),
        say(spans.where("n > 1 and (labels < n or not named)"), "span", "label"),
        say(bands.where("contains(label, '**') or not label rlike '[A-Za-z0-9]'"), "label", "label"),
        say(steps.where("threshold <= before").select("slug", "ladder").distinct(), "ladder", "ladder"),
        say(part("pairs").groupBy("slug", "from", "to").count().where("count > 1"), "pair", "from"),
        say(part("edges").join(part("nodes").select("slug", F.col("node").alias("to")), ["slug", "to"], "left_anti"), "edge", "node"),
    ]
    return reduce(DataFrame.unionByName, found)


#: What a complete specification has: (name, whether it applies, whether it holds), as SQL over the columns of graded().
MARKS = (
    ("title", "true", "length(trim(title)) > 0"), ("category", "true", "category is not null"), ("fields labelled", "fields > 0", "labelled = fields"),
    ("fields bounded or chosen", "fields > 0", "bounded = fields"), ("outputs", "renderer in ('formula', 'titration_table')", "outputs > 0"), ("bands", "renderer = 'score'", "bands > 0"), ("pairs", "renderer = 'convert'", "pairs > 0"),
)


def graded(catalogue: DataFrame) -> DataFrame:
    """slug, passed, applicable, completeness: the share in percent of the marks that apply to a specification and hold."""
    count = lambda what, *more: catalog.children(catalogue, what).groupBy("slug").agg(F.count("*").alias(what), *more)
    bounded = F.count_if(F.expr("constraints.min is not null or constraints.max is not null or constraints.exclusive_min is not null or constraints.exclusive_max is not null or size(options) > 0")).alias("bounded")
    rows = catalogue.select("slug", "title", "category", "renderer")
    for df in (count("fields", F.count_if(F.expr("length(trim(label)) > 0")).alias("labelled"), bounded), count("outputs"), count("bands"), count("pairs")):
        rows = rows.join(df, "slug", "left")
    rows = rows.na.fill(0, ["fields", "labelled", "bounded", "outputs", "bands", "pairs"])
    total = lambda parts: reduce(lambda a, b: a + b, [F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in parts])
    rows = rows.withColumns({"passed": total(f"({a}) and ({h})" for _, a, h in MARKS), "applicable": total(a for _, a, _ in MARKS)})
    return rows.select("slug", "passed", "applicable", F.round(100.0 * F.col("passed") / F.col("applicable"), 1).alias("completeness"))


def difference(built: DataFrame, published: DataFrame) -> DataFrame:
    """slug, status: documents that only one side has (built, published), and those that differ (changed)."""
    a, b = built.select("slug", F.col("document").alias("a")), published.select("slug", F.col("document").alias("b"))
    status = F.when(F.col("b").isNull(), "built").when(F.col("a").isNull(), "published").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "slug", "full").select("slug", status.alias("status")).where("status is not null")


def merged_pairs(catalogue: DataFrame) -> DataFrame:
    """from, to, factor, offset, slug: all conversion pairs; of those with the same ends the first by slug and place counts."""
    pairs = catalog.children(catalogue, "pairs")
    first = F.min(F.struct("slug", "position", "factor", "offset")).alias("x")
    return pairs.groupBy("from", "to").agg(first).select("from", "to", "x.factor", "x.offset", "x.slug")


def publish(catalogue: DataFrame, folder: str) -> None:
    """Write a catalogue: its documents as JSON text, and the index and the counts by category as JSON, each in a folder of its own, replaced as a whole."""
    catalogue.select("document").write.mode("overwrite").text(f"{folder}/specifications")
    catalogue.select("slug", "title", "category", "renderer").coalesce(1).write.mode("overwrite").json(f"{folder}/index")
    catalog.categories(catalogue).coalesce(1).write.mode("overwrite").json(f"{folder}/categories")

