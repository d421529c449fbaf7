"""Lists of units as tables: rebased to another unit, filled from canonical ones, told their dimension; compound units and conversions along paths.

A unit's factor and offset take a value to the base of its list: base = value * factor + offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.sources.units import PASSED_THROUGH, canonical
from carecolumns.storage import cut, release


def tight(c: Column) -> Column:
    """A unit's code as it is compared: lower case, letters, digits and % only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9%]", "")


def rebased(units: DataFrame, lists: DataFrame, key: str = "list") -> DataFrame:
    """units (list, code, factor, offset) of each list (list, base), written anew so that the list's base unit is the identity.

    Lists whose base is none of their units, or has no factor, are not changed; units without a factor stay without one. Of several units of the base's code the one of the
    least factor and offset is the base. Lists that `lists` does not name are left out.
    """
    own = units.join(lists.select(key, "base"), key)
    base = own.where((tight(F.col("code")) == tight(F.col("base"))) & (F.coalesce("factor", F.lit(0.0)) != 0)).groupBy(key).agg(F.min(F.struct("factor", F.coalesce("offset", F.lit(0.0)).alias("offset"))).alias("b"))
    factor, offset = F.coalesce("b.factor", F.lit(1.0)), F.coalesce("b.offset", F.lit(0.0))
    return own.join(base, key, "left").select(key, "code", "base", (F.col("factor") / factor).alias("factor"), F.when(F.col("factor").isNotNull(), (F.coalesce("offset", F.lit(0.0)) - offset) / factor).alias("offset"), F.col("b").isNotNull().alias("rebased"))


def one_per_scale(units: DataFrame, key: str = "list") -> DataFrame:
    """units (list, code, base, factor, offset) with one code of each scale (factor and offset to 12 places): the base's own, else the longest spelling, else the first."""
    scale = [F.round("factor", 12), F.round(F.coalesce("offset", F.lit(0.0)), 12)]
    order = Window.partitionBy(key, *scale).orderBy(F.when(tight(F.col("code")) == tight(F.col("base")), 0).otherwise(1), F.desc(F.length("code")), "code")
    return units.where("factor is not null").withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def filled(units: DataFrame) -> DataFrame:
    """units (dimension, code, factor, offset, others) with factors that are missing taken from the canonical ones of the dimension, and `source`: stated, canonical, passed
    through (factor 1) or null where nothing is known."""
    known = canonical(units.sparkSession).select(F.col("dimension").alias("__d"), F.col("code").alias("__c"), F.col("factor").alias("__f"), F.col("offset").alias("__o"))
    rows = units.join(F.broadcast(known), (F.col("dimension") == F.col("__d")) & (tight(F.col("code")) == F.col("__c")), "left")
    passes = tight(F.col("code")).isin(*PASSED_THROUGH)
    source = F.when(F.col("factor").isNotNull(), "stated").when(F.col("__f").isNotNull(), "canonical").when(passes, "passed through")
    new = {"source": source, "offset": F.when(F.col("factor").isNotNull(), F.coalesce("offset", F.lit(0.0))).when(F.col("__f").isNotNull(), F.col("__o")).when(passes, 0.0), "factor": F.coalesce("factor", "__f", F.when(passes, 1.0))}
    return rows.withColumns(new).drop("__d", "__c", "__f", "__o")


def dimension_of(codes: DataFrame, key: str = "list") -> DataFrame:
    """codes (list, code), a row a unit of a list, to (list, dimension): the canonical dimension that most of them belong to, the first of equals; null where less than half
    (rounded down, but one at least) do. Null codes do not count; a list without any has none."""
    known = canonical(codes.sparkSession).select("place", "dimension", F.col("code").alias("__c"))
    rows = codes.where("code is not null").select(key, tight(F.col("code")).alias("__c"))
    count = rows.groupBy(key).agg(F.count("*").alias("codes"))
    hits = rows.join(F.broadcast(known), "__c").groupBy(key, "place", "dimension").agg(F.count("*").alias("hits"))
    best = hits.groupBy(key).agg(F.min(F.struct((-F.col("hits")).alias("less"), "place", "dimension")).alias("x"))
    enough = -F.col("x.less") >= F.greatest(F.lit(1), F.floor(F.col("codes") / 2))
    return count.join(best, key, "left").select(key, F.when(enough, F.col("x.dimension")).alias("dimension"))


#: Dimensions whose units have names of their own in compound ones; a compound's time is counted in hours.
SIMPLE = ("mass", "length", "pressure", "time", "volume", "fraction")


def _parts(code: Column, known: dict[str, tuple[str, float]]) -> Column:
    """(d, f) of each part of a compound code: its dimension and what a value is multiplied by for it. The first part counts up, the others down; both are null where no unit
    has that name."""
    table = F.create_map(*[x for k, (d, f) in known.items() for x in (F.lit(k), F.struct(F.lit(d).alias("d"), F.lit(f).alias("f")))])
    units = F.transform(F.split(F.lower(code), "/"), lambda p: F.try_element_at(table, F.regexp_replace(p, "[^a-z0-9%]", "")))
    return F.transform(units, lambda u, i: F.struct(u["d"].alias("d"), F.pow(u["f"], F.when(i == 0, 1).otherwise(-1)).alias("f")))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _factor(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(1.0), lambda s, x: s * x["f"])


def compound(code: Column, known: dict[str, tuple[str, float]]) -> tuple[Column, Column]:
    """(dimension vector, factor) of a compound code such as mcg/kg/minute: a map of dimensions to exponents other than 0, and what a value is multiplied by to have it in base
    units. The first part counts up, the others down; a part that no unit is named by makes both null."""
    names = sorted({d for d, _ in known.values()})
    up, down = lambda p, d: (p["d"][0] == d).cast("int"), lambda p, d: F.size(F.filter(F.slice(p["d"], 2, F.size(p)), lambda x: x == d))
    exponents = lambda p: F.array(*[F.struct(F.lit(d).alias("k"), (up(p, d) - down(p, d)).alias("v")) for d in names])
    vector = _once(_parts(code, known), lambda p: F.when(_factor(p).isNotNull(), F.map_from_entries(F.filter(exponents(p), lambda x: x["v"] != 0))))
    return vector, _factor(_parts(code, known))


def simple_units() -> dict[str, tuple[str, float]]:
    from carecolumns.sources.units import canonical_rows

    return {code: (dimension, factor) for _, dimension, _, code, factor, offset in reversed(canonical_rows()) if dimension in SIMPLE and offset == 0}


def converted(df: DataFrame, value: str, from_unit: str, to_unit: str) -> DataFrame:
    """df with `converted`: its value in another compound unit, null where a unit is unknown or their dimensions differ."""
    known = simple_units()
    # dimensions are the same if what counts up in one and down in the other is, either way; a factor is null where a part is unknown
    both = lambda x, y: F.sort_array(F.concat(F.slice(x["d"], 1, 1), F.slice(y["d"], 2, F.size(y))))
    units = F.struct(_parts(F.col(f"`{from_unit}`"), known).alias("a"), _parts(F.col(f"`{to_unit}`"), known).alias("b"), F.col(f"`{value}`").alias("v"))
    return df.withColumn("converted", _once(units, lambda u: F.when(both(u["a"], u["b"]) == both(u["b"], u["a"]), u["v"] * _factor(u["a"]) / _factor(u["b"]))))


def along_paths(pairs: DataFrame, bases: DataFrame) -> DataFrame:
    """pairs (from, to, factor, offset: to = from * factor + offset) composed into (unit, base, factor, offset, steps): what takes each unit to each base (base) that a path
    leads to, forwards or backwards.

    Of several paths the shortest counts, then the one of the least last unit; a path never comes back to a unit, so circles end. Pairs without a unit, or whose factor is
    null or 0, lead nowhere. As many joins as the longest of the shortest paths; each round's units are written and only new ones go on.
    """
    ok = pairs.where("`from` is not null and `to` is not null and coalesce(factor, 0) <> 0").select("from", "to", "factor", F.coalesce("offset", F.lit(0.0)).alias("offset"))
    # a step from a unit that is known (b) to one behind it (a): what takes a to b
    there = ok.select(F.col("to").alias("b"), F.col("from").alias("a"), F.col("factor").alias("f"), F.col("offset").alias("o"))
    back = ok.select(F.col("from").alias("b"), F.col("to").alias("a"), (1 / F.col("factor")).alias("f"), (-F.col("offset") / F.col("factor")).alias("o"))
    steps = cut(there.unionByName(back).where("a <> b").groupBy("a", "b").agg(F.min(F.struct("f", "o")).alias("x")).select("a", "b", "x.f", "x.o"))
    every = cut(bases.where("base is not null").select(F.col("base").alias("unit"), "base", F.lit(1.0).alias("factor"), F.lit(0.0).alias("offset"), F.lit(0).alias("steps")).distinct())
    last = every
    while True:
        ahead = last.join(steps, F.col("unit") == F.col("b")).select(F.col("a").alias("unit"), "base", "b", (F.col("f") * F.col("factor")).alias("factor"), (F.col("o") * F.col("factor") + F.col("offset")).alias("offset"), (F.col("steps") + 1).alias("steps"))
        ahead = ahead.join(every.select("unit", "base"), ["unit", "base"], "left_anti").groupBy("unit", "base").agg(F.min(F.struct("b", "factor", "offset", "steps")).alias("x"))
        last = cut(ahead.select("unit", "base", "x.factor", "x.offset", "x.steps"))
        if last.isEmpty():
            break
        # the union of rounds reads one table a round
        every = every.unionByName(last)
    out = cut(every)
    release(steps)
    return out
