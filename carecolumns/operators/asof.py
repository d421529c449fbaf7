"""As-of lookups and interpolation in ladders of any number and length, in one pass over rows and steps together.

Rows and steps are put in one order (select columns, value) and cut into ranges of about equal size, wherever keys begin or end and whatever the number of equal
values, so no key is a task. Inside a range each row takes the next step behind it and the last one before it: running last values over both orders. What a range leaves
open at an end is carried over from the nearest step beyond, of which there is one a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.storage import cut


def _named(columns: list[str], of: str = "") -> list[Column]:
    return [F.col(f"{of}`{c}`").alias(c) for c in columns]


def _steps(ladder: DataFrame, select: list[str]) -> tuple[DataFrame, list[str]]:
    """Distinct steps (select columns, threshold, others): of equal thresholds that of the least others counts. Null and NaN thresholds are no steps."""
    others = [c for c in ladder.columns if c not in (*select, "threshold")]
    rows = ladder.where(F.col("threshold").isNotNull() & ~F.isnan(F.col("threshold").cast("double")))
    if not others:
        return rows.select(*_named(select), "threshold").distinct(), others
    rows = rows.groupBy(*_named(select), F.col("threshold")).agg(F.min(F.struct(*_named(others))).alias("o"))
    return rows.select(*_named(select), "threshold", *_named(others, "o.")), others


def around(df: DataFrame, ladder: DataFrame, value: str, select: list[str] | None = None, operator: str = "<", ranges: int | None = None) -> DataFrame:
    """(row, x, next, before): each row of df as a struct, its value as a double, and the steps around it in its ladder (threshold, [select columns], others), each a struct of
    threshold and others, null where there is none.

    `next` is the first step whose threshold is above the value (`<`) or at least at it (`<=`), `before` the last of the others. Null values, NaN and null select
    columns have neither. Each row of df stays, repeated ones too. `ranges` is the number of pieces that the order is cut into (by default, of shuffle partitions).
    """
    spark, select = df.sparkSession, select or []
    steps, others = _steps(ladder, select)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*_named(select) or [F.lit(0).alias("all")]).alias("key")
    # at equal values a step stands behind the row where it counts for it, else before it
    behind = 1 if operator == "<=" else -1
    rows = df.select(key, F.col(f"`{value}`").cast("double").alias("x"), F.lit(0).alias("kind"), F.struct(*_named(df.columns)).alias("row"))
    marks = steps.select(key, F.col("threshold").cast("double").alias("x"), F.lit(behind).alias("kind"), F.struct("threshold", *_named(others)).alias("step"))
    # the running number lets equal rows lie in several ranges
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("spread", F.monotonically_increasing_id())
    placed = cut(both.repartitionByRange(ranges, "key", "x", "kind", "spread").drop("spread").withColumn("range", F.spark_partition_id()))
    mark = F.struct("key", "step")
    ends = placed.where("kind <> 0").groupBy("range").agg(F.min_by(mark, F.struct("key", "x")).alias("first"), F.max_by(mark, F.struct("key", "x")).alias("last"))
    every = spark.range(ranges).select(F.col("id").cast("int").alias("range")).join(ends, "range", "left")  # a row a range
    nearest = lambda end, order: F.last(end, ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select("range", nearest("first", F.desc("range")).alias("from_next"), nearest("last", F.asc("range")).alias("from_before"))
    order = [F.col(c) for c in ("key", "x", "kind")]
    run = lambda by: F.last(F.when(F.col("kind") != 0, mark), ignorenulls=True).over(Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = placed.withColumns({"next": run([c.desc() for c in order]), "before": run([c.asc() for c in order])}).where("kind = 0").join(F.broadcast(carried), "range")
    known = F.col("x").isNotNull() & ~F.isnan("x")
    for c in select:
        known = known & F.col(f"key.`{c}`").isNotNull()

    def own(inside: str, beyond: str) -> Column:
        found = F.coalesce(inside, beyond)
        return F.when(known & (found["key"] == F.col("key")), found["step"]).alias(inside)

    return seen.select("row", "x", own("next", "from_next"), own("before", "from_before"))


def ladder_join(df: DataFrame, ladder: DataFrame, value: str, select: list[str] | None = None, operator: str = "<", ranges: int | None = None) -> DataFrame:
    """df with threshold and the other columns of the first step above its value (`<`), or at least at it (`<=`), in a ladder (threshold, [select columns], others).

    Rows above every threshold, null values, NaN and null select columns get nulls.
    """
    found = around(df, ladder, value, select, operator, ranges)
    others = ["threshold", *[c for c in ladder.columns if c not in (*(select or []), "threshold")]]
    return found.select(*_named(df.columns, "row."), *_named(others, "next."))


def interpolated(df: DataFrame, ladder: DataFrame, value: str, columns: list[str], select: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """df with each of `columns`, which replace columns of those names, interpolated between the two steps of a ladder (threshold, [select columns], columns) around its
    value, and held beyond both ends.

    Ladders are data: any number of them, told apart by the select columns. Null values, NaN and rows without a ladder get nulls, as do columns that one of both steps
    lacks.
    """
    found = around(df, ladder.select(*_named(select or []), "threshold", *_named(columns)), value, select, "<=", ranges)
    low, high = F.col("before.threshold").cast("double"), F.col("next.threshold").cast("double")

    def at(c: str) -> Column:
        a, b = F.col(f"before.`{c}`"), F.col(f"next.`{c}`")
        return F.when(F.col("before").isNull(), b).when(F.col("next").isNull(), a).otherwise(a + (b - a) * ((F.col("x") - low) / (high - low))).alias(c)

    return found.select(*_named([c for c in df.columns if c not in columns], "row."), *[at(c) for c in columns])
