"""Reference ladders put together from the branches that a script holds, in source order.

A run of branches ends where the source, the key or the operator changes, or where thresholds go back. Runs of one key that go on forward are pieces of one ladder and are
joined; those that start again are variants and stay apart. Branches repeated by a page drawn twice count once, the fullest last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.operators.ordered import RANGE, placed, with_before, with_running_sum

CLOSE = 1e-9


def ladders(branches: DataFrame, columns: list[str], least: int = 8, ranges: int | None = None) -> DataFrame:
    """branches (source, position, key, operator, threshold, columns) to (source, ladder, key, operator, threshold, columns, piece, restarts).

    `ladder` numbers the ladders of a source from 1 in source order, `piece` the runs of a ladder, and `restarts` tells that the ladder's first piece overlaps the ladder before it
    of the same key: it is a variant of it. Runs of fewer than `least` different thresholds are left out, and so are runs equal to an earlier one of their source. Branches without a
    threshold or without any column are none. Rows of one source and position are taken in order of their content.
    """
    cells = [F.col(f"`{c}`") for c in columns]
    has = sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))
    rows = branches.select("source", "position", "key", "operator", F.col("threshold").cast("double").alias("threshold"), F.struct(*cells).alias("cells"), has.alias("has"))
    rows = rows.where(F.col("threshold").isNotNull() & ~F.isnan("threshold") & (F.col("has") > 0))
    order = ["source", "position", "key", "operator", "threshold", "has", "cells", "number"]
    rows = placed(rows.withColumn("number", F.monotonically_increasing_id()), order, ranges)
    rows = with_before(rows, order, F.struct("source", "key", "operator", "threshold"), "last")
    same = F.col("last").isNotNull() & F.col("last.source").eqNullSafe(F.col("source")) & F.col("last.key").eqNullSafe(F.col("key")) & F.col("last.operator").eqNullSafe(F.col("operator"))
    begins = ~(same & (F.col("threshold") >= F.col("last.threshold")))
    rows = with_running_sum(rows, order, F.when(begins, 1).otherwise(0), "run")
    # of a threshold repeated in a run the branch of most columns counts, of those the last
    steps = rows.groupBy("source", "run", "key", "operator", "threshold").agg(F.max_by(F.struct("cells", "position"), F.struct("has", "position", "number")).alias("x"))
    steps = steps.select("source", "run", "key", "operator", "threshold", "x.cells", "x.position")
    runs = steps.groupBy("source", "run", "key", "operator").agg(
        F.count("*").alias("steps"), F.min("threshold").alias("low"), F.max("threshold").alias("high"),
        # equal runs have equal sums of hashes, of two kinds
        F.sum(F.xxhash64("threshold", F.to_json("cells")).cast("decimal(38,0)")).alias("mark"), F.sum(F.hash("threshold", F.to_json("cells")).cast("long")).alias("mark_too"),
    ).where(F.col("steps") >= least)
    runs = runs.groupBy("source", "key", "operator", "steps", "low", "high", "mark", "mark_too").agg(F.min("run").alias("run"))
    # runs are numbered in source order
    runs = placed(runs.select("source", "run", "key", "operator", "low", "high"), ["source", "run"], ranges)
    runs = with_before(runs, ["source", "run"], F.struct("source", "key", "operator", "low", "high"), "last")
    alike = F.col("last").isNotNull() & F.col("last.source").eqNullSafe(F.col("source")) & F.col("last.key").eqNullSafe(F.col("key")) & F.col("last.operator").eqNullSafe(F.col("operator"))
    forward = alike & (F.col("low") >= F.col("last.high") - CLOSE) & (F.col("high") > F.col("last.high")) & (F.col("low") > F.col("last.low"))
    runs = with_running_sum(runs.withColumns({"forward": F.coalesce(forward, F.lit(False)), "alike": F.coalesce(alike, F.lit(False))}), ["source", "run"], F.when(F.coalesce(forward, F.lit(False)), 0).otherwise(1), "group").drop(RANGE)
    firsts = runs.groupBy("source", "group").agg(F.min("run").alias("first"), F.min_by(F.col("alike"), "run").alias("restarts"))
    each = firsts.groupBy("source").agg(F.min("group").alias("least"))
    runs = runs.select("source", "run", "group").join(firsts.select("group", "first", "restarts"), "group").join(each.select("least", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))
    ladder = (F.col("group") - F.col("least") + 1).alias("ladder")
    steps = steps.join(runs.select("run", ladder, "first", "restarts"), "run")
    # a threshold that two pieces of a ladder share is that of the earlier piece
    out = steps.groupBy("source", "ladder", "key", "operator", "threshold", "restarts").agg(F.min_by(F.struct("cells", "run"), "run").alias("x"), F.min("first").alias("first"))
    return out.select("source", F.col("ladder").cast("int").alias("ladder"), "key", "operator", "threshold", *[F.col(f"x.cells.`{c}`").alias(c) for c in columns], F.col("x.run").alias("piece"), "restarts")
