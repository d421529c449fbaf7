"""Rows in one order, cut into ranges of about equal size: what the row before holds, and sums of all rows so far, without one task for a key or for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.storage import cut

RANGE = "__range"


def placed(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """df written in ranges of an order that tells all rows apart, with their number in RANGE."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id()))


def with_before(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """placed() rows with what `value`, a struct, is in the row before, whatever range that is in; null in the first row."""
    inside = Window.partitionBy(RANGE).orderBy(*order)
    ends = df.groupBy(RANGE).agg(F.max_by(value, F.struct(*order)).alias("__end"))
    carried = ends.select((F.col(RANGE)).alias(RANGE), F.lag("__end").over(Window.orderBy(RANGE)).alias("__carried"))  # a row a range that has rows
    return df.withColumn(name, F.lag(value).over(inside)).join(F.broadcast(carried), RANGE).withColumn(name, F.coalesce(name, "__carried")).drop("__carried")


def with_running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """placed() rows with the sum of `value` up to and with each row."""
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = df.groupBy(RANGE).agg(F.sum(value).alias("__sum"))
    carried = ends.select(RANGE, F.coalesce(F.sum("__sum").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__carried"))  # a row a range
    return df.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(carried), RANGE).withColumn(name, F.col(name) + F.col("__carried")).drop("__carried")
