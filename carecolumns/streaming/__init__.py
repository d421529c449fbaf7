"""Specifications over streams: formulas are stateless projections, so they run unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.operators import evaluation


def formula_stream(stream: DataFrame, spec: dict) -> DataFrame:
    """ok, errors, warnings and outputs for each arriving row."""
    return evaluation.formula(stream, spec)


def windowed(results: DataFrame, time: str, output: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of rows, of failures, and the mean of an output by window; rows later than `late` are left out by the watermark."""
    w = results.withWatermark(time, late).groupBy(F.window(time, window))
    return w.agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("failed"), F.avg(F.col(f"outputs.{output}.value")).alias("mean")).select(F.col("window.start").alias("start"), "rows", "failed", "mean")
