"""A barrier for the optimizer, for native operators over costly expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *names: str) -> DataFrame:
    """df with columns that are evaluated once a row: the optimizer does not copy expressions across a generator into each place that names them."""
    return df.withColumn("_held", F.explode(F.array(F.struct(*names)))).withColumns({n: F.col(f"_held.{n}") for n in names}).drop("_held")
