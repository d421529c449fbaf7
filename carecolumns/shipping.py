"""Python workers need this package where the cluster does not install it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None) -> None:
    """Send the package's sources to the executors, once a Spark context."""
    if spark is None or getattr(spark.sparkContext, "_carecolumns_sent", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="carecolumns-"), "carecolumns.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._carecolumns_sent = True
