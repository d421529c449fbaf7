"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import batch, cut, release

#: Up to so many edges, one task finishes the work in some 100 MB; beyond it, stars are contracted over the cluster.
ONE_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition in, (node, smallest node of its tree) out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    out = [(x, root(x)) for x in list(parent)]
    for k in range(0, len(out), 50_000):
        part = np.array(out[k : k + 50_000], np.int64)
        yield batch(["a", "b"], part[:, 0], part[:, 1])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): the smallest id that each node of `edges` (a, b: long, not null) reaches, for nodes that are not roots.

    Each task first replaces its own edges by a forest of stars. What is left is finished in one task if a count shows it to be small enough; otherwise
    large-star and small-star steps (hash joins and grouped minima) run until no edge changes.
    """
    edges = cut(edges.select("a", "b").mapInArrow(_forest, "a long, b long"))
    if edges.count() <= one_task:
        return edges.repartition(1).mapInArrow(_forest, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges_now, seen = edges, None
    while True:
        both = edges_now.unionByName(edges_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a > m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = cut(small.where("a <> b"))
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(edges_now)
        edges_now = small
        if now == seen:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
