"""Yes/no trees as edge tables: subjects walk many trees at once, some steps a round, until none moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.storage import cut, release

#: Steps that are joined before what moved is written.
STEPS = 8


def positive(answer: Column) -> Column:
    """yes, y, true and 1 in any case; anything else, null too, is no."""
    return F.coalesce(F.lower(F.trim(answer)).isin("yes", "y", "true", "1"), F.lit(False))


def walk(subjects: DataFrame, edges: DataFrame, roots: DataFrame, steps: int = STEPS) -> DataFrame:
    """subjects (subject, tree, answers array) to (subject, tree, node, steps): where the answers lead in the tree, and how many of them were used.

    edges: (tree, node, yes boolean, to), roots: (tree, root). A walk ends with its answers, at a node without an edge for the answer, or at an edge to nowhere (node null). Subjects of a tree without
    a root end at null. Of several edges of one answer that of the least node counts. A circle ends with the answers, as each step takes one. Only subjects that move go on to
    the next round, so rounds are as many as the longest walk over `steps`.
    """
    of = cut(edges.where("node is not null").groupBy("tree", "node", F.coalesce("yes", F.lit(False)).alias("yes")).agg(F.min("to").alias("to")))
    moving = subjects.join(roots.groupBy("tree").agg(F.min("root").alias("node")), "tree", "left").select("subject", "tree", "node", F.lit(0).alias("steps"), F.coalesce("answers", F.array().cast("array<string>")).alias("left"), F.lit(True).alias("moves"))
    done, longest = None, None
    while True:
        for _ in range(steps):
            answer = F.when(F.col("moves") & (F.size("left") > 0), positive(F.get("left", F.lit(0))))
            ahead = moving.withColumn("__answer", answer).join(of.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("yes").alias("__y"), "to"), (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n")) & (F.col("__answer") == F.col("__y")), "left")
            went = F.col("__t").isNotNull()
            moving = ahead.select("subject", "tree", F.when(went, F.col("to")).otherwise(F.col("node")).alias("node"), (F.col("steps") + went.cast("int")).alias("steps"), F.when(went, F.slice("left", 2, F.greatest(F.size("left"), F.lit(1)))).otherwise(F.col("left")).alias("left"), went.alias("moves"))
        written = cut(moving)
        still = written.where("not moves").select("subject", "tree", "node", "steps")
        done = still if done is None else done.unionByName(still)
        longest = written.where("moves")
        if longest.isEmpty():
            break
        moving = longest
    release(of)
    return done


def circles(edges: DataFrame) -> DataFrame:
    """(tree, node): the nodes that lie on a circle or between two. Nodes without edges in, or without edges out, to nodes that are left are taken away until all have both."""
    left = cut(edges.where("node is not null and to is not null").select("tree", "node", "to").distinct())
    count = left.count()
    while count:
        kept = left.join(left.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_semi").join(left.select("tree", F.col("node").alias("to")).distinct(), ["tree", "to"], "left_semi")
        now = cut(kept.select("tree", "node", "to"))
        release(left)
        left, before, count = now, count, now.count()
        if count == before:
            break
    return left.select("tree", "node").distinct()
