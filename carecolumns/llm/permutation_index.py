"""Nearest neighbours by a permutation index.

Every distinct vector is represented by the order of its ORDER nearest pivots and posted, with that order, in the inverted files of its first POSTED pivots. A
query is sent to the files of its first PROBED pivots. There the footrule distance between its order and that of every vector posted is summed, place by
place; those whose footrule saves at least REACH of what the k-th best of the file saves are reranked by the exact inner product in double precision. So the
number of candidates follows the data: few where the nearest stand out, more where all vectors are alike.

Largest inner products are nearest neighbours after one more component sqrt(longest^2 - |x|^2) is added to every candidate and 0 to every query; pivots order these
extended vectors. Orders are computed once a vector. The table is shuffled a fixed number of times, whatever its size: POSTED copies of the vectors and PROBED
of the queries meet in tiles, pieces of a file of some SPLIT vectors and some BLOCK queries, so a task holds a few MB and a file that holds a third of
all vectors is dealt over many tasks. Equal vectors are searched as one, and one query stands for all equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.llm.common import batch, cut, small_batches

#: Least and greatest number of pivots (some 2 sqrt(n) between them), fitted on a sample of PER_PIVOT vectors of least hash for each; every vector is indexed.
PIVOTS, MOST_PIVOTS, PER_PIVOT = 512, 16_384, 4
ORDER, POSTED, PROBED = 64, 8, 48
#: Candidates save at least so much of what the k-th best of a file saves.
REACH = 0.7
#: Vectors and queries in a tile.
SPLIT, BLOCK = 4096, 1024
#: Parts of a group of equal vectors whose least ids are found one by one.
PARTS = 32


def usable(c: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)


def pivots_of(sample: np.ndarray, k: int, seed: int = 9) -> np.ndarray:
    """k spread rows: each next one is drawn by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)) and near.max() > 1e-12:
        chosen.append(int(rng.choice(len(sample), p=near / near.sum())))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def orders(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each row, nearest first."""
    d = (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    m = min(m, d.shape[1])
    part = np.argpartition(d, m - 1, axis=1)[:, :m]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1).astype(np.int16)


def extended(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with one more component, queries stretched to the longest length."""
    size = np.linalg.norm(x, axis=1)
    if query:
        return np.column_stack((x * (longest / np.maximum(size, 1e-300))[:, None], np.zeros(len(x))))
    return np.column_stack((x, np.sqrt(np.maximum(longest**2 - size**2, 0))))


def footrule_saved(mine: np.ndarray, theirs: np.ndarray, pivots: int) -> np.ndarray:
    """For vectors (rows) and queries (columns): m for each pivot in both orders, less the distance of its places. The footrule is a constant less twice this."""
    m = mine.shape[1]
    place = np.full((pivots, len(theirs)), -2 * m, np.int16)
    place[theirs.T, np.arange(len(theirs))[None]] = np.arange(m, dtype=np.int16)[:, None]
    saved = np.zeros((len(mine), len(theirs)), np.int16)
    for j in range(m):
        part = place[mine[:, j]]
        part -= np.int16(j)
        np.abs(part, out=part)
        np.subtract(np.int16(m), part, out=part)
        np.maximum(part, 0, out=part)
        saved += part
    return saved


def rerank(ids: np.ndarray, low: np.ndarray, x: np.ndarray, mine: np.ndarray, asking: np.ndarray, q: np.ndarray, theirs: np.ndarray, pivots: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best candidates of one tile for each of its queries; equal scores go to the smaller `low`."""
    saved = footrule_saved(mine, theirs, pivots)
    enough = REACH * np.partition(saved, max(len(ids) - k, 0), axis=0)[max(len(ids) - k, 0)]
    candidate = saved >= np.maximum(enough, 1)[None]
    score = np.where(candidate, x @ q.T, -np.inf)
    who, what = [], []
    for i in range(len(asking)):
        some = np.flatnonzero(candidate[:, i])
        if len(some) > k:
            s = score[some, i]
            # all that tie with the k-th but for rounding are looked at
            some = some[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * max(1.0, float(np.abs(s).max()))]
        exact = np.einsum("ij,j->i", x[some], q[i])
        best = some[np.lexsort((low[some], -exact))[:k]]
        who.append(np.full(len(best), i))
        what.append(best)
    i, j = np.concatenate(who), np.concatenate(what)
    return asking[i], ids[j], np.einsum("ij,ij->i", x[j], q[i])


def _posted(sent, query: bool):
    """(class, low, v) to a row for each file that a vector is posted in, or a query is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, longest = sent.value
        many = PROBED if query else POSTED
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                x = np.asarray(p.column(2).flatten(), float).reshape(p.num_rows, -1)
                own = orders(extended(x, longest, query), pivots, ORDER)
                files = own[:, :many]
                row = np.repeat(np.arange(p.num_rows), files.shape[1])
                v, o = pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in own], pa.binary())
                yield batch(["file", "class", "low", "v", "order"], files.ravel().astype(np.int32), p.column(0).take(pa.array(row)), p.column(1).take(pa.array(row)), v.take(pa.array(row)), o.take(pa.array(row)))

    return run


def _least_ids(named: DataFrame, k: int) -> DataFrame:
    """(class, ids): the k least ids of each class of several rows, found part by part so that no large class is in one task."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))
    first = named.where("n > 1").select("class", "vec_id", part.alias("part"))
    for keys in (("class", "part"), ("class",)):
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("rank") <= k).drop("rank")
    return first.groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k ids at most


def nearest(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """vectors (vec_id long, embedding array of numbers, others ignored) to query_id, rank, vec_id, score: the k nearest found of each row that `queries` marks.

    Vectors that are null, zero or hold a null or non-finite component, and rows without an id, take no part; neither do vectors of another length than the most
    frequent one. Ties go to smaller ids. Repeated rows are candidates of their own (but none with the query's own id); a repeated query is asked once, with
    its least vector. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"), F.count_if("asks").alias("asks")).orderBy(F.desc("n"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes or not sizes[0].asks:
        return spark.createDataFrame([], schema)
    size, n, longest = sizes[0]["size"], sizes[0].n, sizes[0].longest
    rows = rows.where(F.size("v") == size)

    groups = rows.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = cut(groups.select(F.monotonically_increasing_id().alias("class"), "low", "n", "v"))
    named = cut(rows.join(classes, "v").select("vec_id", "class", "n", "asks"))
    wanted = min(MOST_PIVOTS, max(PIVOTS, 2 ** round(np.log2(2 * n**0.5))))
    sample = classes.orderBy(F.xxhash64("low"), "low", "v").limit(PER_PIVOT * wanted).select("v").collect()  # PER_PIVOT * MOST_PIVOTS rows at most
    pivots = pivots_of(extended(np.array([r.v for r in sample]), longest, False), wanted)
    sent = spark.sparkContext.broadcast((pivots, longest))

    form = "file int, class long, low long, v binary, `order` binary"
    posts = cut(classes.select("class", "low", "v").mapInArrow(_posted(sent, False), form))
    asking = named.where("asks").select("class").distinct()
    probes = cut(classes.join(asking, "class", "left_semi").select("class", "low", "v").mapInArrow(_posted(sent, True), form))
    counts = {f: (0, 0) for f in range(len(pivots))}
    for side, df in enumerate((posts, probes)):
        for r in df.groupBy("file").count().collect():  # a row a pivot
            counts[r.file] = (r["count"], counts[r.file][1]) if side == 0 else (counts[r.file][0], r["count"])
    tiles = F.broadcast(spark.createDataFrame([(f, max(1, -(-a // SPLIT)), max(1, -(-b // BLOCK))) for f, (a, b) in counts.items()], "file int, splits int, blocks int"))
    deal = lambda c, m: F.pmod(F.xxhash64("class"), F.col(m)).cast("int").alias(c)
    copies = lambda c, m: F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(c)
    posts = posts.join(tiles, "file").select("file", deal("split", "splits"), copies("block", "blocks"), "class", "low", "v", "order")
    probes = probes.join(tiles, "file").select("file", deal("block", "blocks"), copies("split", "splits"), "class", "v", "order")
    number, found = len(pivots), "query long, class long, score double"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "class": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        floats = lambda c: np.frombuffer(b"".join(c), float).reshape(len(c), -1)
        places = lambda c: np.frombuffer(b"".join(c), np.int16).reshape(len(c), -1)
        got = rerank(a["class"].to_numpy(), a["low"].to_numpy(), floats(a["v"]), places(a["order"]), b["class"].to_numpy(), floats(b["v"]), places(b["order"]), number, k + 1)
        return pd.DataFrame(dict(zip(("query", "class", "score"), got, strict=True)))

    tile = ("file", "split", "block")
    hits = posts.groupBy(*tile).cogroup(probes.groupBy(*tile)).applyInPandas(meet, found).groupBy("query", "class").agg(F.max("score").alias("score"))
    hits = hits.join(classes.select("class", "low"), "class")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # from classes back to rows: k + 1 ids of a class are enough, as one of them may be the query's own
    hits = hits.join(_least_ids(named, k + 1), "class", "left").withColumn("ids", F.coalesce("ids", F.array("low")))
    hits = hits.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))  # k + 1 classes at most
    ask = named.where("asks").groupBy("vec_id").agg(F.min("class").alias("query"))
    every = ask.join(hits, "query").select(F.col("vec_id").alias("query_id"), F.explode("hits").alias("hit"))
    every = every.select("query_id", "hit.score", F.explode("hit.ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
