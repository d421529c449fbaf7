"""Hard negatives for anchors, from exact integer inner products by Strassen's recursion.

Vectors become integers. Anchors and candidates meet in tiles: pieces of ANCHORS anchors and of some thousand candidates, each in one task. There the int64 matrices are
padded with zeros to even sides and multiplied by Strassen's seven half-size products, down to sides of LEAF; sums and differences are exact. The first round
multiplies anchors by candidates of their own label and keeps each anchor's best ones: a tile gives a heap of `positives`, heaps of one anchor are merged by rank. The second round
multiplies by all candidates and keeps, for each anchor and positive, the best ones of another label inside the positive's window of scores; its heaps are merged alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.llm.common import cut, release, small_batches

#: Sides at which matrices are multiplied directly.
LEAF = 16
#: Anchors of a tile, and candidates of a tile at most; candidates are dealt into STRIPES stripes at least, and multiplied STEP at a time.
ANCHORS, CANDIDATES, STRIPES, STEP = 1024, 32_768, 64, 1024
LEAST = np.iinfo(np.int64).min


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b of int64 matrices: in doubles where every sum is below 2^53, and so exact, else in integers."""
    if a.size and b.size and a.shape[1] * max(abs(float(a.max())), abs(float(a.min()))) * max(abs(float(b.max())), abs(float(b.min()))) < 2.0**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a b of int64 matrices of any sides, modulo 2^64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return product(a, b)
    a, b = (np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) if x.shape[0] % 2 or x.shape[1] % 2 else x for x in (a, b))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest of each row that are not LEAST; equal scores go to the smaller column. scores is used up."""
    rows, columns, values, every = [], [], [], np.arange(len(scores))
    for _ in range(k):
        at = scores.argmax(1)
        v = scores[every, at]
        there = np.flatnonzero(v > LEAST)
        if not len(there):
            break
        rows.append(there)
        columns.append(at[there])
        values.append(v[there])
        scores[there, at[there]] = LEAST
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


class Heap:
    """The k best (score, id) of each of many keys; push merges more of them."""

    def __init__(self, keys: int, k: int):
        self.k, self.keys = k, keys
        self.key, self.id, self.score = (np.zeros(0, np.int64),) * 3

    def push(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        key, ids, score = np.append(self.key, key), np.append(self.id, ids), np.append(self.score, score)
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        first = np.searchsorted(key, np.arange(self.keys))
        keep = np.arange(len(key)) - first[key] < self.k
        self.key, self.id, self.score = key[keep], ids[keep], score[keep]


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _width(*sides: pd.Series) -> int:
    return max((len(v) for s in sides for v in s), default=0)


def _positives(k: int):
    def meet(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        a, c = a.sort_values("anchor"), c.sort_values("vec_id")
        width, heap = _width(a["x"], c["v"]), Heap(len(a), k)
        left, who, ids = matrix(a["x"], width), a["anchor"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64)
        for at in range(0, len(c) if len(a) else 0, STEP):
            part = ids[at : at + STEP]
            scores = strassen(left, matrix(c["v"].iloc[at : at + STEP], width).T)
            scores[who[:, None] == part[None]] = LEAST
            row, column, score = best(scores, k)
            heap.push(row, part[column], score)
        return pd.DataFrame({"anchor_id": who[heap.key], "positive_id": heap.id, "positive_score": heap.score})

    return meet


def _negatives(k: int):
    def meet(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        a, c = a.sort_values("anchor"), c.sort_values("vec_id")
        width = _width(a["x"], c["v"])
        left, who, label, ids = matrix(a["x"], width), a["anchor"].to_numpy(np.int64), a["mine"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64)
        # a row an anchor and positive: the anchor's place and the window of its scores
        place = np.repeat(np.arange(len(a)), [len(w) for w in a["windows"]])
        positive = np.array([w["positive_id"] for own in a["windows"] for w in own], np.int64)
        top = np.array([w["positive_score"] for own in a["windows"] for w in own], np.int64)
        # 50 t <= 100 s <= 95 t: s between ceil(t / 2) and floor(19 t / 20)
        low, high = -(-top // 2), top // 20 * 19 + top % 20 * 19 // 20
        turn = np.arange(len(place)) - np.searchsorted(place, place)
        heap = Heap(len(place), k)
        for at in range(0, len(c) if len(place) else 0, STEP):
            part, theirs = ids[at : at + STEP], c["label"].to_numpy(np.int64)[at : at + STEP]
            scores = strassen(left, matrix(c["v"].iloc[at : at + STEP], width).T)
            scores[label[:, None] == theirs[None]] = LEAST
            for t in range(int(turn.max()) + 1):
                own = np.flatnonzero(turn == t)
                s = scores[place[own]]
                s[(s < low[own][:, None]) | (s > high[own][:, None])] = LEAST
                row, column, score = best(s, k)
                heap.push(own[row], part[column], score)
        return pd.DataFrame({"anchor_id": who[place[heap.key]], "positive_id": positive[heap.key], "positive_score": top[heap.key], "negative_id": heap.id, "negative_score": heap.score})

    return meet


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as integers: one row an id, that of the least label and vector."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = rows.select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def _copies(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def hard_negatives(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """df (vec_id long, label int, embedding array of numbers, others ignored) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that `anchors` marks (a condition on vec_id). Rows without an id or a label, and those whose vector is null or holds a null or non-finite component, take no
    part; of several rows of one id the one of the least label and vector does. Shorter vectors are filled up with zeros, so an empty one scores 0 with all. Scores are
    exact below 2^63. Ties go to smaller ids. An anchor without positives, a positive without negatives in its window, and an empty table give no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = cut(usable(df).withColumn("asks", F.coalesce(anchors, F.lit(False))))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    size = min(CANDIDATES, max(16, -(-n // STRIPES)))
    deal = lambda many: F.pmod(F.xxhash64("vec_id"), many).cast("int")

    # round one: within a label. Only labels of more rows than a piece holds are listed: n / size of them at most, some 64 or n / 32,768
    large = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).where((F.col("n") > size) | (F.col("asking") > ANCHORS))
    large = F.broadcast(large.select("label", F.ceil(F.col("n") / size).cast("int").alias("stripes"), F.greatest(F.lit(1), F.ceil(F.col("asking") / ANCHORS)).cast("int").alias("blocks")))
    known = rows.join(large, "label", "left").na.fill(1, ["stripes", "blocks"])
    # the two sides of a tile have names of their own, as both come from one table
    asker = [F.col("vec_id").alias("anchor"), F.col("label").alias("mine"), F.col("v").alias("x")]
    ask = known.where("asks").select(deal(F.col("blocks")).alias("at_block"), _copies(F.col("stripes")).alias("at_stripe"), *asker)
    give = known.select("label", deal(F.col("stripes")).alias("stripe"), _copies(F.col("blocks")).alias("block"), "vec_id", "v")
    found = ask.groupBy("mine", "at_block", "at_stripe").cogroup(give.groupBy("label", "block", "stripe")).applyInPandas(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    windows = found.withColumn("place", order).where(F.col("place") <= positives)
    windows = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("windows"))  # `positives` entries at most
    asked = cut(rows.where("asks").join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", "windows"))

    # round two: all candidates
    stripes, blocks = max(1, -(-n // size)), max(1, -(-asking // ANCHORS))
    ask = asked.select(deal(F.lit(blocks)).alias("at_block"), _copies(F.lit(stripes)).alias("at_stripe"), *asker, "windows")
    give = rows.select(deal(F.lit(stripes)).alias("stripe"), _copies(F.lit(blocks)).alias("block"), "vec_id", "label", "v")
    found = ask.groupBy("at_block", "at_stripe").cogroup(give.groupBy("block", "stripe")).applyInPandas(_negatives(negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = cut(found.withColumn("rank", order).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    release(rows, asked)
    return out


SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor, c.vec_id as other, a.label = c.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::bigint as score from r a join r c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor order by score desc, other) <= 5)
select p.anchor as anchor_id, p.other as positive_id, (row_number() over (partition by p.anchor, p.other order by s.score desc, s.other))::int as rank, s.other as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.anchor = s.anchor where not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score qualify rank <= 3"""
