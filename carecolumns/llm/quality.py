"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier over character and word statistics of the whole text, fitted on labelled documents, gives each document's evidence: its log odds less the log
odds of the training prior. Priors come from the site: grouped sums of the classifier's probabilities by host (`source`) and by path below it (`lang`). A host's
posterior share of good documents is shrunk toward the global one, a path's toward its host's, by as many pseudo-documents as the method of
moments finds between hosts (paths), so that sparse sites keep their parent's prior. A document's final probability joins evidence and its path's posterior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import apart, FEW_IDS, arrow_offsets, as_bytes, batch, cut, keep_ids, kept_for, pieces, small_batches
from carecolumns.llm.words import Words

#: Labelled documents that the classifier is fitted on: those of least hash, if there are more. Host and path posteriors use every document.
SAMPLE = 20_000
RIDGE = 1e-2
#: Evidence of one document counts at most so much, in nats.
MOST = 12.0
NAMES = ("log_words", "capitals", "digits", "symbols", "bars", "other", "white", "word_length", "repeats", "distinct", "stretched")

_KIND = np.full(256, 4, np.uint8)  # symbols
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 10, 11, 12, 13]] = 3
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 5
_KIND[ord("|")] = 6


def measures(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text. Capitals beyond ASCII are told by their UTF-8 lead byte and its follower."""
    offsets = arrow_offsets(texts)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(texts)
    kind = _KIND[raw]
    upper = kind == 1
    if len(raw) > 1:
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] < 0x9F)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    size = np.maximum(offsets[1:] - offsets[:-1], 1).astype(float)
    w = Words(texts)
    count = np.maximum(w.counts, 1).astype(float)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    length = (w.end - w.start).astype(float)
    return np.stack([
        np.log1p(w.counts), per_text(upper) / size, per_text(kind == 2) / size, per_text(kind == 4) / count, per_text(kind == 6) / count, per_text(kind == 5) / count, per_text(kind == 3) / count,
        np.bincount(w.doc, length, n) / count, np.bincount(w.doc, same, n) / count, np.bincount(w.doc[order], new, n) / count**0.9, np.bincount(w.doc, length > 18, n) / count,
    ], 1)


class Classifier:
    """Logistic regression over standardised measures and their squares, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z, self.w = self._design(x), None
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = z.T @ (z * (p * (1 - p))[:, None]) + RIDGE * len(y) * np.eye(len(w)) * 0.01 + RIDGE * np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (y - p) - (RIDGE * len(y) * 0.01 + RIDGE) * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.w, share = w, np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, np.minimum(z * z, 16)), 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -MOST, MOST)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_for("quality")
    for b in batches:
        for p in pieces(b, "text"):
            yield batch(["doc_id", "x"], p.column(0), pa.array(list(measures(p.column(1))), pa.list_(pa.float64())))


def _judged(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("quality")
        for b in batches:
            for p in pieces(b, "text"):
                odds = model.value.log_odds(measures(p.column(p.schema.get_field_index("text"))))
                rest = [p.column(k) for k, name in enumerate(p.schema.names) if name != "text"]
                yield batch([n for n in p.schema.names if n != "text"] + ["odds"], *rest, odds)

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """The classifier of labels (doc_id, quality 0 or 1), or None if they have not both kinds. Of conflicting labels of an id 1 counts; of several rows of an id
    one does, that of the least measures."""
    few = cut(labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    got = keep_ids(docs.select("doc_id", as_bytes().alias("text")), few.select("doc_id"), "doc_id").mapInArrow(_measured, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).join(few, "doc_id").orderBy("doc_id").select("x", "quality").toPandas()  # `sample` rows
    y = got["quality"].to_numpy(float)
    return Classifier(np.stack(got["x"].to_list()), y) if 0 < y.sum() < len(y) else None


def _shrunk(groups: DataFrame) -> float:
    """Pseudo-documents of a prior over groups (n, good, parent share `prior`), by the method of moments: within-group over between-group variance."""
    p, prior = F.col("good") / F.col("n"), F.col("prior")
    row = groups.where("n >= 2").agg(F.count("*"), F.sum(F.col("n")), F.sum(F.col("n") * (p - prior) ** 2), F.sum(prior * (1 - prior)), F.sum(F.col("n") * prior * (1 - prior))).first()
    k, n, apart, within, spread = row
    if not k or not n or not spread:
        return 10.0
    between = max((apart - within) / n, 1e-6)
    return float(min(max(spread / n / between, 1.0), 1e4))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, source, lang, others ignored) to doc_id, source, lang, evidence, global_share, host_share, path_share, quality, keep.

    Null and empty texts are judged by their (empty) statistics, long ones as a whole; null hosts and paths are groups of their own. Without labels of both kinds
    there is no evidence, and everything is kept. Rows come out one by one, repeated ones and those without an id as well. An empty table gives an empty result.
    """
    return _judged_rows(docs.withColumn("mark", F.lit(0).cast("long")), labels, threshold, sample).drop("mark")


def _judged_rows(docs: DataFrame, labels: DataFrame, threshold: float, sample: int) -> DataFrame:
    """judge() with the column `mark` carried along."""
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(docs, labels, sample)
    slim = docs.select("doc_id", "source", "lang", "mark", as_bytes().alias("text"))
    if model is None:
        found = slim.select("doc_id", "source", "lang", "mark", F.lit(0.0).alias("evidence"), F.lit(1.0).alias("p"))
    else:
        sent = spark.sparkContext.broadcast(model)
        found = slim.mapInArrow(_judged(sent), "doc_id long, source string, lang string, mark long, odds double")
        found = found.select("doc_id", "source", "lang", "mark", (F.col("odds") - model.prior).alias("evidence"), (1 / (1 + F.exp(-F.col("odds")))).alias("p"))
    found = cut(found)
    paths = cut(found.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    all_n, all_good = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0.0))).first()
    share = (all_good + 1) / (all_n + 2)
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(share))
    m = _shrunk(hosts)
    hosts = hosts.select(F.col("source").alias("_h"), ((F.col("good") + m * share) / (F.col("n") + m)).alias("host_share"))
    sites = paths.join(hosts, F.col("source").eqNullSafe(F.col("_h"))).withColumn("prior", F.col("host_share"))
    m = _shrunk(sites)
    sites = cut(sites.select(F.col("source").alias("_h"), F.col("lang").alias("_p"), "host_share", ((F.col("good") + m * F.col("host_share")) / (F.col("n") + m)).alias("path_share")))
    # sites are few beside documents, but nothing bounds them: broadcast behind a count only
    few = sites.count() <= 100_000
    joined = found.join(F.broadcast(sites) if few else sites, F.col("source").eqNullSafe(F.col("_h")) & F.col("lang").eqNullSafe(F.col("_p")))
    q: Column = 1 / (1 + F.exp(-F.col("evidence") - F.log(F.col("path_share") / (1 - F.col("path_share")))))
    out = joined.select("doc_id", "source", "lang", "mark", "evidence", F.lit(share).alias("global_share"), "host_share", "path_share", q.alias("quality"))
    return out.withColumn("keep", (F.col("quality") >= threshold) | F.lit(model is None))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns; rows without an id are kept.

    Rows of one id are judged one by one: of those that differ in text, source or language some may go and others stay. Empty tables stay empty. Other columns, of any name and type, are carried along.
    """
    slim, back = apart(docs, "doc_id", "text", "source", "lang")
    mark = F.xxhash64("text", "source", "lang")
    judged = _judged_rows(slim.drop("others").where("doc_id is not null").withColumn("mark", mark), labels, threshold, SAMPLE)
    out = cut(judged.where("not keep").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    few = out.count() <= FEW_IDS
    return back(slim.join(F.broadcast(out) if few else out, (F.col("doc_id") == F.col("_id")) & (mark == F.col("_mark")), "left_anti"))
