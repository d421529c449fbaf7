"""Packing of documents into training sequences by lexical retrieval.

Every text is encoded once and its ids are written. Documents are dealt into shards of about SHARD tokens by their rarest token (vocabularies number tokens by merges,
so the largest id is the rarest), so that like texts meet; a token that many documents share is split over as many shards as it needs. What fills whole windows by
itself is cut off first. In each shard an inverted BM25 index is built over what is left of its documents; document frequencies are those of all documents. A seed asks the
index with its heaviest terms, and unused neighbours fill its window greedily, best first: those that fit stay whole, then the best that does not fit is
cut, and what is left of it is the next seed. Where no neighbour shares a term, the next unused document fills the window. So only the last window of a shard is not full; it is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import as_bytes, batch, cut, kept_for, pieces, release, small_batches
from carecolumns.llm.word_bpe import WordCodec, codec_of

WINDOW = 2048
#: Ids that end a document.
END = 1
#: Tokens of a shard, of which each document counts PER_DOCUMENT more, so that shards of short documents hold few enough of them.
SHARD, PER_DOCUMENT = 1 << 20, 512
#: A seed's terms that are looked up, and neighbours that are tried for a window.
TERMS, NEIGHBOURS = 16, 64
K1, B = 1.2, 0.75


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        end = np.array([END], codec.dtype).tobytes()
        for whole in batches:
            for b in pieces(whole, "text"):
                ids = [i + end for i in codec.encode([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])]
                rarest = np.fromiter((np.frombuffer(i, codec.dtype).max() for i in ids), np.int32, len(ids))
                yield batch(["doc_id", "n", "rarest", "ids"], b.column(0), np.fromiter(map(len, ids), np.int64, len(ids)) // codec.dtype.itemsize, rarest, pa.array(ids, pa.binary()))

    return run


def _frequencies(size: int, dtype: np.dtype):
    """Rows (term, n) of a task: in how many of its documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("lexical_packing")  # the encoder's words are needed no more
        counts, seen = np.zeros(size, np.int64), np.zeros(size, bool)
        for b in batches:
            for i in b.column(0):
                seen[np.frombuffer(i.as_buffer(), dtype)] = True
                some = np.flatnonzero(seen)
                counts[some] += 1
                seen[some] = False
        some = np.flatnonzero(counts)
        yield batch(["term", "n"], some.astype(np.int32), counts[some])

    return run


def inverse_frequency(n: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - n + 0.5) / (n + 0.5))


class Index:
    """An inverted BM25 index over the texts (arrays of ids) of a shard."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.size = len(texts)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
        key = np.repeat(np.arange(len(texts)), length) * len(idf) + flat
        # half as wide numbers are sorted in less than half the time
        key, tf = np.unique(key.astype(np.int32) if len(texts) * len(idf) < 1 << 31 else key, return_counts=True)
        text, term = np.divmod(key, len(idf))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[text] / mean))
        #: Terms by text, with their weights there.
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))
        self.term, self.weight = term, weight
        by_term = np.argsort(term, kind="stable")
        #: Postings by term: texts and weights.
        self.terms, begin = np.unique(term[by_term], return_index=True)
        self.begin = np.append(begin, len(term))
        self.texts, self.weights = text[by_term], weight[by_term]

    def asked(self, i: int) -> np.ndarray:
        """The heaviest terms of a text."""
        a, b = self.first[i], self.first[i + 1]
        terms, weight = self.term[a:b], self.weight[a:b]
        return terms[np.lexsort((terms, -weight))[:TERMS]] if b - a > TERMS else terms

    def scores(self, i: int) -> np.ndarray:
        at = np.searchsorted(self.terms, self.asked(i))
        spans = [slice(self.begin[k], self.begin[k + 1]) for k in at]
        return np.bincount(np.concatenate([self.texts[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.size)


def fill(left: np.ndarray, index: Index, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Windows of (text, tokens), in the order of filling; left: tokens of each text, all of which are placed. Only the last window may be short."""
    left, used = left.copy(), left == 0
    out, next_unused, seed = [], 0, -1
    while True:
        if seed < 0:
            while next_unused < len(left) and used[next_unused]:
                next_unused += 1
            if next_unused == len(left):
                return out
            seed = next_unused
        room, row = window - int(left[seed]), [(seed, int(left[seed]))]
        used[seed] = True
        asks, seed = seed, -1
        if room:
            score = index.scores(asks)
            score[used] = 0.0
            near = np.flatnonzero(score > 0)
            if len(near) > NEIGHBOURS:
                near = near[score[near] >= np.partition(score[near], -NEIGHBOURS)[-NEIGHBOURS]]
            near = near[np.lexsort((near, -score[near]))][:NEIGHBOURS]
            for j in near.tolist():
                if left[j] <= room:
                    row.append((j, int(left[j])))
                    used[j] = True
                    room -= int(left[j])
            behind = iter([j for j in near.tolist() if not used[j]])
            while room:
                j = next(behind, -1)
                while j < 0 and next_unused < len(left):
                    if not used[next_unused]:
                        j = next_unused
                        break
                    next_unused += 1
                if j < 0:
                    break
                n = min(room, int(left[j]))
                row.append((j, n))
                room -= n
                left[j] -= n
                used[j] = not left[j]
                if left[j]:
                    seed = j
        out.append(row)


def powers(row: list[tuple[int, int]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """A short window as windows whose lengths are powers of two, largest first."""
    total, out = sum(n for _, n in row), []
    rest = list(row)
    while total:
        room = min(window, 1 << (total.bit_length() - 1))
        total -= room
        part = []
        while room:
            j, n = rest.pop(0)
            part.append((j, min(n, room)))
            if n > room:
                rest.insert(0, (j, n - room))
            room -= part[-1][1]
        out.append(part)
    return out


def pack(texts: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, start, length, sequence, offset) of every piece of a shard."""
    sequence = 0
    tails = np.array([len(t) % window for t in texts], np.int64)
    for i, t in enumerate(texts):
        for k in range(len(t) // window):
            yield i, k * window, window, sequence, 0
            sequence += 1
    if not tails.any():
        return
    windows = fill(tails, Index([t[len(t) - n :] for t, n in zip(texts, tails.tolist(), strict=True)], idf, mean), window)
    if sum(n for _, n in windows[-1]) < window:
        windows[-1:] = powers(windows[-1], window)
    at = [len(t) - n for t, n in zip(texts, tails.tolist(), strict=True)]
    for row in windows:
        offset = 0
        for i, n in row:
            yield i, at[i], n, sequence, offset
            at[i] += n
            offset += n
        sequence += 1


def shards(costs: list[tuple[int, int]], most: int = SHARD) -> list[tuple[int, int, int]]:
    """(rarest, first shard, number of shards) for (rarest, cost) in order: cheap neighbours share a shard, what costs more than one gets several of its own."""
    out, shard, held = [], 0, 0
    for rarest, cost in costs:
        if held and held + cost > most:
            shard, held = shard + 1, 0
        many = max(1, -(-cost // most))
        out.append((rarest, shard, many))
        shard, held = (shard + many, 0) if many > 1 else (shard, held + cost)
    return out


def packed(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id long, text string, others ignored) to a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone. Rows are packed one by one, repeated ones and those without an id as well: the pieces of each cover its own tokens once.
    Texts of any length are cut into as many windows as they fill. An empty table gives an empty result. The broadcasts have at most a row for each token of the
    vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    codec = WordCodec(path)
    size, dtype = codec.size, codec.dtype
    encoded = docs.select("doc_id", as_bytes().alias("text")).mapInArrow(_encode(path), "doc_id long, n long, rarest int, ids binary")
    encoded = cut(encoded.withColumn("row", F.monotonically_increasing_id()))
    total = encoded.agg(F.count("*").alias("documents"), F.coalesce(F.avg(F.col("n") % WINDOW), F.lit(0.0)).alias("mean")).first()
    counted = encoded.select("ids").mapInArrow(_frequencies(size, dtype), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a token at most
    frequency = np.zeros(size, np.int64)
    for r in counted:
        frequency[r.term] = r.n
    sent = spark.sparkContext.broadcast((inverse_frequency(frequency, total.documents), max(total.mean, 1.0)))
    costs = encoded.groupBy("rarest").agg(F.sum(F.col("n") + PER_DOCUMENT).alias("cost")).orderBy("rarest").collect()  # a row a token at most
    dealt = F.broadcast(spark.createDataFrame(shards([(r.rarest, r.cost) for r in costs]), "rarest int, first long, many long"))

    def run(shard: pa.Table) -> pa.Table:
        kept_for("lexical_packing")
        idf, mean = sent.value
        shard = shard.sort_by("row")
        texts = [np.frombuffer(i.as_buffer(), dtype) for chunk in shard.column("ids").chunks for i in chunk]
        top = int(shard.column("shard")[0].as_py()) << 32 if len(texts) else 0
        found = list(pack(texts, idf, mean)) if texts else []
        text, start, length, sequence, offset = np.array(found, np.int64).reshape(-1, 5).T
        crc = [zlib.crc32(texts[i][a : a + n].astype("<u4")) for i, a, n in zip(text.tolist(), start.tolist(), length.tolist(), strict=True)]
        whole = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.table({"doc_id": shard.column("doc_id").combine_chunks().take(pa.array(text)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": whole[text], "sequence_id": top + sequence, "offset": offset})

    rows = encoded.join(dealt, "rarest").select("row", "doc_id", "ids", (F.col("first") + F.pmod(F.xxhash64("row"), "many")).alias("shard"))
    out = cut(rows.groupBy("shard").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
    release(encoded)
    return out
