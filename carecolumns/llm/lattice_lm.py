"""Language-model scores of whole texts: words backed off to a subword lattice.

A text is its words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) and one end. The probability of a token that training texts hold c times among N is

    P(t) = (c + alpha * P0(t)) / (N + alpha),

where P0 of a word is its marginal probability in the subword lattice: the sum over all segmentations into pieces of a public vocabulary, by a forward
recursion in log space. The vocabulary's own scores give the first weights of its pieces (score -r: weight 1 / (1 + r); byte pieces, which have no rank,
the least); expectation steps over every distinct training word adapt them, and the first weights keep a share of PRIOR. A word's first piece, its later pieces and
its stop have probabilities of their own, so P0 sums to one at most. alpha is the value on a grid that gives training words the highest
leave-one-out likelihood. All counts cover all training texts; nothing is sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import as_bytes, batch, cut, pieces, small_batches
from carecolumns.llm.words import Words

#: The end token's row in tables of words.
END = -1
#: Words with at least 1 / HEAVY of all training tokens: HEAVY of them at most (5 MB), looked up without a shuffle.
HEAVY = 200_000
#: Share of the vocabulary's own scores in the adapted piece probabilities, the same at every size of corpus.
PRIOR = 0.1
#: Expectation steps over the distinct training words.
STEPS = 3
#: Bytes of distinct words and their counts (by a rule of thumb for Python objects) that a task holds before it passes them on.
HELD = 150_000_000


class Lattice:
    """Piece probabilities and the trie that finds pieces; words are byte strings, a leading space marks their begin."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        score: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                score[piece] = max(score.get(piece, -math.inf), sp.get_score(i))
        least = min(score.values(), default=0.0)
        for k in range(256):
            score.setdefault(bytes([k]), least)
        self.pieces = sorted(score)
        weight = 1 / (1 + np.abs(np.array([score[p] for p in self.pieces])))
        self.first = np.array([p[:1] == b" " for p in self.pieces])
        for part in (self.first, ~self.first):
            weight[part] /= weight[part].sum()
        self.prior = self.p = weight
        self.stop = 0.3
        nodes, edges = {b"": 0}, {}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges[nodes[p[: k - 1]] << 8 | p[k - 1]] = nodes[p[:k]]
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(nodes), -1, np.int64)
        for k, p in enumerate(self.pieces):
            self.piece[nodes[p]] = k

    def adapt(self, expected: np.ndarray, words: float) -> None:
        """Take over expected piece counts of so many words."""
        self.p = self.prior.copy()
        for part in (self.first, ~self.first):
            total = expected[part].sum()
            self.p[part] = (1 - PRIOR) * expected[part] / total + PRIOR * self.prior[part] if total > 0 else self.prior[part]
        self.stop = (words + 1) / (expected.sum() + 3)

    def _arcs(self, text: np.ndarray) -> list[np.ndarray]:
        """For rows of equal length: by piece length, the piece that starts at each place, or -1."""
        n, length = text.shape
        flat, at, node, out = text.ravel(), np.arange(n * length), np.zeros(n * length, np.int64), []
        left = length - at % length
        for k in range(length):
            ok = left > k
            at, node, left = at[ok], node[ok], left[ok]
            if not len(at):
                break
            key = node << 8 | flat[at + k]
            to = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[to] == key
            at, node, left = at[ok], self.child[to[ok]], left[ok]
            if not len(at):
                break
            found = np.full(n * length, -1, np.int64)
            found[at] = self.piece[node]
            out.append(found.reshape(n, length))
        return out

    def run(self, words: list[bytes], expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability; adds expected piece counts where an array is given."""
        out = np.zeros(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        with np.errstate(divide="ignore"):
            log_p = np.append(np.log(self.p), -np.inf)
            log_p[:-1][~self.first] += math.log1p(-self.stop)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            length = int(size[group[0]])
            step = max(1, 60_000 // length)
            for k in range(0, len(group), step):
                some = group[k : k + step]
                text = np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8).reshape(len(some), length)
                arcs = self._arcs(text)
                logs = [log_p[a] for a in arcs]
                alpha = np.full((len(some), length + 1), -np.inf)
                alpha[:, 0] = 0
                for j in range(1, length + 1):
                    alpha[:, j] = _log_sum([alpha[:, j - n] + logs[n - 1][:, j - n] for n in range(1, min(j, len(arcs)) + 1)])
                total = alpha[:, length]
                out[some] = total + math.log(self.stop)
                if expected is None:
                    continue
                beta = np.full((len(some), length + 1), -np.inf)
                beta[:, length] = 0
                for j in range(length - 1, -1, -1):
                    beta[:, j] = _log_sum([beta[:, j + n] + logs[n - 1][:, j] for n in range(1, min(length - j, len(arcs)) + 1)])
                for n, (a, v) in enumerate(zip(arcs, logs, strict=True), 1):
                    has = a[:, : length - n + 1] >= 0
                    share = np.exp((alpha[:, : length - n + 1] + v[:, : length - n + 1] + beta[:, n:] - total[:, None])[has])
                    expected += np.bincount(a[:, : length - n + 1][has], share, len(expected))
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    x = np.stack(terms)
    most = x.max(0)
    low = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - low).sum(0)) + low


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, text) to (h, word, c): words of the partition with their counts in training texts."""
    held, words, ends, size = {}, {}, 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        h = np.fromiter(held, np.uint64, len(held)).view(np.int64)
        c = np.fromiter(held.values(), np.int64, len(held))
        w = list(words.values())
        for k in range(0, len(h), 50_000):
            yield batch(["h", "word", "c"], h[k : k + 50_000], pa.array(w[k : k + 50_000], pa.binary()), c[k : k + 50_000])

    for b in batches:
        for p in pieces(b, "text"):
            train = np.asarray(p.column(0).to_numpy(zero_copy_only=False))
            ends += int(train.sum())
            w = Words(p.column(1))
            h, at, to = np.unique(w.hash, return_index=True, return_inverse=True)
            c = np.bincount(to, train[w.doc], len(h)).astype(np.int64)
            for k, i, n in zip(h.tolist(), at.tolist(), c.tolist(), strict=True):
                if k in held:
                    held[k] += n
                else:
                    held[k], words[k] = n, w.bytes(i)
                    size += 250 + len(words[k])
            if size > HELD:
                yield from out()
                held, words, size = {}, {}, 0
    yield from out()
    yield batch(["h", "word", "c"], np.array([END], np.int64), pa.array([b""], pa.binary()), np.array([ends], np.int64))


def _expect(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice.value
        expected, n = np.zeros(len(model.pieces)), 0
        for b in batches:
            words = b.column(0).to_pylist()
            n += len(words)
            model.run(words, expected)
        at = np.flatnonzero(expected)
        yield batch(["piece", "e"], np.append(at, -1), np.append(expected[at], float(n)))

    return run


def _marginal(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(["h", "c", "lp"], b.column(0), b.column(2), lattice.value.run(b.column(1).to_pylist()))

    return run


def _score(heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, base, model = heavy.value
        names = ["row", "h", "n", "known", "base", "model"]
        for b in batches:
            for p in pieces(b, "text"):
                row, w = np.asarray(p.column(0)), Words(p.column(1))
                h, to = np.unique(w.hash, return_inverse=True)
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(hs, h), max(len(hs) - 1, 0))
                ok = hs[at] == h if len(hs) else np.zeros(len(h), bool)
                texts, token = len(row), ok[to]
                sums = [np.bincount(w.doc[token], v, texts) for v in (np.ones(int(token.sum())), base[at[to[token]]] if len(hs) else None, model[at[to[token]]] if len(hs) else None)]
                yield batch(names, row, pa.nulls(texts, pa.int64()), w.counts.astype(np.int64), sums[0].astype(np.int64), sums[1].astype(float), sums[2].astype(float))
                key = w.doc[~token] * np.int64(len(h)) + to[~token]
                pair, n = np.unique(key, return_counts=True)
                if len(pair):
                    yield batch(names, row[pair // len(h)], h[pair % len(h)], n.astype(np.int64), pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.float64()), pa.nulls(len(pair), pa.float64()))

    return run


def _log_mass(c: Column, alpha: float) -> Column:
    """Natural log of c + alpha * P0 from lp, the log of P0: nothing of it is lost where P0 itself is too small for a double."""
    return F.when(c > 0, F.log(c + alpha * F.exp("lp"))).otherwise(F.col("lp") + math.log(alpha))


def score_texts(docs: DataFrame, vocabulary: str, heavy: int = HEAVY) -> DataFrame:
    """docs (doc_id long, text string, others ignored) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts with crc32(doc_id as text) mod 7 = 2 are held out of training (a null doc_id counts as the empty text: trained). base_score is the sum
    over tokens of log10((c + 1) / (N + V + 1)). A null or empty text is its end alone. Repeated rows are counted and scored as often as they stand there.
    Words and texts of any length are scored as a whole, in log space. Other columns do not matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    texts = docs.select((~held_out).alias("train"), as_bytes().alias("text"))
    words = cut(texts.mapInArrow(_count, "h long, word binary, c long").groupBy("h").agg(F.first("word").alias("word"), F.sum("c").alias("c")))
    total, kinds, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.expr("count_if(c > 0)"), F.coalesce(F.sum(F.when(F.col("h") == END, F.col("c"))), F.lit(0))).first()

    lattice = Lattice(vocabulary)
    types = words.where(f"c > 0 and h <> {END}").select("word")
    for _ in range(STEPS):
        sent = spark.sparkContext.broadcast(lattice)
        expected = types.mapInArrow(_expect(sent), "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()  # a row a piece
        e = np.zeros(len(lattice.pieces))
        real = expected["piece"] >= 0
        e[expected["piece"][real].to_numpy(np.int64)] = expected["e"][real]
        lattice.adapt(e, float(expected["e"][~real].sum()))
    adapted = spark.sparkContext.broadcast(lattice)
    share = max(ends, 1) / max(total, max(ends, 1) + 1)  # below one also where no training text holds a word
    lp = F.when(F.col("h") == END, F.lit(math.log(share))).otherwise(F.col("lp") + math.log1p(-share))
    known = cut(words.mapInArrow(_marginal(adapted), "h long, c long, lp double").select("h", "c", lp.alias("lp")))

    grid = [max(kinds, 1) * 2.0**k for k in range(-6, 5)]
    left_out = [F.sum(F.col("c") * (_log_mass(F.col("c") - 1, a) - math.log(max(total, 1) - 1 + a))).alias(f"a{k}") for k, a in enumerate(grid)]
    held = known.where("c > 0").agg(*left_out).first()
    alpha = max(zip([v if v is not None else -math.inf for v in held], grid, strict=True))[1]

    base = F.log10((F.col("c") + 1) / F.lit(float(total + kinds + 1)))
    model = (_log_mass(F.col("c"), alpha) - math.log(total + alpha)) / math.log(10)
    priced = known.select("h", "c", base.alias("base"), model.alias("model"))
    frequent = priced.where(f"h <> {END} and c >= {max(1, math.ceil(total / heavy))}").toPandas().sort_values("h")  # `heavy` rows at most
    tables = spark.sparkContext.broadcast((frequent["h"].to_numpy(np.int64), frequent["base"].to_numpy(float), frequent["model"].to_numpy(float)))
    end = priced.where(f"h = {END}").first()
    end_base, end_model, end_known = (end.base, end.model, int(end.c > 0)) if end else (0.0, 0.0, 0)

    numbered = docs.select("doc_id", held_out.alias("held_out"), as_bytes().alias("text"), F.monotonically_increasing_id().alias("row"))
    found = cut(numbered.select("row", "text", "doc_id", "held_out").mapInArrow(_with_ids(_score(tables)), "row long, doc_id long, held_out boolean, h long, n long, known long, base double, model double"))
    rare = found.where("h is not null").select("row", "h", "n").join(priced, "h")
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.col("base")).alias("base"), (F.col("n") * F.col("model")).alias("model"))
    texts = found.where("h is null").select("row", "doc_id", "held_out", F.col("n").alias("tokens"), "known", "base", "model")
    sums = texts.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("tokens").alias("tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("model").alias("model"))
    return sums.select("doc_id", "held_out", (F.col("tokens") + 1).alias("n_tokens"), (F.col("known") + end_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.round(F.col("base") + end_base, 10).alias("base_score"), F.round(F.col("model") + end_model, 10).alias("score"))


def _with_ids(score):
    """Carry doc_id and held_out beside the rows of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held = b.column(2), b.column(3)
            rows = np.asarray(b.column(0))
            for out in score(iter([pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["row", "text"])])):
                text = out.num_rows and out.column(1).null_count == out.num_rows
                at = pa.array(np.searchsorted(rows, np.asarray(out.column(0)))) if text else None
                yield batch(["row", "doc_id", "held_out", "h", "n", "known", "base", "model"], out.column(0), ids.take(at) if text else pa.nulls(out.num_rows, pa.int64()), held.take(at) if text else pa.nulls(out.num_rows, pa.bool_()), *out.columns[1:])

    return run
