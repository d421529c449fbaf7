"""Exact n-gram Jaccard self-join as a blocked sparse product of the document by n-gram matrix with its transpose.

Rows of the matrix are classes of texts with equal shingle sets, columns are shingles. Two rows of sizes p <= q reach Jaccard 0.75 only if
p >= 0.75 q and their overlap is at least 3/7 (p + q); so two linked rows share a column among the first q - ceil(0.75 q) + 1 of either, in any
one order of all columns. Rare columns come first in the order used (by a count sketch over all documents), which keeps columns of shared
passages out of the product. The remaining product is taken column block by column block:

1. neighbours along each column give trial pairs; pairs whose parity bitmaps bound their overlap below 3/7 (p + q) go, the others' overlaps are counted
   exactly, nearest partners first, and linked rows are contracted to components;
2. columns that still meet several components are multiplied out, short ones first and long ones after another contraction; a long column is cut into blocks
   by size class and hash, and pairs of blocks are dealt as keys, so no column is one task's work. The size and bitmap bounds discard pairs before any row is
   emitted; the survivors' overlaps are counted exactly.

So no link between different components is lost, while groups of copies are never expanded into all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.llm import common
from carecolumns.llm.common import FEW_IDS, as_bytes, batch, keep_ids, kept_for, pieces, small_batches
from carecolumns.llm.components import components
from carecolumns.llm.words import mix, shingle_sets

U = np.uint64
#: Counters of the sketch of column frequencies (a bound of 8 MB on what is broadcast), and in one block of it.
SKETCH, PART = 1 << 21, 1 << 17
#: Bits of a bitmap for each shingle of a set, and its sizes in bytes.
BITS, LEAST, MOST = 2, 16, 1 << 14
#: Rows in a block of the product, and rows of columns that are multiplied many at a time.
BLOCK, SHORT = 1024, 64
#: Pairs that a task remembers to give once, and tasks over which the columns of one group are dealt.
SEEN, SHARES = 200_000, 8
#: Rows of a column beyond which it is dealt by pairs of blocks of about so many rows.
LONG = 1024


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's hashes in 2 bits a shingle (16 bytes to 16 kB, a power of two): the bits in which two bitmaps differ number at most the shingles in one set only."""
    size = LEAST
    while size < MOST and size * 8 < BITS * len(s):
        size *= 2
    return np.packbits(np.bincount((mix(s) & U(size * 8 - 1)).astype(np.int64), minlength=size * 8) & 1).tobytes()


def _fold(a: np.ndarray, size: int) -> np.ndarray:
    """Bitmap rows folded to `size` bytes. Hashes are taken modulo a power of two, so the folded rows are the bitmaps of that size."""
    while a.shape[1] > size:
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    return a


def may_link(n: np.ndarray, a: list[bytes], m: np.ndarray, b: list[bytes]) -> np.ndarray:
    """Whether size and bitmap bounds let pairs (n[i], a[i]), (m[i], b[i]) reach Jaccard 0.75."""
    ok = 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)
    size = np.fromiter((min(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    big = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    for k, g in {(int(k), int(g)) for k, g in zip(size[ok], big[ok], strict=True)}:
        at = np.flatnonzero(ok & (size == k) & (big == g))

        def rows(side: list[bytes], at: np.ndarray = at, k: int = k) -> np.ndarray:
            out = np.empty((len(at), k), np.uint8)
            wide = np.fromiter((len(side[i]) for i in at), np.int64, len(at))
            for w in set(wide.tolist()):
                some = np.flatnonzero(wide == w)
                out[some] = _fold(np.frombuffer(b"".join(side[i] for i in at[some]), np.uint8).reshape(-1, w), k)
            return out

        apart = np.bitwise_count((rows(a) ^ rows(b)).view(np.uint64)).sum(1, dtype=np.int64)
        # J >= 3/4 <=> 7 * |only one| <= (|a| + |b|)
        ok[at] = 7 * apart <= n[at] + m[at]
    return ok


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, key, bits) of each text, and at the end the partition's counters, block by block (slot, key: packed)."""
    kept_for("ngram_jaccard")
    counts = np.zeros(SKETCH, np.int64)
    names = ["doc_id", "n", "key", "bits", "slot"]
    for b in batches:
        for p in pieces(b, "text"):
            sets = shingle_sets(p.column(1))
            np.add.at(counts, (np.concatenate([*sets, np.zeros(0, U)]) & U(SKETCH - 1)).astype(np.int64), 1)
            n = len(sets)
            yield batch(names, p.column(0), np.array([len(s) for s in sets], np.int64), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(n, pa.int64()))
    for k in range(SKETCH // PART):
        part = counts[k * PART : (k + 1) * PART]
        if part.any():
            packed = zlib.compress(np.minimum(part, 2**32 - 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
            yield batch(names, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed], pa.binary()), pa.nulls(1, pa.binary()), np.array([k], np.int64))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (slot, packed) of many partitions, added up one after the other."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
            held[k] = held[k] + part if k in held else part
    for k, part in held.items():
        yield batch(["slot", "packed"], np.array([k], np.int64), pa.array([np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()], pa.binary()))


def _prefixes(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("ngram_jaccard")
        weight = order.value
        for b in batches:
            for p in pieces(b, "text"):
                ids, sizes, hashes = [], [], []
                for i, s in zip(p.column(0).to_pylist(), shingle_sets(p.column(1)), strict=True):
                    n = len(s)
                    if n:
                        keep = n - -(-75 * n // 100) + 1
                        w = weight[(s & U(SKETCH - 1)).astype(np.int64)]
                        h = s[:keep] if not w.any() else s[np.lexsort((s, w))[:keep]]
                        ids.append(i)
                        sizes.append(n)
                        hashes.append(h)
                if ids:
                    reps = [len(h) for h in hashes]
                    yield batch(["h", "doc", "n"], np.concatenate(hashes).view(np.int64), np.repeat(np.array(ids, np.int64), reps), np.repeat(np.array(sizes, np.int32), reps))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, n) sorted by h: those whose column holds another row too. The last row of a batch waits for the next."""
    held, before = None, False
    for b in batches:
        now = [np.asarray(c) for c in b.columns]
        if held is not None:
            now = [np.concatenate((x, y)) for x, y in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        same = now[0][1:] == now[0][:-1]
        keep = np.append(same, False)
        keep[1:] |= same
        keep[0] |= before
        held, before = [x[-1:] for x in now], bool(keep[-1])
        keep[-1] = False
        if keep.any():
            yield batch(["h", "doc", "n"], *(x[keep] for x in now))
    if before:
        yield batch(["h", "doc", "n"], *held)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, r, doc, n) sorted by h, r: pairs of neighbours in a column, within the size bound."""
    held = None
    for b in batches:
        h, doc, n = (np.asarray(b.column(k)) for k in (0, 2, 3))
        if held is not None:
            h, doc, n = (np.concatenate(x) for x in zip(held, (h, doc, n), strict=True))
        if not len(h):
            continue
        held = h[-1:], doc[-1:], n[-1:]
        a, c = np.minimum(doc[1:], doc[:-1]), np.maximum(doc[1:], doc[:-1])
        ok = (h[1:] == h[:-1]) & (a != c) & (100 * np.minimum(n[1:], n[:-1]).astype(np.int64) >= 75 * np.maximum(n[1:], n[:-1]).astype(np.int64))
        pairs = np.unique(np.stack((a[ok], c[ok]), 1), axis=0)
        if len(pairs):
            yield batch(["a", "b"], pairs[:, 0], pairs[:, 1])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and bitmaps: those that may link, with their distance by bitmaps."""
    for b in batches:
        if not b.num_rows:
            continue
        d = {k: b.column(b.schema.get_field_index(k)) for k in ("a", "b", "n", "m", "x", "y")}
        n, m = np.asarray(d["n"]), np.asarray(d["m"])
        ok = may_link(n, d["x"].to_pylist(), m, d["y"].to_pylist())
        if ok.any():
            yield batch(["a", "b"], np.asarray(d["a"])[ok], np.asarray(d["b"])[ok])


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, n, root, side, bits) sorted by h: in blocks of each column's rows, pairs of different components that may link.

    side tells the two blocks of a dealt pair apart (1 and 2: only pairs across), 0 stands for whole columns.
    """
    seen: set[tuple[int, int]] = set()

    def column(rows: list) -> Iterator[pa.RecordBatch]:
        doc, n, root, side = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 5))
        if len(rows) < 2 or (root == root[0]).all():
            return
        by = np.argsort(n, kind="stable")
        doc, n, root, side = doc[by], n[by], root[by], side[by]
        wide = np.fromiter((len(r[4]) for r in rows), np.int64, len(rows))[by]
        # bitmaps of each size as one matrix; a pair is compared at the smaller size of the two
        where, whole = np.zeros(len(rows), np.int64), {}
        for w in set(wide.tolist()):
            at = np.flatnonzero(wide == w)
            where[at] = np.arange(len(at))
            whole[w, w] = np.frombuffer(b"".join(rows[by[i]][4] for i in at), np.uint8).reshape(-1, w).view(U)

        def bitmaps(w: int, size: int) -> np.ndarray:
            if (w, size) not in whole:
                whole[w, size] = _fold(whole[w, w].view(np.uint8), size).view(U)
            return whole[w, size]

        found = []
        for i in range(0, len(rows), BLOCK):
            for j in range(i, len(rows), BLOCK):
                if 100 * n[min(i + BLOCK, len(rows)) - 1] < 75 * n[j]:
                    break
                across = (side[i : i + BLOCK, None] == 0) | (side[i : i + BLOCK, None] != side[None, j : j + BLOCK])
                p, q = np.nonzero(across & (root[i : i + BLOCK, None] != root[None, j : j + BLOCK]) & (100 * n[i : i + BLOCK, None] >= 75 * n[None, j : j + BLOCK]))
                p, q = p + i, q + j
                p, q = p[p < q], q[p < q]
                for a, b in set(zip(wide[p].tolist(), wide[q].tolist(), strict=True)):
                    at = np.flatnonzero((wide[p] == a) & (wide[q] == b))
                    x, y = bitmaps(a, min(a, b)), bitmaps(b, min(a, b))
                    for k in range(0, len(at), 20_000):
                        u, v = p[at[k : k + 20_000]], q[at[k : k + 20_000]]
                        apart = np.bitwise_count(x[where[u]] ^ y[where[v]]).sum(1, dtype=np.int64)
                        ok = 7 * apart <= n[u] + n[v]
                        found.append(np.stack((np.minimum(doc[u], doc[v])[ok], np.maximum(doc[u], doc[v])[ok]), 1))
        if found:
            # columns of one group follow one another: a pair that the last ones gave is not given again
            pairs = np.array([x for x in map(tuple, np.unique(np.concatenate(found), axis=0).tolist()) if x not in seen], np.int64).reshape(-1, 2)
            if len(seen) > SEEN:
                seen.clear()
            seen.update(map(tuple, pairs.tolist()))
            for k in range(0, len(pairs), 50_000):
                yield batch(["a", "b"], pairs[k : k + 50_000, 0], pairs[k : k + 50_000, 1])

    def short(h: np.ndarray, doc: np.ndarray, n: np.ndarray, root: np.ndarray, bits: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Columns of few rows, all at once: row i against i + 1, i + 2 and so on."""
        found = []
        for step in range(1, SHORT):
            i = np.flatnonzero(h[step:] == h[:-step]) if step < len(h) else []
            if not len(i):
                break
            j = i + step
            ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j]))
            found.append(np.stack((i[ok], j[ok]), 1))
        if not found or not sum(map(len, found)):
            return
        at = np.concatenate(found)
        u, v = at[:, 0], at[:, 1]
        pairs, first = np.unique(np.stack((np.minimum(doc[u], doc[v]), np.maximum(doc[u], doc[v])), 1), axis=0, return_index=True)
        u, v = u[first], v[first]
        ok = may_link(n[u], [bits[x] for x in u], n[v], [bits[x] for x in v])
        if ok.any():
            yield batch(["a", "b"], pairs[ok, 0], pairs[ok, 1])

    def rows_of(b: list) -> Iterator[pa.RecordBatch]:
        h, doc, n, root, side, bits = b
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(begin, len(h)))
        short_one = (size <= SHORT) & (np.maximum.reduceat(side, begin) == 0)
        few = np.repeat(short_one, size)
        at = np.flatnonzero(few)
        if len(at):
            yield from short(h[at], doc[at], n[at], root[at], [bits[i] for i in at])
        for k in np.flatnonzero(~short_one):
            yield from column([(h[i], doc[i], n[i], root[i], bits[i], side[i]) for i in range(begin[k], begin[k] + size[k])])

    held = None
    for b in batches:
        now = [np.asarray(b.column(k)).astype(np.int64) for k in range(5)] + [b.column(5).to_pylist()]
        if held:
            now = [np.concatenate((held[k], now[k])) for k in range(5)] + [held[5] + now[5]]
        h = now[0]
        if not len(h):
            continue
        # the last column may go on in the next batch
        other = np.flatnonzero(h != h[-1])
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield from rows_of([x[:end] for x in now])
        held = [x[end:] for x in now]
    if held:
        yield from rows_of(held)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in pieces(b, "text"):
            yield batch(["doc", "set"], p.column(0), pa.array([s.tobytes() for s in shingle_sets(p.column(1))], pa.binary()))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with both sets: the exact overlap count of each, kept where the link holds."""
    for b in batches:
        a, c = [], []
        for i, j, s, t in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("a", "b", "s", "t")), strict=True):
            s, t = np.frombuffer(s, U), np.frombuffer(t, U)
            both = np.concatenate((s, t))
            both.sort()
            overlap = int((both[1:] == both[:-1]).sum())
            if 100 * overlap >= 75 * (len(s) + len(t) - overlap):
                a.append(i)
                c.append(j)
        if a:
            yield batch(["a", "b"], np.array(a, np.int64), np.array(c, np.int64))


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda k, v: sets.select(F.col("doc").alias(k), F.col("set").alias(v))
    return pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").select("a", "b", "s", "t").mapInArrow(_overlaps, "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    if roots is None:
        return pairs
    to = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    return pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def _dealt(rows: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """Rows (h, doc, n, root, bits) of long columns, once for each pair of blocks that theirs is in: (h, doc, n, root, side, bits), sorted by h, a number of the pair.

    Rows of sizes p <= q with p >= 0.75 q are in the same or in neighbouring size classes, the powers of 4/3. sizes: (h, class, rows).
    """
    blocks = F.ceil(F.col("rows") / LONG).cast("int")
    own = sizes.select("h", "class", blocks.alias("own"))
    next_up = sizes.select("h", (F.col("class") - 1).alias("class"), blocks.alias("up"))
    next_down = sizes.select("h", (F.col("class") + 1).alias("class"), blocks.alias("down"))
    sizes = common.cut(own.join(next_up, ["h", "class"], "left").join(next_down, ["h", "class"], "left").select("h", "class", "own", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down")))
    few = sizes.count() <= FEW_IDS
    rows = rows.withColumn("class", _size_class()).join(F.broadcast(sizes) if few else sizes, ["h", "class"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("own")).cast("int"))
    pair = lambda low, i, j, side: F.struct(low.alias("low"), i.alias("i"), j.alias("j"), side.alias("side"))
    up_to = lambda m: F.when(F.col(m) > 0, F.sequence(F.lit(0), F.col(m) - 1)).otherwise(F.array().cast("array<int>"))
    block, own_class = F.col("block"), F.col("class")
    # within a class the smaller block is side 1, the larger side 2, and a block with itself is a column of its own; then the class above, then that below
    same = F.transform(up_to("own"), lambda j: pair(own_class * 2, F.least(block, j), F.greatest(block, j), F.when(j == block, 0).when(j > block, 1).otherwise(2)))
    above = F.transform(up_to("up"), lambda j: pair(own_class * 2 + 1, block, j, F.lit(1)))
    below = F.transform(up_to("down"), lambda j: pair(own_class * 2 - 1, j, block, F.lit(2)))
    dealt = rows.select("h", "doc", "n", "root", "bits", F.explode(F.concat(same, above, below)).alias("p")).select("h", "doc", "n", "root", "bits", "p.*")
    key = F.xxhash64("h", "low", "i", "j")
    dealt = dealt.withColumn("key", key).repartition(parts, "key").sortWithinPartitions("key", "h", "low", "i", "j")
    # equal numbers of two pairs would only compare more rows
    return dealt.select(F.col("key").alias("h"), "doc", "n", "root", "side", "bits")


def _size_class():
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")


def link_components(docs: DataFrame, one_task: int = 500_000) -> DataFrame:
    """docs (doc_id long, text string, others ignored) to (doc_id, n_shingles long, component_id long).

    Two texts link when 100 * intersection >= 75 * union of their sets of distinct five-word shingles (see words.py). Null and empty texts, and texts of
    white space, have size 0, link with nothing and are their own component. Repeated rows come out as often as they came in; rows of one id with different
    texts are one document with all their links, so they share a component. Rows with a null doc_id link nothing themselves and get the component of a text
    with the same set, else null. Equal sets are one class whatever their number. Texts of any length are read whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made: list[DataFrame] = []

    def cut(df: DataFrame) -> DataFrame:
        made.append(common.cut(df))
        return made[-1]

    texts = docs.select("doc_id", as_bytes().alias("text"))
    first = cut(texts.mapInArrow(_classes, "doc_id long, n long, key binary, bits binary, slot long"))
    rows = first.where("slot is null")
    weight = np.zeros(SKETCH, np.int32)
    for r in first.where("slot is not null").select("slot", "key").repartition(SKETCH // PART, "slot").mapInArrow(_summed, "slot long, packed binary").collect():  # SKETCH counters in all
        weight[r.slot * PART : (r.slot + 1) * PART] = np.frombuffer(r.packed, np.int32)
    order = spark.sparkContext.broadcast(weight)

    named = rows.where("key is not null and doc_id is not null")
    classes = cut(named.groupBy("key", "n").agg(F.min(F.struct("doc_id", "bits")).alias("one")).select("key", "n", F.col("one.doc_id").alias("doc"), F.col("one.bits").alias("bits")))
    # rows of one id are one document: they join the classes of their sets
    again = cut(named.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("rows")).where("rows > 1"))
    several = keep_ids(named.select("doc_id", "key"), cut(again.where("a <> b").select("doc_id")), "doc_id").join(classes.select("key", "doc"), "key").where("doc_id <> doc")
    several = cut(several.select(F.least("doc_id", "doc").alias("a"), F.greatest("doc_id", "doc").alias("b")).distinct())
    texts = texts.where("doc_id is not null")
    if not again.isEmpty():
        repeated = cut(again.select("doc_id"))
        texts = keep_ids(texts, repeated, "doc_id", "left_anti").unionByName(keep_ids(texts, repeated, "doc_id").distinct())
    # texts of ids that stand for no class are equal to others'
    copies = named.join(classes.select("key", "doc"), "key").where("doc_id <> doc").select("doc_id").distinct()
    copies = cut(copies.join(classes.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti"))
    own = keep_ids(texts, copies, "doc_id", "left_anti")
    postings = own.mapInArrow(_prefixes(order), "h long, doc long, n int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = cut(postings.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_shared, "h long, doc long, n int"))
    bits = classes.select("doc", "n", "bits")

    trial = shared.withColumn("r", F.xxhash64("h", "doc")).select("h", "r", "doc", "n").repartition(parts, "h").sortWithinPartitions("h", "r")
    trial = trial.mapInArrow(_neighbours, "a long, b long").distinct()
    side = lambda k, n, x: bits.select(F.col("doc").alias(k), F.col("n").alias(n), F.col("bits").alias(x))
    trial = cut(trial.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").mapInArrow(_bounded, "a long, b long"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        return cut(keep_ids(texts, cut(ends), "doc_id").mapInArrow(_sets, "doc long, set binary"))

    def joined(*links: DataFrame) -> DataFrame:
        every = several
        for x in links:
            every = every.unionByName(x)
        return cut(components(every, one_task))

    sets = sets_of(trial)
    # each row with its two partners of least hash first: enough to contract most groups
    ends = trial.unionByName(trial.select(F.col("b").alias("a"), F.col("a").alias("b")))
    few = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(1)).alias("r"), "b")).alias("x"), F.min(F.struct(F.xxhash64("b", F.lit(2)).alias("r"), "b")).alias("y"))
    few = few.select("a", F.explode(F.array("x.b", "y.b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(_exact(few, sets))
    roots = joined(links)
    more = cut(_exact(_apart(trial, roots), sets))
    links = links.unionByName(more)
    roots = joined(links)

    # what neighbours did not settle: columns that meet several components
    def multiplied(links: DataFrame, roots: DataFrame, done: list[DataFrame], long: bool) -> DataFrame:
        root = roots.select(F.col("node").alias("doc"), "root")
        here = shared.join(root, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        open_columns = here.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low < high")
        open_columns = open_columns.where(F.col("many") > LONG if long else F.col("many") <= LONG).select("h", "low")
        if long:
            open_columns = cut(open_columns)
            if open_columns.isEmpty():
                return links
        here = here.join(open_columns, "h").join(bits.select("doc", "n", "bits"), ["doc", "n"]).select("h", "doc", "n", "root", "bits", "low")
        if long:
            here = cut(here)
            sizes = here.groupBy("h", _size_class().alias("class")).agg(F.count("*").alias("rows"))
            here = _dealt(here, sizes, parts)
        else:
            here = here.withColumn("side", F.lit(0)).repartition(parts, "low", F.pmod("h", F.lit(SHARES))).sortWithinPartitions("low", "h").select("h", "doc", "n", "root", "side", "bits")
        last = here.mapInArrow(_product, "a long, b long").distinct()
        for pairs in done:
            last = last.join(pairs, ["a", "b"], "left_anti")
        last = cut(last)
        done.append(last)
        return links.unionByName(cut(_exact(last, sets_of(last))))

    done = [trial]
    links = multiplied(links, roots, done, False)
    roots = joined(links)
    longer = multiplied(links, roots, done, True)
    if longer is not links:
        roots = joined(longer)

    members = rows.select("doc_id", F.col("n").alias("n_shingles"), "key")
    # the result reads these three tables; nothing reads the others again
    common.release(*(df for df in made if df is not first and df is not classes and df is not roots))
    named = classes.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select("key", F.coalesce("root", "doc").alias("root"))
    return members.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without an id or without words are kept as they are.

    Several rows of that id stay where their texts differ; of those with the same text one does, that of the least other columns. Columns are those of docs.
    """
    marked = common.cut(link_components(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    once, again = (common.cut(marked.where(f"rows {test} 1").select("doc_id")) for test in ("=", ">"))
    out = keep_ids(docs, once, "doc_id").unionByName(docs.where("doc_id is null"))
    if again.isEmpty():
        return out
    # the least JSON tells which of them stays, whatever the types of the other columns
    slim, back = common.apart(docs, "doc_id", "text")
    if "others" not in slim.columns:
        return out.unionByName(keep_ids(docs, again, "doc_id").distinct())
    kept = keep_ids(slim, again, "doc_id").groupBy("doc_id", "text").agg(F.min_by("others", F.to_json("others")).alias("others"))
    return out.unionByName(back(kept))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) >= 5 then list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as shingles from w),
c as (select list_sort(shingles) as shingles, min(doc_id) as doc, len(any_value(shingles)) as n from s where len(shingles) > 0 group by 1),
u as (select doc, n, unnest(shingles) as x from c),
e as (
  select a.doc as a, b.doc as b from u a join u b on a.x = b.x and a.doc < b.doc and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.doc, b.doc, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
g as (select a, b from e union all select b, a from e),
r(doc, root) as (select doc, doc from c union select g.b, r.root from r join g on r.doc = g.a),
t as (select doc, min(root) as root from r group by doc)
select s.doc_id, len(s.shingles)::bigint as n_shingles, coalesce(t.root, s.doc_id) as component_id
from s left join c on c.shingles = list_sort(s.shingles) left join t on t.doc = c.doc
"""
