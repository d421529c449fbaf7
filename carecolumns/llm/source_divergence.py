"""How far the sources of a language drift apart in their words: exact divergences between sources, and the terms that mark each source.

Terms are runs of letters. First every text gives its distinct terms, summed to document frequencies by language; terms in LEAST documents at least are kept. The
kept terms, in byte order, are built into minimal acyclic transducers by ranges, whose ordinals are places in the language's sorted list. Then all texts are streamed
through their language's transducers and counted again by ordinal. Counts become integer probabilities, and all later sums, ranks and ties are of integers: ordinals stand for terms
until the last step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.llm.common import arrow_offsets, as_bytes, batch, cut, pieces, release, small_batches
from carecolumns.llm.transducer import Transducer

#: Documents of its language that a kept term occurs in, at least.
LEAST = 10
#: Kept terms in a transducer, and bytes of all transducers up to which every Python worker gets them; beyond it the terms of the texts are joined by a shuffle.
RANGE, SENT_BYTES = 200_000, 48_000_000
#: Entries that a task holds before it hands them on.
HELD = 200_000
#: Terms and sources in a tile of the pairwise sums.
TILE_TERMS, TILE_SOURCES = 4096, 64
SCALE = 1_000_000_000
_terms = re.compile(rb"[a-z\x80-\xff]+").findall
_IN_TERM = np.zeros(257, bool)
_IN_TERM[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, term, n): in how many documents of the task a term occurs; handed on whenever many are held."""
    held: dict[str, dict[bytes, int]] = {}

    def flush():
        for lang, counts in held.items():
            terms = list(counts)
            for k in range(0, len(terms), 50_000):
                some = terms[k : k + 50_000]
                yield batch(["lang", "term", "n"], pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), np.array([counts[t] for t in some], np.int64))
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            counts = held.setdefault(lang, {})
            for t in set(_terms(text.as_py().lower())):
                counts[t] = counts.get(t, 0) + 1
            if sum(map(len, held.values())) > HELD:
                yield from flush()
    yield from flush()


def term_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, begin, end, text) of every term of a column of texts."""
    offsets = arrow_offsets(texts)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _IN_TERM[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = inside[:n].copy(), inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] | first[1:n]
    ends &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return _LOWER[raw], begin, end, np.searchsorted(offsets, begin, "right") - 1


def _recount(sent):
    """(lang, source, text) to (lang, source, ordinal, n) by the language's transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {lang: [(first, Transducer.load(raw)) for first, raw in own] for lang, own in sent.value.items()}
        held: dict[tuple[str, str], dict[int, int]] = {}
        kept = 0

        def flush():
            for (lang, source), counts in held.items():
                n = len(counts)
                yield batch(["lang", "source", "ordinal", "n"], pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), np.fromiter(counts.keys(), np.int64, n), np.fromiter(counts.values(), np.int64, n))
            held.clear()

        for whole in batches:
            for b in pieces(whole, "text"):
                data, begin, end, text = term_places(b.column(2))
                langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
                groups = {g: k for k, g in enumerate(dict.fromkeys(zip(langs, sources, strict=True)))}
                group = np.array([groups[g] for g in zip(langs, sources, strict=True)], np.int64)[text]
                for lang in dict.fromkeys(langs):
                    mine = np.flatnonzero(np.array([x == lang for x in langs])[text])
                    ordinal = np.full(len(mine), -1, np.int64)
                    for first, t in automata.get(lang, ()):  # a term is in one of the ranges at most
                        got = t.ordinals(data, begin[mine], end[mine])
                        ordinal = np.where(got >= 0, got + first, ordinal)
                    there = np.flatnonzero(ordinal >= 0)
                    if not len(there):
                        continue
                    each, n = _pairs(group[mine[there]], ordinal[there])
                    names = list(groups)
                    for g in np.unique(each[0]).tolist():
                        at = each[0] == g
                        counts = held.setdefault(names[g], {})
                        kept -= len(counts)
                        for o, m in zip(each[1][at].tolist(), n[at].tolist(), strict=True):
                            counts[o] = counts.get(o, 0) + m
                        kept += len(counts)
                if kept > HELD:
                    yield from flush()
                    kept = 0
        yield from flush()

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct pairs of two columns of numbers from 0, and how often each occurs."""
    size = int(b.max()) + 1
    key, n = np.unique(a * size + b, return_counts=True)
    return (key // size, key % size), n


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n), for vocabularies that are too large to be sent."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}

    def flush():
        for (lang, source), counts in held.items():
            n = len(counts)
            yield batch(["lang", "source", "term", "n"], pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), np.fromiter(counts.values(), np.int64, n))
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            counts = held.setdefault((lang, source), {})
            for t in _terms(text.as_py().lower()):
                counts[t] = counts.get(t, 0) + 1
            if sum(map(len, held.values())) > HELD:
                yield from flush()
    yield from flush()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, part) in order to a row a language and range: (lang, part, terms, automaton)."""
    rows = ((lang, part, term) for b in batches for lang, term, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    row = next(rows, None)
    while row is not None:
        lang, part = row[:2]

        def own():
            nonlocal row
            while row is not None and row[:2] == (lang, part):
                yield row[2]
                row = next(rows, None)

        t = Transducer.build(own())
        yield batch(["lang", "part", "terms", "automaton"], pa.array([lang], pa.string()), np.array([part], np.int32), np.array([t.size], np.int64), pa.array([t.save()], pa.binary()))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of integers up to 1,000,000,001 each."""
    return (p - q) * (p - q) // (p + q)


def _tile(terms: int):
    """Sums over one range of `terms` terms for all pairs of sources, of which one is in block i and the other in block j."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, i, j = key
        there = rows["ordinal"].isna()
        sources = rows[there].sort_values("source")
        names, width = sources["source"].tolist(), int(sources["width"].iloc[0])
        p = np.repeat(sources["p"].to_numpy(np.int64)[:, None], width, axis=1)
        counted, place = rows[~there], {s: k for k, s in enumerate(names)}
        if width and len(counted):
            p[counted["source"].map(place).to_numpy(np.int64), counted["ordinal"].to_numpy(np.int64) % terms] = counted["p"].to_numpy(np.int64)
        block = sources["block"].to_numpy()
        a, b, value = [], [], []
        for k in range(len(names)):
            others = np.arange(k + 1, len(names))
            if i != j:
                others = others[block[k + 1 :] != block[k]]
            for at in range(0, len(others), 16):
                some = others[at : at + 16]
                value += divergence(p[k][None], p[some]).sum(1).tolist()
                a += [names[k]] * len(some)
                b += [names[x] for x in some]
        return pd.DataFrame({"lang": pd.Series([lang] * len(a), dtype=object), "a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "value": np.array(value, np.int64)})

    return run


#: p of a count among `n_all` counts of `v` kept terms, exact for counts of any size.
_P = f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({{count}} + 2 as decimal(20,0))) div cast({{total}} + 2 * v as decimal(21,0)) as bigint)"


def audit(docs: DataFrame, least: int = LEAST, top: int = 10, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """docs (text, lang, source, others ignored) to lang, source, part, item, value, rank: `pair` with every other source of the language, `term` with the `top` terms
    that mark a source most.

    Null text, lang and source are ''. A source of one language has a row for each other source, also where no term is kept (value 0) or none is its own. Rows count as
    often as they stand in the table. Equal values are ordered by the item's bytes. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), as_bytes().alias("text"))
    frequencies = docs.select("lang", "text").mapInArrow(_document_frequencies, "lang string, term binary, n long")
    kept = cut(frequencies.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"))
    parts = max(1, -(-kept.count() // RANGE))
    ordered = cut(kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").withColumn("part", F.spark_partition_id()))
    release(kept)
    ranges = cut(ordered.repartition(parts, "part").sortWithinPartitions("part", "lang", "term").mapInArrow(_ranges, "lang string, part int, terms long, automaton binary"))
    # a row a range and language; places in the language's list go on from range to range
    before = F.coalesce(F.sum("terms").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    firsts = ranges.select("lang", "part", before)
    inside = F.row_number().over(Window.partitionBy("lang", "part").orderBy("term")) - 1
    vocabulary = cut(ordered.select("lang", "term", "part", inside.alias("place")).join(firsts, ["lang", "part"]).select("lang", (F.col("first") + F.col("place")).alias("ordinal"), "term"))
    release(ordered)

    if ranges.agg(F.coalesce(F.sum(F.length("automaton")), F.lit(0))).first()[0] <= sent_bytes:
        automata: dict[str, list] = {}
        for r in ranges.select("lang", before, "automaton").collect():  # sent_bytes at most
            automata.setdefault(r.lang, []).append((r.first, bytes(r.automaton)))
        counts = docs.mapInArrow(_recount(spark.sparkContext.broadcast(automata)), "lang string, source string, ordinal long, n long")
    else:
        counts = docs.mapInArrow(_joined, "lang string, source string, term binary, n long").join(vocabulary, ["lang", "term"])
    counts = cut(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))
    release(ranges)

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = cut(groups)
    p_of = lambda count, total: F.when(F.col("v") > 0, F.expr(_P.format(count=count, total=total))).otherwise(1)
    counted = counts.join(groups, ["lang", "source"]).select("lang", "source", "ordinal", p_of("n", "total").alias("p"))

    # terms that a source has more often than its language
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v")), "lang")
    marks = counted.join(whole.select("lang", "ordinal", p_of("n", "total").alias("q")), ["lang", "ordinal"]).where("p > q")
    marks = marks.select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))
    marks = marks.withColumn("rank", rank).where(F.col("rank") <= top).join(vocabulary, ["lang", "ordinal"])
    marks = marks.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    # sums over all kept terms for pairs of sources, by tiles of terms and blocks of sources
    blocks = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    tiled = groups.join(blocks, "lang").select("lang", "source", "v", p_of("0", "total").alias("p"), F.ceil(F.col("sources") / TILE_SOURCES).cast("int").alias("blocks"))
    tiled = tiled.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    there = tiled.select("lang", "source", "block", "blocks", "p", "v", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("v") - 1) / TILE_TERMS)))).alias("tile"))
    there = there.select("lang", "source", "block", "blocks", "tile", F.lit(None).cast("long").alias("ordinal"), "p", F.least(F.lit(TILE_TERMS), F.col("v") - F.col("tile") * TILE_TERMS).cast("int").alias("width"))
    rows = counted.join(tiled.select("lang", "source", "block", "blocks"), ["lang", "source"]).select("lang", "source", "block", "blocks", F.floor(F.col("ordinal") / TILE_TERMS).alias("tile"), "ordinal", "p", F.lit(None).cast("int").alias("width"))
    every = there.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.select("lang", "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "source", "block", "ordinal", "p", "width")
    sums = every.groupBy("lang", "tile", "i", "j").applyInPandas(_tile(TILE_TERMS), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    pair_rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", pair_rank.alias("rank"))
    return pairs.unionByName(marks)


def sql(least: int = LEAST, top: int = 10) -> str:
    return rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
w as (select id, lang, source, unnest(terms) as term from d),
k as (select lang, term from w group by 1, 2 having count(distinct id) >= {least}),
v as (select lang, count(*) as v from k group by 1),
g as (select lang, source from d group by 1, 2),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
gt as (select g.lang, g.source, coalesce(v.v, 0) as v, coalesce(sum(c.n), 0) as total from g left join v using (lang) left join c on c.lang = g.lang and c.source = g.source group by 1, 2, 3),
p as (select gt.lang, gt.source, k.term, coalesce(c.n, 0) as n, (1 + {SCALE}::hugeint * (coalesce(c.n, 0) + 2) // (gt.total + 2 * gt.v))::bigint as p from gt join k using (lang) left join c on c.lang = gt.lang and c.source = gt.source and c.term = k.term),
lt as (select lang, sum(total) as total, any_value(v) as v from gt group by 1),
q as (select c.lang, c.term, (1 + {SCALE}::hugeint * (sum(c.n) + 2) // (any_value(lt.total) + 2 * any_value(lt.v)))::bigint as q from c join lt using (lang) group by 1, 2),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
m as (select p.lang, p.source, p.term as item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::bigint as value from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from m) where rank <= {top}"""
