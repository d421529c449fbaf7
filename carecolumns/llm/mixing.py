"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Sources share 1.5 times all words by weight; a source takes at most 2 times its own words, and what it cannot take is reshared by weight. With r = target /
words of its source, a document gets floor(r) certain whole copies. One more copy goes to the documents first in the order of

    Q = (U / (1 - U)) / (p / (1 - p)),

random odds over inclusion odds, up to the source's remaining words. The inclusion odds of a document are f / (1 - f) * sqrt(size / mean size) with
f = r - floor(r): fuller documents come first more often. U is a hash of doc_id, so reruns agree.

No source is sorted as a whole: words are summed by source and BINS bins of Q first, and only documents of the bin in which the words run out are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecolumns.llm.common import apart, cut

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES, BINS = 1.5, 2.0, 4096
#: Equal rows that one task deals out at a time.
BLOCK = 10_000
#: Hexadecimal digits of the hash that make U.
DIGITS = 12


def targets(sizes: DataFrame) -> DataFrame:
    """(source, words, docs), one row a source, to these with `target`.

    Ordered by words / weight, sources reach their cap in that order as the level rises. With the first k at their cap the others get level_k * weight;
    k is the first for which no other is above its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    by_level = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("weight", weight)
    left = F.lit(SHARE) * F.sum("words").over(all_rows) - F.lit(MOST_COPIES) * F.coalesce(F.sum("words").over(before), F.lit(0))
    weights = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("level", left / weights)
    # this row is below its cap if its share at this level is
    out = out.withColumn("free", F.col("level") * F.col("weight") <= F.lit(MOST_COPIES) * F.col("words"))
    # the first such row in order: levels of later rows take sources for full that are not
    first = F.min(F.when(F.col("free") & (F.col("words") > 0), F.struct("place", "level"))).over(all_rows)
    out = out.withColumn("place", F.row_number().over(by_level)).withColumn("final", first["level"])
    target = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.least(F.lit(MOST_COPIES) * F.col("words"), F.coalesce(F.col("final") * F.col("weight"), F.lit(MOST_COPIES) * F.col("words"))))
    return out.select("source", "words", "docs", target.alias("target"))


def _taken(docs: DataFrame) -> DataFrame:
    """docs with _size, _words (of the source), _target and _copies."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")).cast("binary")), 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))
    rows = docs.withColumns({"_size": size, "_u": u})
    slim = cut(rows.select("source", "_size", "_u", "doc_id"))
    whole = targets(slim.groupBy("source").agg(F.sum("_size").alias("words"), F.count("*").alias("docs")))
    whole = cut(whole.withColumns({"sure": F.floor(F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0))}))
    #: sources are few beside documents, but nothing bounds them: broadcast behind a count only
    few = whole.count() <= 100_000
    site = whole.select(F.col("source").alias("_s"), F.col("words").alias("_words"), F.col("target").alias("_target"), F.col("sure").alias("_sure"), (F.col("target") - F.col("sure") * F.col("words")).alias("_need"), (F.col("words") / F.col("docs")).alias("_mean"))

    def by_source(df: DataFrame, other: DataFrame, name: str, how: str = "inner", *also: Column) -> DataFrame:
        on = F.col("source").eqNullSafe(F.col(name))
        for c in also:
            on = on & c
        return df.join(F.broadcast(other) if few else other, on, how)

    def ordered(df: DataFrame) -> DataFrame:
        f = F.col("_need") / F.col("_words")
        odds = f / (1 - f) * F.sqrt(F.col("_size") / F.col("_mean"))
        q = F.when((F.col("_size") > 0) & (F.col("_need") > 0) & (f < 1), F.col("_u") / (1 - F.col("_u")) / odds)
        return by_source(df, site, "_s").drop("_s").withColumns({"_q": q}).withColumns({"_bin": F.floor(F.col("_q") / (1 + F.col("_q")) * BINS)})

    keyed = ordered(slim)
    bins = keyed.where("_q is not null").groupBy("source", "_bin").agg(F.sum("_size").alias("words"), F.first("_need").alias("need"))
    so_far = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    edge = cut(bins.where("before < need and before + words >= need").select(F.col("source").alias("_es"), F.col("_bin").alias("_eb"), F.col("need").alias("_en"), "before"))
    inside = by_source(keyed, edge, "_es", "inner", F.col("_bin") == F.col("_eb"))
    # repeated rows tie: they are counted before they are ranked, and as many of them are taken as fit
    inside = inside.groupBy("source", "_q", "doc_id", "_size").agg(F.count("*").alias("_m"), F.first("_en").alias("_en"), F.first("before").alias("before"))
    to_here = Window.partitionBy("source").orderBy("_q", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_so_far", F.col("before") + F.coalesce(F.sum(F.col("_size") * F.col("_m")).over(to_here), F.lit(0)))
    # a document goes in if that brings the source nearer to its words
    fits = lambda n: F.col("_so_far") + (n - 1) * F.col("_size") + F.col("_size") / 2 <= F.col("_en")
    n = F.floor((F.col("_en") - F.col("_so_far")) / F.col("_size") + 0.5)
    inside = inside.withColumn("_n", F.greatest(F.lit(0), F.least(F.col("_m"), F.when(~fits(n), n - 1).when(fits(n + 1), n + 1).otherwise(n))))
    key = F.struct("_q", "doc_id", F.col("_size").alias("size"))
    last = inside.where("_n > 0").groupBy("source").agg(F.max(F.struct(key.alias("key"), F.col("_n").alias("n"), F.col("_m").alias("m"))).alias("x"))
    last = cut(last.select(F.col("source").alias("_ls"), F.col("x.key").alias("_last"), F.col("x.n").alias("_n"), F.col("x.m").alias("_m")))
    full = by_source(by_source(ordered(rows), edge.select("_es", "_eb"), "_es", "left"), last, "_ls", "left")
    at_edge = F.col("_bin") == F.col("_eb")
    tied = F.coalesce(at_edge & (key == F.col("_last")) & (F.col("_n") < F.col("_m")), F.lit(False))
    more = F.coalesce((F.col("_bin") < F.col("_eb")) | (at_edge & (key <= F.col("_last"))), F.lit(False)).cast("int")
    count = F.when(F.col("_size") > 0, F.col("_sure") + F.when(F.col("_need") > 0, F.col("_more")).otherwise(0)).otherwise(0).cast("int")
    new = ["_size", "_words", "_target"]
    if last.where("_n < _m").isEmpty():
        return full.withColumn("_more", more).select(*docs.columns, *new, count.alias("_copies"))
    apart = full.where(~tied).withColumn("_more", more).select(*docs.columns, *new, count.alias("_copies"))
    # of equal rows it does not matter which are taken: they are counted, ranked by a hash where they differ in other columns, and dealt out again in blocks
    # rows are told apart by their JSON, whatever the types of their other columns
    rest = [c for c in full.columns if c not in ("_es", "_eb", "_ls", "_last", "_u", "_m", *docs.columns)]
    row = F.struct(*docs.columns)
    equal = full.where(tied).withColumn("_json", F.to_json(row)).groupBy("_json", *rest).agg(F.count("*").alias("_m"), F.any_value(row).alias("_row"))
    up_to = Window.partitionBy("_row.source").orderBy("_tie", "_json").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("_tie", F.xxhash64("_json")).withColumn("_before", F.coalesce(F.sum("_m").over(up_to), F.lit(0))).select("_row.*", *rest, "_m", "_before")
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / BLOCK)))
    dealt = equal.withColumn("_block", block).repartition(F.xxhash64("source", "_before", "_block"))
    place = F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("_m"), (F.col("_block") + 1) * BLOCK) - 1))
    dealt = dealt.withColumn("_place", place).withColumn("_more", (F.col("_before") + F.col("_place") < F.col("_n")).cast("int"))
    return apart.unionByName(dealt.select(*docs.columns, *new, count.alias("_copies")))


def copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, others kept) with size, source_size, target, copies (0, 1 or 2).

    size is the number of `[^\\x20\\x09-\\x0D]+` (null: 0), whatever the text's length. A null source is a source of its own, the last. Texts without words get no
    copy. Repeated rows are documents of their own: where a source's words run out among equal rows, as many of them are taken as fit. A null doc_id
    is drawn by its text. An empty table gives an empty result. Columns of docs named like the new ones are replaced.
    """
    new = {"size": "_size", "source_size": "_words", "target": "_target", "copies": "_copies"}
    slim, back = apart(docs.drop(*new), "doc_id", "text", "source")
    return back(_taken(slim).withColumnsRenamed({v: k for k, v in new.items()}), *new)


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it takes them, with the columns of docs as they are, of any name and type. Null texts and empty ones are never taken."""
    slim, back = apart(docs, "doc_id", "text", "source")
    out = _taken(slim)
    return back(out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


SQL = r"""
with d as (
  select *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, md5(text), '')), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from documents),
s as (select source, sum(size)::bigint as words, count(*) as docs from d group by source),
w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
l as (
  select *, (1.5::double * sum(words) over () - 2::double * coalesce(sum(words) over (order by words::double / weight, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by words::double / weight, source rows between current row and unbounded following) as level,
    row_number() over (order by words::double / weight, source) as place
  from w),
f as (select arg_min(level, place) as final from l where words > 0 and level * weight <= 2::double * words),
t as (
  select source, words, docs, case when words = 0 then 0 else least(2::double * words, coalesce(f.final * weight, 2::double * words)) end as target from l, f),
r as (select *, case when words > 0 then floor(target / words) else 0 end as sure from t),
k as (
  select d.doc_id, d.size, d.source, d.u, r.words, r.target, r.sure, r.target - r.sure * r.words as need, r.words::double / r.docs as mean
  from d join r on d.source is not distinct from r.source),
o as (
  select *, case when size > 0 and need > 0 and need / words < 1 then u / (1 - u) / (need / words / (1 - need / words) * sqrt(size / mean)) end as q from k),
c as (
  select *, coalesce(sum(case when q is not null then size end) over (partition by source order by q nulls last, doc_id, size rows between unbounded preceding and 1 preceding), 0) as so_far from o),
x as (select source, count(*) filter (q is not null and so_far + size / 2.0 <= need) as n from c group by source),
y as (select c.*, row_number() over (partition by c.source order by q nulls last, doc_id, size) as place from c)
select y.doc_id, y.size, y.words as source_size, y.target,
  (case when y.size > 0 then y.size * (y.sure + case when y.q is not null and y.place <= x.n then 1 else 0 end) else 0 end)::bigint as taken
from y join x on y.source is not distinct from x.source
"""
