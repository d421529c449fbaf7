"""Registered queries of titles, names and formats over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from carecolumns.functions import text
from carecolumns.operators import matching, repeats
from carecolumns.queries import _register, _table

#: Edits of a part's name: as it is, other case and signs, run together, an alias, a letter less, a letter more, a word that no name is like.
_EDITS = "case p_partkey % 7 when 0 then p_name when 1 then upper(p_name) || '!' when 2 then replace(p_name, ' ', '') when 3 then 'the ' || p_name || ' of old' when 4 then left(p_name, length(p_name) - 1) when 5 then p_name || 'x' else 'zzz' || p_partkey end"


@_register("title_match", f"""
with p as (select p_partkey, p_name, {_EDITS} as title, length(p_name) as n from part)
select p_partkey, title, case when p_partkey % 7 < 6 then p_name end as slug, case p_partkey % 7 when 0 then 'exact' when 1 then 'exact' when 2 then 'squashed' when 3 then 'alias' when 6 then 'none' else 'fuzzy' end as method,
  round(case p_partkey % 7 when 2 then 0.99::double when 4 then 2.0 * (n - 1) / (2 * n - 1) when 5 then 2.0 * n / (2 * n + 1) when 6 then null else 1.0::double end, 9) as score, p_partkey % 7 in (4, 5) as review from p""")
def title_match(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("slug"), F.col("p_name").alias("title")).distinct()
    titles = part.select("p_partkey", F.expr(_EDITS).alias("title"))
    also = names.select(F.concat(F.lit("The "), "slug", F.lit(" (of old)")).alias("written"), F.col("slug").alias("meant"))
    return matching.match_titles(titles, names, also).withColumn("score", F.round("score", 9))


@_register("folded_texts", """
select doc_id, length(f) as letters, md5(f) as digest from (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '),
  '(?:under|less\\s+than|below)\\s*(\\d)', 'lt\\1', 'g'), '[<≤]\\s*(\\d)', 'lt\\1', 'g'), '(?:over|greater\\s+than|above)\\s*(\\d)', 'gt\\1', 'g'), '[>≥]\\s*(\\d)', 'gt\\1', 'g'), '[^a-z0-9]+', ' ', 'g')) as f from documents)""")
def folded_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.folded(F.col("text")).alias("f")).select("doc_id", F.length("f").cast("long").alias("letters"), F.md5("f").alias("digest"))


_NAMES = "case p_partkey % 4 when 0 then replace(p_name, ' ', '_') || '__Dose' when 1 then 'daily' || upper(left(p_name, 1)) || substr(p_name, 2) when 2 then p_name || ' & Co. (' || p_size || ')' else '_' || p_type || '-' || p_brand end"


@_register("names_and_formats", f"""
with n as (select p_partkey, {_NAMES} as name, p_retailprice * case p_partkey % 5 when 0 then 1 when 1 then 0.001 when 2 then -1000.25 when 3 then 0.01 else 100000 end as x, p_size from part),
w as (select *, trim(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) as words, round(x, case when x = floor(x) then 0 when abs(x) >= 100 then 1 when abs(x) >= 1 then 2 else 3 end) as r from n)
select p_partkey, trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') as slug,
  trim(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '__+', '_', 'g')), '_') as snake,
  array_to_string(list_transform(regexp_extract_all(words, '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)'), lambda v: upper(left(v, 1)) || substr(v, 2)), '') as title,
  case when r < 0 then '-' else '' end || format('{{:,}}', trunc(abs(r))::bigint) || case when x = floor(x) then '' when abs(x) >= 100 then right(printf('%.1f', abs(r)), 2) when abs(x) >= 1 then right(printf('%.2f', abs(r)), 3) else right(printf('%.3f', abs(r)), 4) end as number,
  strftime(timestamp '1970-01-01' + to_days((p_partkey * 37 % 40000)::int), '%b %-d, %Y') as day,
  case when p_size % 3 = 0 then p_size || '–' || (p_size + 2) when p_size % 3 = 1 then '≥ ' || p_size else '≤ ' || (p_size + 2) end as band,
  case p_size % 5 when 0 then 'bad' when 1 then 'caution' when 2 then 'good' when 3 then 'neutral' else 'bad' end as tone from w""")
def names_and_formats(spark, sf_dir):
    name, size = F.col("name"), F.col("p_size")
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(_NAMES).alias("name"), F.expr("p_retailprice * case p_partkey % 5 when 0 then 1 when 1 then 0.001 when 2 then -1000.25 when 3 then 0.01 else 100000 end").alias("x"))
    label = F.when(size % 5 == 0, "Severe disease, low grade").when(size % 5 == 1, "Moderate").when(size % 5 == 2, "Risk is LOW").when(size % 5 == 3, "Highest point").otherwise("Very high, none")
    return df.select(
        "p_partkey", text.slug(name).alias("slug"), text.camel_to_snake(name).alias("snake"), text.title_case(name).alias("title"), text.number_text(F.col("x")).alias("number"), text.date_text((F.col("p_partkey") * 37 % 40000 * 86_400_000 + 5000).cast("double")).alias("day"),
        text.range_text(F.when(size % 3 != 2, size), F.when(size % 3 != 1, size + 2)).alias("band"), text.tone(label).alias("tone"),
    )


@_register("keep_best_by_source", """
select source, doc_id, n_chars, rank::int as rank from (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 3""")
def keep_best_by_source(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return matching.keep_best(rows, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@_register("without_copies", """
with n as (select case when p_partkey % 3 = 0 then upper(p_name) || ' (' || p_partkey % 10 || ')' when p_partkey % 3 = 1 then p_name || ' (2016)' else p_name end as name from part)
select name from (select name, row_number() over (partition by lower(trim(regexp_replace(name, '\\s*\\(\\d\\)\\s*$', ''))) order by length(name), name) as k from n) where k = 1""")
def without_copies(spark, sf_dir):
    name = F.expr("case when p_partkey % 3 = 0 then upper(p_name) || ' (' || p_partkey % 10 || ')' when p_partkey % 3 = 1 then p_name || ' (2016)' else p_name end")
    return matching.without_copies(_table(spark, sf_dir, "part").select(name.alias("name")), "name")


#: Blocks have no SQL form: tests/test_repeats.py holds them against a search at every place.
@_register("repeats_collapsed", None)
def repeats_collapsed(spark, sf_dir):
    out = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))
