"""Licence scans by a positional index of rare tokens. DataFrame functions only.

Templates are short licence statements, as words. Their inverted index (word -> template, place) is small. The words of every document are read, and the
document frequency of each word of the templates is counted over all of them; each template is indexed by its TEMPLATE_WORDS words of highest inverse
document frequency, and a file looks up all of its words that are in the index. A posting at place p that meets the file's word at place w proposes the
template at w - p; proposals are intersected by that relative place. A template is found where the matched words hold at least ENOUGH of the weight of its
own rarest words and one of its key phrases stands in the file within its reach.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import cut
from carecolumns.llm.single import once

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licence notices by label, and the phrases of which one must stand there.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["obtaining a copy of this software"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ["agreed to in writing"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("bsd", "licensed under the bsd license", ["bsd license", "bsd 2 clause", "bsd 3 clause"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    ("isc", "licensed under the isc license", ["isc license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "released into the public domain under cc0 1 0 universal", ["cc0"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("proprietary", "all rights reserved proprietary and confidential", ["all rights reserved"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", "gnu library general public license", ["library general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "bsd 2 clause license", ["bsd 2 clause"]),
    ("bsd", "bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ["promote products derived from this software"]),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one", ["copy of the mpl"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", ["attribution sharealike"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ["attribution noncommercial"]),
    ("cc0", "released under cc0", ["under cc0"]),
]
#: Identifiers of a public list of licences, by label.
IDENTIFIERS = {
    "mit": ("MIT",), "apache": ("Apache-2.0",), "gpl": ("GPL-2.0", "GPL-3.0"), "lgpl": ("LGPL-2.1", "LGPL-3.0"), "agpl": ("AGPL-3.0",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "mpl": ("MPL-2.0",), "isc": ("ISC",), "cc-by": ("CC-BY-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc0": ("CC0-1.0",), "epl": ("EPL-2.0",), "unlicense": ("Unlicense",),
}
TEMPLATES += [(label, f"spdx license identifier {words}", [f"license identifier {words}"]) for label, ids in IDENTIFIERS.items() for words in (i.lower().replace("-", " ").replace(".", " ") for i in ids)]
#: Words of a template that the index uses.
TEMPLATE_WORDS = 6
ENOUGH = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _starts(phrase: str) -> Column:
    """Starts of a phrase in the array `words`, from the places of its last word."""
    parts = phrase.split(" ")
    at = F.filter(F.col("found"), lambda x: x["word"] == parts[-1])
    at = F.transform(at, lambda x: x["place"] - (len(parts) - 1))

    def holds(i: Column) -> Column:
        ok = i >= 0
        for k, p in enumerate(parts[:-1]):
            ok = ok & (F.get(F.col("words"), i + k) == p)
        return ok

    return F.filter(at, holds)


def index_words() -> list[str]:
    return sorted({w for _, t, keys in TEMPLATES for w in t.split(" ")} | {w for _, _, keys in TEMPLATES for k in keys for w in k.split(" ")} | {w for p in BASE for w in p.split(" ")})


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others ignored) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Null and empty texts have 0 words and empty labels. first_word and last_word
    are the smallest and largest start of a base phrase. score is the best template's share of matched weight, 1 where a base phrase stands, else 0.
    Whole texts are read, whatever their length. Rows come out one by one, repeated ones and those without an id as well; columns named like the new ones do not
    matter. An empty table gives an empty result.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    vocabulary = index_words()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = once(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words")), "words")
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("place")))), lambda x: x.isNotNull())
    rows = once(rows.withColumn("found", places), "found")
    nowhere = F.array().cast("array<int>")
    phrases = sorted({*BASE, *(k for _, _, ks in TEMPLATES for k in ks)})
    # only words of the templates are kept from here on
    rows = once(rows.withColumn("at", F.struct(*[F.coalesce(_starts(p), nowhere).alias(p) for p in phrases])), "at").drop("words")
    starts = F.concat(*[F.col(f"at.`{p}`") for p in BASE])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"at.`{p}`") > 0, F.lit(label)) for p, label in BASE.items()]))
    key_places = F.array_compact(F.array(*[F.when(F.size(f"at.`{k}`") > 0, F.struct(F.lit(k).alias("key"), F.col(f"at.`{k}`").alias("at"))) for k in phrases]))
    held = cut(rows.select("row", "doc_id", "n_words", starts.alias("starts"), F.array_sort(F.array_distinct(base_labels)).alias("base"), "found", key_places.alias("keys")))

    total = max(held.count(), 1)
    frequent = held.where("size(found) > 0").select("row", F.explode(F.array_distinct(F.transform("found", lambda x: x["word"]))).alias("word")).groupBy("word").count().collect()  # a row a word of the templates
    many = {r["word"]: r["count"] for r in frequent}
    idf = {w: math.log((total + 1) / (many.get(w, 0) + 0.5)) for w in vocabulary}
    found = held.where("size(keys) > 0").select("row", "keys", "found")
    labels = _proposals(found, idf).groupBy("row", "p.template", "p.at").agg(F.sum("p.weight").alias("weight"), F.first("keys").alias("keys"))
    checked = F.lit(None).cast("struct<label:string,score:double>")
    for k, (label, statement, phrases) in enumerate(TEMPLATES):
        chosen = _chosen(statement, idf)
        share = F.col("weight") / F.lit(sum(idf[statement.split(" ")[i]] for i in chosen) or 1.0)
        near = _key_near(phrases, len(statement.split(" ")))
        checked = F.when((F.col("template") == k) & (share >= ENOUGH - 1e-12) & near, F.struct(F.lit(label).alias("label"), F.least(share, F.lit(1.0)).alias("score"))).otherwise(checked)
    labels = labels.select("row", checked.alias("c")).where("c is not null").groupBy("row").agg(F.collect_set("c.label").alias("found"), F.max("c.score").alias("score"))  # a set of template labels at most
    out = held.drop("found").join(labels, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", every).alias("labels"), F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce("score", F.lit(0.0)), 9)).alias("score"),
    )


def _key_near(phrases: list[str], span: int) -> Column:
    """Whether a key phrase begins within a template's reach."""
    return F.exists("keys", lambda x: x["key"].isin(phrases) & F.exists(x["at"], lambda a: (a >= F.col("at") - 2) & (a <= F.col("at") + span + 2)))


def _chosen(statement: str, idf: dict[str, float]) -> list[int]:
    """Places of a template's rarest words."""
    parts = statement.split(" ")
    return sorted(sorted(range(len(parts)), key=lambda i: (-idf[parts[i]], i))[:TEMPLATE_WORDS])


def _proposals(found: DataFrame, idf: dict[str, float]) -> DataFrame:
    """found with a row for each posting that one of the file's words meets: p.template, p.at, p.weight."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, (_, statement, _) in enumerate(TEMPLATES):
        for i in _chosen(statement, idf):
            postings.setdefault(statement.split(" ")[i], []).append((k, i))
    order = sorted(postings, key=lambda w: (-idf[w], w))
    rank = F.create_map(*[x for i, w in enumerate(order) for x in (F.lit(w), F.lit(i))])
    index = F.array(*[F.array(*[F.struct(F.lit(k).alias("template"), F.lit(i).alias("place"), F.lit(idf[w]).alias("weight")) for k, i in postings[w]]) for w in order])
    ranked = F.transform(F.filter("found", lambda x: x["word"].isin(order)), lambda x: F.struct(F.element_at(rank, x["word"]).alias("rank"), x["place"].alias("place")))
    found = once(found.withColumn("ranked", ranked), "ranked")
    each = F.flatten(F.transform("ranked", lambda x: F.transform(F.get(index, x["rank"]), lambda p: F.struct(p["template"].alias("template"), (x["place"] - p["place"]).alias("at"), p["weight"].alias("weight")))))
    return once(found.withColumn("ps", each), "ps").select("row", "keys", F.explode("ps").alias("p"))


def normal_words(text: str) -> list[str]:
    """The words of one text, for tests and tools."""
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sql() -> str:
    """The scan as SQL over `documents`, from the same tables of phrases and templates."""
    text = lambda t: "'" + t + "'"
    words = lambda t: "[" + ", ".join(map(text, t.split(" "))) + "]"
    base = ", ".join(f"({text(label)}, {words(p)})" for p, label in BASE.items())
    templates = ", ".join(f"({k}, {text(label)}, {words(t)})" for k, (label, t, _) in enumerate(TEMPLATES))
    keys = ", ".join(f"({k}, {words(p)})" for k, (_, _, ps) in enumerate(TEMPLATES) for p in ps)
    return rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
base(label, parts) as (values {base}), template(k, label, parts) as (values {templates}), phrase(k, parts) as (values {keys}),
vocabulary as (select distinct unnest(parts) as word from (select parts from base union all select parts from template union all select parts from phrase)),
spot as (select r, word, i - 1 as place from (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from d) semi join vocabulary using (word)),
starts as (select d.r, b.label, a.place from base b join spot a on a.word = b.parts[1] join d on d.r = a.r where d.ws[a.place + 1 : a.place + len(b.parts)] = b.parts),
found as (select r, count(*) as n, min(place) as first, max(place) as last, list_sort(list_distinct(list(label))) as labels from starts group by r),
idf as (select word, ln(((select greatest(count(*), 1) from d) + 1) / (coalesce(many, 0) + 0.5::double)) as weight from vocabulary left join (select word, count(distinct r) as many from spot group by word) using (word)),
rare as (
  select k, label, place, word, weight, size, sum(weight) over (partition by k) as whole from (
    select t.k, t.label, i - 1 as place, word, weight, len(t.parts) as size, row_number() over (partition by t.k order by weight desc, i) as rank
    from (select k, label, parts, unnest(parts) as word, generate_subscripts(parts, 1) as i from template) t join idf using (word)) where rank <= {TEMPLATE_WORDS}),
proposal as (select a.r, rare.k, rare.label, a.place - rare.place as start, sum(rare.weight) / any_value(rare.whole) as share, any_value(rare.size) as size from spot a join rare using (word) group by all),
key as (select d.r, p.k, a.place from phrase p join spot a on a.word = p.parts[1] join d on d.r = a.r where d.ws[a.place + 1 : a.place + len(p.parts)] = p.parts),
hit as (
  select p.r, list(distinct p.label) as labels, max(least(p.share, 1)) as score from proposal p
  where p.share >= {ENOUGH} - 1e-12 and exists (select 1 from key where key.r = p.r and key.k = p.k and key.place between p.start - 2 and p.start + p.size + 2) group by p.r)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(f.n, 0)::bigint as n_base, f.first::bigint as first_word, f.last::bigint as last_word, coalesce(array_to_string(f.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(f.labels, []), coalesce(h.labels, [])))), ','), '') as labels,
  case when f.n > 0 then 1::double else round(coalesce(h.score, 0)::double, 9) end as score
from d left join found f on f.r = d.r left join hit h on h.r = d.r
"""
