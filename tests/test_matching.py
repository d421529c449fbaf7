"""Title matching and folding against plain Python."""

import hashlib
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from carecolumns.functions import text
from carecolumns.operators.matching import keep_best, like_names, match_titles


def names(n, seed, letters="abcde "):
    r = random.Random(seed)
    out = {"".join(r.choice(letters) for _ in range(r.randrange(1, 22))).strip() for _ in range(n)}
    for x in sorted(out)[: n // 2]:  # near ones
        y = list(x)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randrange(2)] = r.choice(letters)
        out.add("".join(y).strip())
    return sorted(out - {""})


@pytest.mark.parametrize("floor", [0.801, 0.82, 0.9])
def test_the_blocked_join_loses_no_pair(spark, floor):
    a, b = names(120, 1), names(120, 2) + names(60, 1)
    left, right = spark.createDataFrame([(x,) for x in a + a[:3]], "name string"), spark.createDataFrame([(x,) for x in b], "name string")
    got = {(r.name, r.other): r.score for r in like_names(left, right, floor).collect()}
    want = {(x, y): SequenceMatcher(None, x, y).ratio() for x in a for y in set(b) if min(len(x), len(y)) > 2}
    assert got == {k: v for k, v in want.items() if v >= floor} and len(got) > 20


def test_likeness_must_bind(spark):
    df = spark.createDataFrame([("abc",)], "name string")
    with pytest.raises(ValueError):
        like_names(df, df, 0.8)


def test_ways_of_matching_and_odd_rows(spark):
    entries = [("a1", "Anion Gap"), ("a0", "anion-gap!"), ("b", "Age (<24 months)"), ("c", "Café & bar score"), ("d", None), ("e", "??"), ("f", "Serum osmolality"), ("g", "serum osmolalitx")]
    titles = [(1, "ANION  GAP"), (2, "aniongap"), (3, "age (under 24 months)"), (4, "Cafe and Bar Score"), (5, "Old Gap"), (6, "Serum osmolalit"), (7, None), (8, ""), (9, "ab"), (1, "ANION  GAP"), (10, "nothing of the kind")]
    df = spark.createDataFrame([(i, t, {"x": 1}) for i, t in titles], "slug int, title string, name map<string,int>")
    also = spark.createDataFrame([("old gap", "Anion gap")], "written string, meant string")
    got = sorted(((r.title or "", r.slug, r.method, r.score and round(r.score, 6), r.review) for r in match_titles(df, spark.createDataFrame(entries, "slug string, title string"), also).collect()), key=repr)
    near = round(SequenceMatcher(None, "serum osmolalit", "serum osmolality").ratio(), 6)
    want = [("ANION  GAP", "a0", "exact", 1.0, False)] * 2 + [("aniongap", "a0", "squashed", 0.99, False), ("age (under 24 months)", "b", "exact", 1.0, False), ("Cafe and Bar Score", "c", "exact", 1.0, False), ("Old Gap", "a0", "alias", 1.0, False), ("Serum osmolalit", "g", "fuzzy", near, True)]
    want += [("", None, "none", None, False)] * 2 + [("ab", None, "none", None, False), ("nothing of the kind", None, "none", None, False)]
    assert got == sorted(want, key=repr)
    assert match_titles(df.limit(0), spark.createDataFrame(entries, "slug string, title string")).count() == 0
    assert {r.method for r in match_titles(df, spark.createDataFrame([], "slug string, title string")).collect()} == {"none"}


def test_folding_is_that_of_unicode(spark):
    every = [chr(p) for p in [*range(1, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x11000, 3)]]
    df = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(every)], "i int, x string")
    got = {r.i: r.p for r in df.select("i", text.plain(F.col("x")).alias("p")).collect()}
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    assert [(c, got[i]) for i, c in enumerate(every) if got[i] != f"x{fold(c)}y"] == []


def test_letters_that_fold_to_several_do_not_slow_a_text_down(spark):
    lines = ["Größe à élan <5 ﬁn ½ ﷺ", "a\u0301 x\ny", "plain <\n5", "", None, "𝕏ﬃ🙂"]
    texts = [*lines, *["".join(f"wörd{i % 97} élan " for i in range(20_000)) + f"oﬃce {k}…" for k in range(24)]]
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(4)
    got = {r.i: r.d for r in df.select("i", F.md5(text.plain(F.col("x"))).alias("d")).collect()}
    assert got == {i: None if t is None else hashlib.md5(fold(t).encode()).hexdigest() for i, t in enumerate(texts)}
    # no letter is held against more than two ranges at once, and the classes are bounded
    innermost = re.findall(r"\[([^\[\]&]*)\]", text._folds()[3])
    assert innermost and all(c.count("-") <= 2 for c in innermost)


def test_the_best_of_a_hot_key(spark):
    rows = [("hot", i % 50, i % 3) for i in range(3000)] + [(None, 7, 0), (None, 9, 0), ("one", None, 5)]
    df = spark.createDataFrame(rows, "k string, v int, w int")
    got = sorted(((r.k, r.v, r.w, r.rank) for r in keep_best(df, ["k"], [F.desc("v")], 2).collect()), key=repr)
    assert got == sorted([("hot", 49, 0, 1), ("hot", 49, 0, 2), (None, 9, 0, 1), (None, 7, 0, 2), ("one", None, 5, 1)], key=repr)
