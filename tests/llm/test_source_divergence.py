import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from carecolumns.llm import source_divergence as divergence
from carecolumns.llm.transducer import Transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(n, seed, letters="abé中\U0001f642z"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 9))).encode() for _ in range(n)})


def states_by_force(terms):
    """The number of different sets of endings, which is that of the states of a minimal automaton."""
    beginnings = {t[:k] for t in terms for k in range(len(t) + 1)} | {b""}
    return len({frozenset(t[len(b) :] for t in terms if t.startswith(b)) for b in beginnings})


def test_the_transducer_is_minimal_and_gives_places():
    for n in (0, 1, 5, 60, 400):
        terms = words(n, n)
        t = Transducer.load(Transducer.build(iter(terms)).save())
        assert t.size == len(terms) and len(t.final) == states_by_force(terms)
        others = [w for w in words(300, n + 1) if w not in set(terms)] + [b"", b"zzzzzzzzzzzz", b"\xff"] + [x[:-1] for x in terms if x[:-1] not in set(terms)]
        every = [*terms, *others]
        data = np.frombuffer(b"".join(every), np.uint8)
        end = np.cumsum([len(x) for x in every])
        assert t.ordinals(data, end - [len(x) for x in every], end).tolist() == [*range(len(terms)), *[-1] * len(others)]
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    with pytest.raises(ValueError):
        Transducer.build([b"a", b"a"])


def plain(rows, least, top):
    rows = [((lang or ""), (source or ""), TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out, scale = [], 10**9
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        counts = {s: Counter(t for _, s2, terms in own if s2 == s for t in terms if df[t] >= least) for s in {r[1] for r in own}}
        p_of = lambda c: {t: 1 + scale * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            marks = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(marks, 1)]
    return sorted(out)


def documents():
    r = random.Random(3)
    vocabulary = ["the", "a", "été", "Straße", "中文", "x", "über", "rare", "CAPS", "É", "naïve"]
    rows = [(r.choice(["en", "de", None]), r.choice(["s0", "s0", "s0", "s1", "s2", "Ä", None]), " ".join(r.choices(vocabulary, range(len(vocabulary), 0, -1), k=r.randrange(0, 30))) + r.choice(["", " 12x3", "?!", "don't-do_it"])) for _ in range(300)]
    return [*rows, ("xx", "s0", "alone"), ("xx", "s1", None), ("", "s9", ""), ("en", "empty", None), *[("en", "s0", "the same text")] * 40, ("fr", "long", "mot " * 30_000)]


@pytest.mark.parametrize("sent", [divergence.SENT_BYTES, 0])
def test_against_a_plain_version(spark, monkeypatch, sent):
    monkeypatch.setattr(divergence, "TILE_TERMS", 4)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "RANGE", 5)
    monkeypatch.setattr(divergence, "HELD", 20)
    df = spark.createDataFrame([(lang, source, text, 1, 2) for lang, source, text in documents()], "lang string, source string, text string, part int, ordinal int")
    got = sorted(map(tuple, divergence.audit(df, 10, 3, sent).collect()))
    want = plain(documents(), 10, 3)
    assert got == want and {r[2] for r in want} == {"pair", "term"}
    assert divergence.audit(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    columns = "lang, source, part, item, value, rank"
    want = con.execute(f"select {columns} from ({divergence.sql()})").fetchall()
    got = divergence.audit(spark.read.parquet(f"{folder}/documents.parquet")).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    c, n, v = 10**16 + 7, 3 * 10**17 + 5, 12_345
    df = spark.createDataFrame([(c, n, v)], "n long, total long, v long")
    assert df.select(F.expr(divergence._P.format(count="n", total="total"))).first()[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)
