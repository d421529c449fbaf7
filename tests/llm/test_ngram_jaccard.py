import random
from collections import defaultdict

from pyspark.sql import functions as F

from carecolumns.llm.components import components
from carecolumns.llm.ngram_jaccard import link_components, one_of_each


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 75 * len(s | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def cases():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, passage = [], " ".join(r.choice(words) for _ in range(60))
    for g in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 4, 5, 6, 20, 80, 400]))]
        for _ in range(r.choice([1, 2, 6, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w[: r.choice([len(w), len(w), max(1, len(w) * 9 // 10)])]))
        rows.append(passage + " " + " ".join(r.choice(words) for _ in range(r.choice([5, 15, 30]))))
    rows += [None, "", " \t\n", "One", "one", "a b c d", "A B C D", "é à ü", "É À Ü", "x " * 30000, "x " * 20000, "a b c d e f"]
    r.shuffle(rows)
    return list(enumerate(rows, 7))


def test_matches_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_components(df).collect()}
    assert got == brute(rows)


def test_group_of_weakly_linked_copies(spark):
    r = random.Random(1)
    base = [f"v{r.randrange(500)}" for _ in range(146)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            w[r.randrange(146)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_table_nulls_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string"
    assert link_components(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", None), (3, "a b c d e f", None), (4, None, None)], schema)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in link_components(df).collect()) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (3, 2, 1), (4, 0, 4)]
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4]


def test_rows_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(0, a), (1, a), (1, b), (2, b + " more"), (5, "u v w x y z"), (5, "u v w x y z"), (5, " ".join(f"c{k}" for k in range(30))), (6, " ".join(f"c{k}" for k in range(30)) + " end"), (7, b + " more"), (8, "alone in the world with six words")]
    df = spark.createDataFrame([(i, t, k % 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = {(r.doc_id, r.component_id) for r in link_components(df).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (7, 0), (5, 5), (6, 5), (8, 8)}
    kept = sorted((r.doc_id, r.text, r.n) for r in one_of_each(df).collect())
    assert kept == sorted([(0, a, 0), (5, "u v w x y z", 1), (5, rows[6][1], 0), (8, rows[9][1], 0)])


def test_long_columns_are_dealt_in_blocks(spark, monkeypatch):
    from carecolumns.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "LONG", 20)
    r = random.Random(3)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for i in range(500):
        # all share a passage; few others than near copies link
        w = passage + [f"x{i % 160}y{k}" for k in range(18 + i % 160 % 25)]
        for _ in range(r.choice([0, 1, 3])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    dealt = []
    whole = ngram_jaccard._dealt
    monkeypatch.setattr(ngram_jaccard, "_dealt", lambda rows, sizes, parts: dealt.append(whole(rows, sizes, parts)) or dealt[-1])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and dealt


def test_block_pairs_cover_every_pair_once(spark, monkeypatch):
    from carecolumns.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "LONG", 15)
    r = random.Random(9)
    rows = [(1, i, r.choice([5, 6, 8, 30, 33, 41, 100, 133]), i, b"\0" * 16) for i in range(300)]
    df = spark.createDataFrame(rows, "h long, doc long, n int, root long, bits binary")
    sizes = df.groupBy("h", ngram_jaccard._size_class().alias("class")).agg(F.count("*").alias("rows"))
    tiles = defaultdict(list)
    for x in ngram_jaccard._dealt(df, sizes, 4).collect():
        tiles[x.h].append((x.doc, x.n, x.side))
    pairs = [tuple(sorted((a[0], b[0]))) for t in tiles.values() for k, a in enumerate(t) for b in t[:k] if a[2] == 0 or a[2] != b[2]]
    assert max(map(len, tiles.values())) <= 60 and len(pairs) == len(set(pairs))
    assert {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and min(a[2], b[2]) >= 0.75 * max(a[2], b[2])} <= set(pairs)


def test_components_over_many_tasks(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(r.randrange(1000, 3000), r.randrange(1000, 3000)) for _ in range(1500)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    want = {(x, top(x)) for x in root}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7, F.rand(3))
    for one_task in (0, 10**6):
        assert {(x.node, x.root) for x in components(df, one_task).collect()} == want
