import hashlib
import random

from carecolumns.llm.parsing_fingerprint import fingerprint_neighbours, fingerprints, likeness


def rows():
    r = random.Random(2)
    word = lambda: "".join(r.choice(("er", "on", "th", "an", "é", "ou")) for _ in range(r.randint(1, 4)))
    return [(i, " ".join(word() for _ in range(r.choice([1, 2, 30, 400])))) for i in range(0, 200, 3)] + [(1000, None), (1001, ""), (1002, "aaaa" * 3000), (1003, "ab"), (1004, "🙂" * 7)]


def test_neighbours_match_brute_force(spark):
    data = rows()
    order = sorted(((i, t or "") for i, t in data), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        a, b, c = fingerprints([t, edited, nxt])
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c))
    for parts in (1, 5):
        got = fingerprint_neighbours(spark.createDataFrame([(i, t, "z") for i, t in data], "doc_id long, text string, part string"), parts).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want and len(got) == len(data)


def test_shared_text_is_found_at_any_offset_and_alone():
    r = random.Random(7)
    text = lambda n: "".join(r.choice("etaoin shrdlu") for _ in range(n))
    body = text(3000)
    a, b, c, d = fingerprints([body, "prefix " + body, body[100:], text(3000)])
    assert likeness(a, b) > 0.9 and likeness(a, c) > 0.8 and likeness(a, d) < 0.1
    for t in ("", "a", "ab", "aaaaaaaa", body):
        assert fingerprints([t]) == fingerprints(["x" * 500, t, t])[2:] == fingerprints([body, t])[1:]


def test_empty_single_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert fingerprint_neighbours(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint_neighbours(spark.createDataFrame([(5, "abcdef")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(5, "abc"), (5, "abc"), (None, "x"), (None, None), (7, "abcdef")]
    assert fingerprint_neighbours(spark.createDataFrame(rows, schema)).count() == 5


def test_rows_without_an_id_are_dealt_over_ranges(spark):
    from pyspark.sql import functions as F

    from carecolumns.llm import parsing_fingerprint

    data = [(None, f"text of row {k} " * (k % 5)) for k in range(300)] + [(7, f"other {k}") for k in range(200)] + [(k, f"id {k}") for k in range(100, 160)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = df.select(F.bitwise_not(F.coalesce("doc_id", F.lit(-(2**63)))).alias("turned"), F.xxhash64("text").alias("hash"), "doc_id", "text")
    rows = rows.withColumn("part", parsing_fingerprint._place(parsing_fingerprint._bounds(rows, 8)))
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 200
    want = {}
    order = sorted(rows.collect(), key=lambda r: (r.turned, r.hash, r.text))
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        n = len(a.text) // 3
        want.setdefault((a.doc_id, a.text), set()).add(hashlib.sha256((a.text[: len(a.text) - n] + b.text[:n]).encode()).hexdigest())
    got = fingerprint_neighbours(df, 8).collect()
    assert len(got) == len(data) and {r.edited_sha256 for r in got} == set().union(*want.values())


ALL = 2**64 - 1


def _mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


def plain_levels(text):
    """The names of each level by the definition, symbol by symbol."""
    symbols, out = [ord(c) for c in text], []
    for _ in range(3):
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        names = [_mixed((s + n * 0xC2B2AE3D27D4EB4F) & ALL) for s, n in runs]
        labels = names
        for _ in range(3):
            tossed = []
            for i, x in enumerate(labels):
                other = labels[i - 1] if i else x ^ 1
                differ = x ^ other
                bit = (differ & -differ).bit_length() - 1
                tossed.append(2 * bit + (x >> bit & 1))
            labels = tossed
        assert all(label < 8 for label in labels) and all(a != b for a, b in zip(labels, labels[1:], strict=False))
        # a phrase begins at each local maximum but the last symbol, and at the text's first symbol
        begins = [0] + [i for i in range(1, len(names) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
        symbols = []
        for a, b in zip(begins, [*begins[1:], len(names)], strict=True):
            total = 0
            for at, x in enumerate(names[a:b]):
                weight = (_mixed(at % 4096 + 1 if at < 4096 else 4096) + (at >> 12) * 0x9E3779B97F4A7C15) & ALL
                total = (total + _mixed(x ^ weight) * (weight | 1)) & ALL
            symbols.append(_mixed((total + 1) & ALL))
        out.append(symbols)
    return out


def plain_fingerprint(text):
    if not text:
        return "0000" * 64
    slots = [ALL] * 64
    for level, names in enumerate(plain_levels(text), 1):
        for name in names if level in (2, 3) else ():
            value = _mixed((name + level) & ALL)
            slots[value % 64] = min(slots[value % 64], value >> 6)
    out = []
    for k in range(64):
        steps = next(d for d in range(64) if slots[(k + d) % 64] != ALL)
        value = _mixed(slots[k]) if not steps else _mixed((slots[(k + steps) % 64] + steps) & ALL)
        out.append(f"{value & 0xFFFF:04x}")
    return "".join(out)


def test_fingerprints_equal_a_symbol_by_symbol_version():
    r = random.Random(12)
    texts = ["", "a", "ab", "aa", "aaaaab", "abababab", "é中🙂" * 40, "x" * 9000, "".join(r.choice("ab") for _ in range(500))]
    texts += ["".join(r.choice("etaoin shrdlu\n") for _ in range(r.randrange(1, 900))) for _ in range(60)]
    assert fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_equal_parts_have_equal_phrases_inside():
    r = random.Random(13)
    body = "".join(r.choice("etaoin shrdlu") for _ in range(2000))
    own = plain_levels(body)[1]
    for before in ("", "q", "some other words ", "x" * 77):
        there = plain_levels(before + body + " and an end")[1]
        at = next(k for k in range(len(there)) if there[k] == own[20])
        assert there[at : at + len(own) - 40] == own[20 : len(own) - 20]
