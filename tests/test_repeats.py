"""Repeated blocks against a search at every place."""

import random

from carecolumns.operators.repeats import collapsed, without_repeats


def plain(text, least, reach):
    """The first pairs in order, found by comparing at every place, taken out until none is left."""
    while text:
        solid = [i for i, c in enumerate(text) if not c.isspace()]
        letters = [text[i] for i in solid]
        found, p = [], 0
        while p + least <= len(letters):
            q = next((q for q in range(p + least, min(len(letters) - least, p + 10**9) + 1) if letters[q : q + least] == letters[p : p + least]), None)
            if q is not None and q - p <= reach:
                found.append((p, q))
                p = q
            else:
                p += 1
        if not found:
            return text
        out, at = "", 0
        for p, q in found:
            out, at = out + text[at : solid[p]], solid[q]
        text = out + text[at:]
    return text


def test_against_every_place():
    r = random.Random(6)
    for k in range(120):
        block = "".join(r.choice("abcdefgh \n") for _ in range(r.randrange(5, 60)))
        text = "".join(r.choice([block, block.replace(" ", "  "), "".join(r.choice("xyz ") for _ in range(r.randrange(12)))]) for _ in range(r.randrange(1, 6)))
        assert collapsed(text, 8, 70) == plain(text, 8, 70), (k, text)


def test_long_and_odd_texts(spark):
    r = random.Random(7)
    say = lambda n: " ".join("".join(r.choice("aeinorst") for _ in range(r.randrange(2, 9))) for _ in range(n))
    head, block, tail = say(200), say(40), say(3000)
    rows = [(1, f"{head} {block} seam of it {block} {tail}"), (2, f"{head} {tail}"), (3, None), (4, ""), (5, "x" * 5000), (6, f"{block}\n\n{block}"), (2, f"{head} {tail}")]
    got = sorted(((o.i, o.t, o.removed, o.least) for o in without_repeats(spark.createDataFrame([(i, t, 9) for i, t in rows], "i int, t string, least int"), "t").collect()), key=repr)
    want = [(1, f"{head} {block} {tail}", len(block) + 12, 9), (2, f"{head} {tail}", 0, 9), (2, f"{head} {tail}", 0, 9), (3, None, 0, 9), (4, "", 0, 9), (6, block, len(block) + 2, 9)]
    assert [g for g in got if g[0] != 5] == sorted(want, key=repr)
    assert [len(g[1]) for g in got if g[0] == 5][0] < 180
    assert without_repeats(spark.createDataFrame([], "t string"), "t").count() == 0
