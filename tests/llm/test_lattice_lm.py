import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from carecolumns.llm.lattice_lm import Lattice, score_texts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


def brute_marginal(model, word):
    text, p = b" " + word, dict(zip(model.pieces, model.p, strict=True))

    def go(at):
        if at == len(text):
            return model.stop
        return sum(p.get(text[at:end], 0) * (1 if at == 0 else 1 - model.stop) * go(end) for end in range(at + 1, len(text) + 1))

    return go(0)


def test_marginal_sums_all_segmentations():
    model = Lattice(PATH)
    words = [b"the", b"erinon", b"x", "éè".encode(), b"\xff\x00", b"token=9"]
    expected = np.zeros(len(model.pieces))
    got = model.run(words, expected)
    for w, lp in zip(words, got, strict=True):
        assert math.isclose(math.exp(lp), brute_marginal(model, w), rel_tol=1e-9)
    model.adapt(expected, len(words))
    for w, lp in zip(words, model.run(words), strict=True):
        assert math.isclose(math.exp(lp), brute_marginal(model, w), rel_tol=1e-9)
    assert (model.run([b"a" * 5000]) < 0).all()


def rows():
    r = random.Random(4)
    words = ["the", "of", "Éa", "erinon", "thanble", "x1", "ononre", "qq"]
    out = [(i, " ".join(r.choice(words + [f"w{r.randrange(50)}"]) for _ in range(r.choice([0, 1, 5, 40])))) for i in range(60)]
    return [*out, (60, None), (61, ""), (62, " \t\r\n"), (63, "THE the\x0bThe\xa0x"), (64, "ab" * 3000)]


def test_base_counts_match_brute_force(spark):
    data = rows()
    held = {i: crc32(str(i).encode()) % 7 == 2 for i, _ in data}
    token = lambda t: (t or "").encode().lower().split() + [None]
    count = Counter(w for i, t in data if not held[i] for w in token(t))
    n, v = sum(count.values()), len(count)
    for heavy in (200_000, 10):
        got = {r.doc_id: r for r in score_texts(spark.createDataFrame([(i, t, 7) for i, t in data], "doc_id long, text string, row long"), PATH, heavy).collect()}
        assert len(got) == len(data)
        for i, t in data:
            ws, r = token(t), got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in count for w in ws), n)
            assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-7)
            assert r.score < 0


def test_empty_and_repeated(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in score_texts(df, PATH).collect())
    assert got == [(0, 1), (1, 3), (1, 3)]


def log_marginal(model, word):
    text, p, longest = b" " + word, dict(zip(model.pieces, model.p.tolist(), strict=True)), max(map(len, model.pieces))
    logs = [0.0]
    for end in range(1, len(text) + 1):
        terms = [logs[at] + math.log(p[text[at:end]]) + (math.log1p(-model.stop) if at else 0) for at in range(max(0, end - longest), end) if text[at:end] in p]
        most = max(terms)
        logs.append(most + math.log(sum(math.exp(t - most) for t in terms)))
    return logs[-1] + math.log(model.stop)


def test_long_unknown_words_keep_their_log_probability(spark):
    r = random.Random(9)
    held = [i for i in range(200) if crc32(str(i).encode()) % 7 == 2]
    long = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (400, 3000, 6000)] + ["q" * 6000, "日本語" * 500]
    texts = {i: t for i, t in zip(held, ["", "the", *long, " ".join(long)], strict=False)}
    texts |= {i: "the of erinon thanble qq" + f" w{i % 9} x{i}" for i in range(200) if i not in held}
    trained = next(i for i in range(200) if i not in held)
    texts[trained] += " " + "0f" * 2000
    token = lambda t: t.encode().split() + [None]
    count = Counter(w for i, t in texts.items() if i not in held for w in token(t))
    n, v, share = sum(count.values()), len(count), count[None] / sum(count.values())
    model, known = Lattice(PATH), [w for w in count if w is not None]
    for _ in range(3):
        expected = np.zeros(len(model.pieces))
        model.run(known, expected)
        model.adapt(expected, len(known))
    lp = {w: math.log(share) if w is None else log_marginal(model, w) + math.log1p(-share) for w in {w for t in texts.values() for w in token(t)}}
    mass = lambda c, w, a: math.log(c + a * math.exp(lp[w])) if c else math.log(a) + lp[w]
    alpha = max((sum(c * (mass(c - 1, w, a) - math.log(n - 1 + a)) for w, c in count.items()), a) for a in (v * 2.0**k for k in range(-6, 5)))[1]
    got = {x.doc_id: x.score for x in score_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect()}
    assert min(lp.values()) < -10_000
    for i, t in texts.items():
        assert math.isclose(got[i], sum(mass(count[w], w, alpha) - math.log(n + alpha) for w in token(t)) / math.log(10), rel_tol=1e-9)
    # no training text: every word is unknown
    got = {x.doc_id: x.score for x in score_texts(spark.createDataFrame([(held[0], "a"), (held[1], "a" * 3000), (held[2], "")], "doc_id long, text string"), PATH).collect()}
    assert 0 > got[held[2]] > got[held[0]] > got[held[1]] > -math.inf
