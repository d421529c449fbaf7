import random
import zlib

import numpy as np
import pytest

from carecolumns.llm import lexical_packing as packing
from carecolumns.llm.word_bpe import WordCodec

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    r = random.Random(8)
    alphabet = "aeiou theronstlyTHE \n\t\r.,!?'0123456789éèßÀÖ×÷ªºµ中文字🙂‍́\x00\x0b\x1c\x1d\x7f\x85\xa0 ½Ⅷ٣_-'sllveJ̌İΣς"
    out = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 20, 300]))) for _ in range(600)]
    return [*out, "", " ", "it's we'll they've I'm you're he'd 'Ll", "<|endoftext|>", "a<|startoftext|> B<|endoftext|>c <|ENDOFTEXT|>", "x" * 20000, "the " * 5000, "É" * 40, "ab" * 16, "ab" * 17, "".join(map(chr, range(1, 0xD800, 7)))]


def test_ids_equal_the_library():
    reference, codec = library(), WordCodec(PATH)
    assert codec.known_rules
    for t, ids in zip(texts(), codec.encode(texts()), strict=True):
        assert np.frombuffer(ids, codec.dtype).tolist() == reference.encode(t, add_special_tokens=False).ids, t[:80]


def test_long_texts_and_full_stores(monkeypatch):
    from carecolumns.llm import word_bpe

    monkeypatch.setattr(word_bpe, "BLOCK", 1000)
    monkeypatch.setattr(word_bpe, "KEPT_BYTES", 20_000)
    r, reference, codec = random.Random(2), library(), WordCodec(PATH)
    for _ in range(6):
        t = " ".join("".join(r.choice("aeinorsthé") for _ in range(r.randrange(1, 12))) for _ in range(1500)) + "z" * 5000 + " end"
        assert np.frombuffer(codec.encode([t, "the"])[0], codec.dtype).tolist() == reference.encode(t, add_special_tokens=False).ids
        assert codec.known_bytes < 20_000 + 1_000_000


def test_scores_are_bm25():
    r = np.random.default_rng(1)
    texts = [r.integers(0, 60, r.integers(1, 80)) for _ in range(40)]
    n = np.array([sum(t in x for x in texts) for t in range(60)])
    idf, mean = packing.inverse_frequency(n, 40), float(np.mean([len(t) for t in texts]))
    index = packing.Index(texts, idf, mean)
    weight = lambda t, x: idf[t] * (tf := (x == t).sum()) * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
    for i in (0, 7, 39):
        asked = sorted(set(texts[i].tolist()), key=lambda t: (-weight(t, texts[i]), t))[: packing.TERMS]
        assert sorted(index.asked(i).tolist()) == sorted(asked)
        assert np.allclose(index.scores(i), [sum(weight(t, x) for t in asked) for x in texts])


def test_neighbours_share_a_window():
    r = random.Random(5)
    topics = [[k * 50 + r.randrange(50) for _ in range(60)] for k in range(8) for _ in range(4)]
    order = list(range(len(topics)))
    r.shuffle(order)
    texts = [np.array(topics[i]) for i in order]
    found = packing.fill(np.array([60] * 32), packing.Index(texts, np.ones(400), 60.0), 240)
    for row in found:
        assert len({order[i] // 4 for i, _ in row}) == 1 and sum(n for _, n in row) == 240


def test_shards_hold_what_they_may():
    costs = [(k, r) for k, r in enumerate([3, 4, 5, 40, 1, 1, 9, 10, 11])]
    got = packing.shards(costs, 10)
    held = {}
    for (_, cost), (_, first, many) in zip(costs, got, strict=True):
        for s in range(first, first + many):
            held[s] = held.get(s, 0) + cost / many
    assert max(held.values()) <= 10 and sorted(held) == list(range(len(held)))


def test_every_id_is_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20_000)
    r = random.Random(4)
    words = ["".join(r.choice("aeinorsth") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(r.choice([1, 20, 300, 900]))) for i in range(150)] + [(900, say(9000)), (901, None), (902, ""), (903, "Ünïcode 中"), (None, "no id"), (904, "twice"), (904, "twice")] + [(i, "one common text of some words") for i in range(1000, 1200)]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, start int, row int")
    got = [r.asDict() for r in packing.packed(df, PATH).collect()]
    lib, ids = library(), {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        whole = ids[p["doc_id"]][0]
        assert p["doc_tokens"] == len(whole) and p["length"] > 0 and p["ids_crc32"] == zlib.crc32(whole[p["start"] : p["start"] + p["length"]].tobytes())
    for i, copies in ids.items():
        covered = sorted((p["start"], p["length"]) for p in by_doc[i])
        for _ in copies:  # each copy is covered once
            at = 0
            while at < len(copies[0]):
                k = next(k for k, c in enumerate(covered) if c[0] == at)
                at += covered.pop(k)[1]
        assert not covered
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at < 2048 and at & (at - 1) == 0  # no padding at all
    assert packing.packed(df.limit(0), PATH).count() == 0
