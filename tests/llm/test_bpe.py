import hashlib
import random

import pytest

from carecolumns.llm.bpe import Codec, decode_ids, encode_texts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def texts():
    r = random.Random(8)
    alphabet = "aeiou theronstlyTHE \n\t\r.,!?'0123456789éèß中文字🙂‍́\x1c\x85\xa0 ½Ⅷ٣_-'sllve\x00"
    out = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 20, 300]))) for _ in range(400)]
    return [*out, "", " ", "   a  b ", "it's we'll they've I'm you're he'd", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "x" * 20000, "the " * 5000, "".join(map(chr, range(1, 0xD800, 7))), "".join(map(chr, range(0xE000, 0x2FFFF, 31)))]


def test_equals_the_library():
    import tokenizers

    reference, codec = tokenizers.Tokenizer.from_file(PATH), Codec(PATH)
    for t, ids in zip(texts(), codec.encode(texts()), strict=True):
        want = reference.encode(t, add_special_tokens=False).ids
        assert ids == want
        assert codec.decode(ids) == reference.decode(want, skip_special_tokens=False)


def test_greedy_guesses_are_verified_not_trusted():
    codec = Codec(PATH)
    r = random.Random(3)
    words = ["".join(r.choice("aeinorsth") for _ in range(r.randint(2, 14))) for _ in range(3000)]
    codec.learn(words)
    wrong = sum(codec.greedy(w.encode()) != codec.merge(w.encode()) for w in words)
    assert wrong > 50
    assert all(list(codec.known[w]) == codec.merge(w.encode()) for w in words)


def test_query_shape_nulls_and_round_trip(spark):
    data = [(1, "Hello wörld"), (1, "Hello wörld"), (None, None), (3, ""), (4, "z" * 5000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in data], "doc_id long, text string, n_tokens int")
    got = encode_texts(df, PATH, ids=True)
    back = sorted(((r.doc_id or 0, r.text) for r in decode_ids(got, PATH).collect()))
    assert back == sorted((i or 0, t or "") for i, t in data)
    for r in got.collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert encode_texts(df.limit(0), PATH).count() == 0


def test_long_words_are_speculated_and_verified_too():
    import tokenizers

    reference, codec = tokenizers.Tokenizer.from_file(PATH), Codec(PATH)
    r = random.Random(21)
    words = ["".join(r.choice(("the", "ing", "er", "zq", "on", "é", "文")) for _ in range(n)) for n in (400, 900, 5000)] + ["".join(r.choice("abcdefghij") for _ in range(3000))]
    merged = []
    exact = codec.merge
    codec.merge = lambda b: merged.append(len(b)) or exact(b)
    assert all(ids == reference.encode(w, add_special_tokens=False).ids for w, ids in zip(words, codec.encode(words), strict=True))
    assert min(merged) < 64  # pairs were decided, not only whole words merged


def test_kept_chunks_are_bounded_by_bytes(monkeypatch):
    from carecolumns.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_BYTES", 50_000)
    codec = Codec(PATH)
    r = random.Random(2)
    for _ in range(30):
        text = " ".join("".join(r.choice("aeinorsth") for _ in range(12)) for _ in range(100))
        assert codec.decode(next(iter(codec.encode([text])))) == text
        assert codec.kept_bytes < 50_000 + 40_000 and len(codec.kept) < 300


def test_failing_words_of_a_batch_are_merged_side_by_side():
    codec = Codec(PATH)
    r = random.Random(34)
    words = ["".join(r.choice("aeinorsthñé中 ") for _ in range(r.choice((0, 1, 2, 7, 15, 40)))).encode() for _ in range(3000)] + [b"a" * n for n in range(60)]
    want = [codec.merge(w) for w in words]
    merged, exact = [], codec.merge
    codec.merge = lambda b: merged.append(len(b)) or exact(b)
    assert codec.merge_all(words) == want and codec.merge_all([]) == [] and codec.merge_all([b""]) == [[]]
    assert merged and min(merged) > 48  # only long words are merged one by one


def test_greedy_splits_of_a_batch_are_found_side_by_side():
    codec = Codec(PATH)
    r = random.Random(8)
    tokens = list(codec.usable)
    words = [b"".join(r.choice(tokens) for _ in range(r.randint(1, 4))) for _ in range(3000)] + [bytes(r.randrange(256) for _ in range(r.randint(0, 70))) for _ in range(1000)] + [b"", b"z" * 500]
    one_by_one, single = [], codec.greedy
    want = [single(w) for w in words]
    codec.greedy = lambda b: one_by_one.append(len(b)) or single(b)
    ids, size = codec.greedy_all(words)
    ends = size.cumsum()
    assert [ids[a:b].tolist() for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)] == want and min(one_by_one) > 48
    assert [x.tolist() for x in codec.greedy_all([])] == [[], []] and [x.tolist() for x in codec.greedy_all([b""])] == [[], [0]]
