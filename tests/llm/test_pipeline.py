"""The pipeline, stage by stage, against versions in plain Python (and SQL for the mix)."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from carecolumns.llm import bpe, mixing
from tests.llm.test_ngram_jaccard import brute

pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")


def tables():
    r = random.Random(12)
    word = lambda: "".join(r.choice(("er", "on", "th", "an", "ou", "re")) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(r.randint(15, 120))]
        good = r.random() < 0.8
        if not good:
            w = r.choice([[x.upper() + "!!" for x in w], [x + r.choice(["&&&", "%%%", "$$$"]) for x in w]])
        elif r.random() < 0.3 and docs:
            w = docs[r.randrange(len(docs))][1].split()
            w[r.randrange(len(w))] = "edited"
            good = None
        elif r.random() < 0.2:
            w += ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"']
        docs.append((i, " ".join(w), r.choice(["en", "fr"]), f"src{i % 5 if i % 3 else 0}", None))
        if good is not None and i % 2:
            labels.append((i, int(good), 0))
    docs = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in docs]
    return [*docs, (900, None, "en", "src0", None), (901, "", None, None, 0)], labels


def test_stages_and_run(spark, tmp_path):
    import tokenizers

    docs, labels = tables()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, rows = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        rows.append(frame.collect())
    truth = {i: q for i, q, _ in labels}
    first = {r.doc_id for r in rows[0]}
    assert sum((i in first) == bool(q) for i, q in truth.items()) >= 0.97 * len(truth)
    roots = brute([(r.doc_id, r.text) for r in rows[0]])
    assert {r.doc_id for r in rows[1]} == {i for i, (_, root) in roots.items() if i == root}
    import re

    mask = lambda t: None if t is None else re.sub(r'(?<=token = ")[0-9a-f]{40}', "[SECRET]", t)
    assert {(r.doc_id, r.text) for r in rows[2]} == {(r.doc_id, mask(r.text)) for r in rows[1]}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows[2]])
    want = Counter({i: taken // size for i, taken, size in con.execute(f"select doc_id, taken, size from ({mixing.SQL}) where taken > 0").fetchall()})
    assert Counter(r.doc_id for r in rows[3]) == want
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for r, text in ((r, {x.doc_id: x.text for x in rows[3]}[r.doc_id]) for r in rows[4]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode_ids(frame, public.path("byte_bpe_50k.json")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text or "") for r in rows[3])
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in rows[4])


def test_stages_carry_columns_of_any_name_and_type(spark):
    """Every internal name of every stage as a column of the documents, and columns that can be neither compared nor grouped."""
    names = "_id _mark mark _words _target _s _es _eb _en _size _u _q _bin _m _n _last _ls _copies _copy _more _block _place _before _json _row _tie _sure _need _mean _held _found _gaps _score _features _named _new others size source_size target copies quality keep root rows key before n_shingles component_id _h _p".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names) + ", m map<string,int>, a array<int>, s struct<doc_id:int,text:string>"
    say = lambda i: " ".join(f"word{i}x{j}" for j in range(12))
    rows = [(i, say(i % 9) + (' password = "hunter2hunter2X"' if i == 4 else ""), "en", f"s{i % 2}", 5, *range(len(names)), {"k": i}, [i], (i, "t")) for i in [*range(12), 3, 3, 11, 11, 11]] + [(None, "no id at all", None, None, 1, *range(len(names)), None, None, None)] * 3
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    from carecolumns.llm import mixing, ngram_jaccard, quality, secrets

    for f in (lambda d: quality.kept(d, labels), ngram_jaccard.one_of_each, secrets.masked, mixing.mixed):
        out = f(docs)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        for r in out.collect():
            assert [r[n] for n in names] == list(range(len(names))) and (r.doc_id is None or (r.m, r.a, r.s.doc_id) == ({"k": r.doc_id}, [r.doc_id], r.doc_id))
    assert ngram_jaccard.one_of_each(docs).where("doc_id = 3").count() == 1
    assert mixing.copies(docs).count() == docs.count()
