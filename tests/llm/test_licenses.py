import random

from carecolumns.llm import licenses


def brute(text):
    w, starts, labels = licenses.normal_words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice(("er", "on", "th", "É", "ñ", "9", "ou")) for _ in range(r.randint(1, 3)))
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "mit-license", "MIT\nLicense", "general public, LICENSE apache license", "license", "İmit license"]
    out = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            parts.insert(r.randrange(4), r.choice(lines))
        out.append((i, r.choice([" ", "\n", "; "]).join(parts)))
    return [*out, (200, None), (201, ""), (202, "mit license " * 5000), (203, "Licensed under CC BY-NC 4.0."), (204, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (205, "the source of this software was agreed"), (205, "the source of this software was agreed"), (None, "the mit license")]


def test_base_matches_brute_force(spark):
    data = rows()
    got = licenses.scan(spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, words int, found string")).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in data), key=key)
    by = {r.doc_id: r for r in got}
    assert by[203].labels == "cc-by-nc" and by[203].score > 0.6 and by[204].labels == "mit" and by[204].n_base == 0 and by[204].score > 0.9
    assert by[205].labels == "" and by[205].score == 0 and by[200].labels == "" and by[202].n_base == 5000
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got) and all(0 <= r.score <= 1 for r in got)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_file_with_every_template(spark):
    every = [t for _, t, _ in licenses.TEMPLATES]
    filler = [(100 + i, f"plain words of file {i} the license is of no matter here") for i in range(50)]
    data = [(1, "\n\n".join(every)), (2, "\n\n".join(reversed(every))), *((10 + k, t) for k, t in enumerate(every)), *filler]
    by = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    labels = ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert by[1] == labels and by[2] == labels
    assert all(label in by[10 + k].split(",") for k, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert all(by[i] == "" for i, _ in filler)


def plain_scan(data):
    """labels and score of each text, by loops over words, templates and places."""
    import math

    texts = [licenses.normal_words(t) for _, t in data]
    vocabulary = {w for _, t, keys in licenses.TEMPLATES for x in (t, *keys) for w in x.split(" ")} | {w for p in licenses.BASE for w in p.split(" ")}
    idf = {w: math.log((len(texts) + 1) / (sum(w in set(x) for x in texts) + 0.5)) for w in vocabulary}
    out = []
    for words, (_, text) in zip(texts, data, strict=True):
        n, count, *_, base = brute(text)
        labels, best = set(filter(None, base.split(","))), 1.0 if count else 0.0
        for label, statement, keys in licenses.TEMPLATES:
            parts = statement.split(" ")
            rare = sorted(range(len(parts)), key=lambda i: (-idf[parts[i]], i))[: licenses.TEMPLATE_WORDS]
            whole = sum(idf[parts[i]] for i in rare)
            for at in range(-len(parts), n):
                share = sum(idf[parts[i]] for i in rare if 0 <= at + i < n and words[at + i] == parts[i]) / whole
                if share >= licenses.ENOUGH - 1e-12 and any(words[a : a + len(k.split(" "))] == k.split(" ") for k in keys for a in range(max(at - 2, 0), at + len(parts) + 3)):
                    labels.add(label)
                    best = max(best, min(share, 1.0))
        out.append((",".join(sorted(labels)), best))
    return out


def test_labels_match_a_plain_version(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice(("er", "on", "th", "ou")) for _ in range(r.randint(1, 3)))
    data = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(2)]
        for _ in range(r.choice([0, 1, 1, 3])):
            w = r.choice(licenses.TEMPLATES)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice([word(), "software", "license"])
            parts.insert(r.randrange(3), " ".join(w).title())
        data.append((i, "; ".join(parts)))
    data += [(80 + k, "plain words of no matter " * k) for k in range(40)]
    got = {x.doc_id: (x.labels, x.score) for x in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for (i, _), (labels, score) in zip(data, plain_scan(data), strict=True):
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9


def test_frequencies_come_from_all_texts(spark):
    # "by" is common in texts that hold no licence word at all, so it is not among the rarest words of its template
    data = [(1, "licensed under cc by 4 0")] + [(10 + k, "made by hand by nobody") for k in range(60)]
    rows = licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows}[1] == "cc-by" and all(r.n_words == 5 for r in rows if r.doc_id >= 10)
    assert dict(zip([i for i, _ in data], plain_scan(data), strict=True))[1][0] == "cc-by"


def test_own_notices_and_identifiers(spark):
    want = {
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.": "gpl,lgpl",
        "It falls under the GNU Affero General Public License.": "agpl,gpl",
        "Licence: Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa",
        "BSD 3-Clause License": "bsd",
        "// SPDX-License-Identifier: BSD-3-Clause": "bsd",
        "# SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
        "# SPDX-License-Identifier: MIT": "mit",
        "The data are released under CC0.": "cc0",
        "A plain text on the public, its general rights and a license to speak.": "",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == dict(enumerate(want.values()))
