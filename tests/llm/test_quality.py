import random

from carecolumns.llm import quality


def rows(n=400, seed=1):
    r = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        good = r.random() < (0.2 if i % 7 == 0 else 0.85)
        w = ["".join(r.choice(("er", "on", "th", "an", "ou")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        if not good:
            w = r.choice([[x.upper() + "!!" for x in w], [x + r.choice(["&&&", "%%%", "$$$"]) for x in w], [x for x in w for _ in range(7)], [x + " |" for x in w]])
        out.append((i, " ".join(w), f"host{i % 7}", r.choice(["en", "fr", None])))
        labels.append((i, int(good)))
    return out, labels


def test_held_out_accuracy_and_shrinkage(spark):
    data, labels = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    train = spark.createDataFrame([x for x in labels if x[0] % 3 == 0], "doc_id long, quality int")
    got = quality.judge(docs, train).collect()
    truth = dict(labels)
    held = [r for r in got if r.doc_id % 3]
    assert len(got) == len(data) and sum(r.keep == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    share = {r.source: r.host_share for r in got}
    assert min(share, key=share.get) == "host0"
    # a path of few documents lies between its own mean and its host's
    assert all(0 < r.path_share < 1 for r in got)
    kept = quality.kept(docs, train)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.keep}


def test_nulls_no_labels_and_empty(spark):
    data, labels = rows(60)
    data += [(900, None, None, None), (901, "", "host0", "en"), (None, "erer onon", "x", "y"), (902, "x" * 200000, "host1", "en"), (3, data[3][1], data[3][2], data[3][3])]
    docs = spark.createDataFrame([(*d, 1.0) for d in data], "doc_id long, text string, source string, lang string, quality double")
    train = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    assert quality.judge(docs, train).count() == len(data)
    assert quality.judge(docs, train.limit(0)).where("keep").count() == len(data)
    assert quality.judge(docs.limit(0), train).count() == 0 and quality.kept(docs.limit(0), train).count() == 0
    assert None in {r.doc_id for r in quality.kept(docs, train).collect()}


def test_shares_and_posteriors_match_a_plain_version(spark):
    import math
    from collections import defaultdict

    import pyarrow as pa

    data, labels = rows(300, 7)
    data += [(1000 + k, data[k][1], "rare" if k < 3 else None, "xx" if k % 2 else None) for k in range(9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    train = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    model = quality.fit(docs, train)
    odds = {d[0]: o for d, o in zip(data, model.log_odds(quality.measures(pa.array([d[1].encode() for d in data], pa.binary()))), strict=True)}
    p = {i: 1 / (1 + math.exp(-o)) for i, o in odds.items()}
    by_path, by_host = defaultdict(list), defaultdict(list)
    for i, _, s, lang in data:
        by_path[s, lang].append(p[i])
        by_host[s].append(p[i])
    share = (sum(p.values()) + 1) / (len(p) + 2)

    def pseudo(groups, prior):
        many = {k: v for k, v in groups.items() if len(v) >= 2}
        n = sum(map(len, many.values()))
        mean = {k: sum(v) / len(v) for k, v in many.items()}
        apart = sum(len(v) * (mean[k] - prior[k]) ** 2 for k, v in many.items())
        within = sum(prior[k] * (1 - prior[k]) for k in many)
        spread = sum(len(v) * prior[k] * (1 - prior[k]) for k, v in many.items())
        return min(max(spread / n / max((apart - within) / n, 1e-6), 1.0), 1e4)

    m = pseudo(by_host, dict.fromkeys(by_host, share))
    host = {k: (sum(v) + m * share) / (len(v) + m) for k, v in by_host.items()}
    m = pseudo(by_path, {k: host[k[0]] for k in by_path})
    path = {k: (sum(v) + m * host[k[0]]) / (len(v) + m) for k, v in by_path.items()}
    got = quality.judge(docs, train).collect()
    assert len(got) == len(data)
    for r in got:
        post = path[r.source, r.lang]
        q = 1 / (1 + math.exp(-(odds[r.doc_id] - model.prior) - math.log(post / (1 - post))))
        want = (odds[r.doc_id] - model.prior, share, host[r.source], post, q)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip((r.evidence, r.global_share, r.host_share, r.path_share, r.quality), want, strict=True)) and r.keep == (q >= 0.5)


def test_rows_of_one_id_are_judged_one_by_one(spark):
    data, labels = rows()
    good, bad = data[[g for _, g in labels].index(1)], data[[g for _, g in labels].index(0)]
    data += [(5000, good[1], "host1", "en"), (5000, bad[1], "host1", "en"), (5000, good[1], "host1", "en")]
    docs = spark.createDataFrame([(*d, 7) for d in data], "doc_id long, text string, source string, lang string, mark int")
    kept = quality.kept(docs, spark.createDataFrame([*labels, (1, 0), (1, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and [r.text for r in kept.where("doc_id = 5000").collect()] == [good[1]] * 2
