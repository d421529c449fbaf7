"""Secret scans with a random forest that removes false positives. DataFrame and SQL functions only.

Candidates are long runs that hold a digit, key headers, and values assigned to names such as password. Each has its length, character transitions and
classes, coverage by a small dictionary, likeness to a path, and the words beside it. A forest is trained on labelled findings (made by rule, some
hundreds of rows, on the driver) and compiled to one SQL expression, which the executors evaluate inside the row: a scan needs no shuffle.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carecolumns.llm.common import apart
from carecolumns.llm.single import once

_RUN = r"A-Za-z0-9_+/\-"
#: Private keys to their end line (or, where it is missing, to their last line of base64: 400 lines of 32 or more, longer than any key in use; what follows
#: is found as runs); a run of 16 or more with a digit.
_KEY_NAME = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_KEY = rf"-----BEGIN {_KEY_NAME}(?:[^-]*+(?:-(?!----)[^-]*+){{0,20}}+-----END {_KEY_NAME}|(?:[\s\\rn]{{1,6}}[A-Za-z0-9+/]{{32,}}+={{0,2}}){{0,400}}+)"
RUN = rf"{_KEY}|(?<![{_RUN}])(?=[A-Za-z_+/\-]*+[0-9])[{_RUN}]{{16,}}+={{0,2}}"
#: Names in any case, with an optional scheme (Authorization: Bearer ...) before the value; the first lookbehind only spares the second one most places.
_NAMED = "token|secret|password|passwd|pwd|key|private|credentials?|auth|bearer|authorization"
_SCHEME = "(?:bearer|basic|digest|token)"
ASSIGNED = (
    rf"(?<=[=:\"' \t])(?<=(?i:(?:{_NAMED})[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?(?:{_SCHEME}[ \t]{{1,3}})?|(?<![a-z])bearer[ \t]{{1,3}}[\"']?))"
    rf"(?!(?i:{_SCHEME})[ \t])[^\s\"']{{6,}}|" + RUN
)
#: Without one of these (in lower case) there is no assigned value, and the dearer pattern is not run.
NAMES = ("passw", "pwd", "secret", "token", "key", "private", "credential", "auth", "bearer")


#: Words that make a candidate readable, that announce a secret, that announce something else.
DICTIONARY = "example test sample placeholder changeme your dummy image photo file page index user name data value default none null true false version release http https www com org html content article the and for with this that from password secret token key abc".split()
ANNOUNCE = "token secret password passwd pwd apikey api_key api-key access_key private credential credentials auth bearer authorization".split()
DENY = "commit sha sha1 sha256 md5 hash checksum digest uuid guid id card phone call order invoice isbn build revision etag session page ref number account fingerprint blob".split()
MASK = "[SECRET]"
#: Code points beside a candidate that the patterns for names, signs and quotes read: more than any of them can reach but through blanks. The word that a
#: candidate ends (a path, an address) is read to its begin.
BEFORE, AFTER = 60, 20
TREES, DEPTH, LEAST = 25, 6, 3

FEATURES = {
    "length": "cast(length({c}) as double)",
    "transitions": r"regexp_count({c}, '(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]') / cast(length({c}) as double)",
    "digits": "regexp_count({c}, '[0-9]') / cast(length({c}) as double)",
    "upper": "regexp_count({c}, '[A-Z]') / cast(length({c}) as double)",
    "hexadecimal": "cast({c} rlike '^[0-9a-f]+$' as int) + 0.0D",
    "distinct": "size(array_distinct(split({c}, ''))) / cast(least(length({c}), 40) as double)",
    "coverage": f"(length({{c}}) - length(regexp_replace({{c}}, '(?i){'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', ''))) / cast(length({{c}}) as double)",
    "path": r"regexp_count({c}, '[/.]') + 5.0D * cast({w} rlike '[/.]' as int)",
    "grouped": r"cast({c} rlike '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-' as int) + 0.0D",
    "header": "cast({c} like '-----BEGIN%' as int) + 0.0D",
    "prefix": r"cast({c} rlike '^(AKIA|ASIA|gh[pousr]_|sk-|sk_live|xox[abpr]-|AIza|eyJ|glpat-)' as int) + 0.0D",
    "announced": rf"cast({{b}} rlike '(?i)(^|[^a-z])({'|'.join(ANNOUNCE)})[^a-z0-9]{{{{0,6}}}}$' as int) + 0.0D",
    "assigned": r"cast({b} rlike '[=:][ \t]*[\"\']?$' as int) + 0.0D",
    "quoted": r"cast({b} rlike '[\"\']$' as int) + cast({a} rlike '^[\"\']' as int) + 0.0D",
    "denied": rf"cast({{b}} rlike '(?i)(^|[^a-z0-9])({'|'.join(DENY)})[^a-z0-9]{{{{0,6}}}}$' as int) + 0.0D",
}


def features(c: str, before: str, after: str) -> list[str]:
    """SQL of each feature over the SQL of a candidate and of all that stands before and after it, up to the next candidates."""
    near = {"b": f"right({before}, {BEFORE})", "a": f"left({after}, {AFTER})", "w": rf"substring_index(translate({before}, '\n\r\t', '   '), ' ', -1)"}
    return [v.format(c=c, **near) for v in FEATURES.values()]


def labelled_findings(seed: int = 11, each: int = 16) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label): secrets and look-alikes, by rule."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, every = dig + "abcdef", low + up + dig
    word = lambda: "".join(r.choice(("er", "on", "th", "an", "in", "ou", "re", "ti", "la", "de")) for _ in range(r.randint(1, 4)))
    lead = lambda: " ".join(word() for _ in range(r.randint(0, 5))) + r.choice([" ", "\n", ". ", " | "])
    out = []
    for _ in range(each):
        for name in ("token", "secret", "api_key", "access_key", "password", "auth", "apikey", "credential"):
            sign, q = r.choice([" = ", ": ", "=", ":"]), r.choice(['"', "'", ""])
            name = r.choice([name, name.upper(), "client_" + name, "my." + name])
            for value in (pick(hexa, r.choice([32, 40, 64])), pick(every, r.randint(20, 44)), pick(every + "+/", 40)):
                out.append((lead() + name + sign + q, value, q + r.choice([" ", "\n", ""]) + word(), 1))
        for value in ("AKIA" + pick(up + dig, 16), "ghp_" + pick(every, 36), "sk-" + pick(every, 40), "AIza" + pick(every + "-_", 35), "glpat-" + pick(every, 20), "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"):
            out.append((lead(), value, r.choice([" ", "\n", '"']), 1))
        kind = r.choice(["", "RSA ", "EC ", "ENCRYPTED "])
        body = "\n".join(pick(every + "+/", 64) for _ in range(r.randint(2, 26))) + "\n" + pick(every + "+/", r.randint(32, 63)) + "="
        out.append((lead(), f"-----BEGIN {kind}PRIVATE KEY-----\n{body}" + r.choice([f"\n-----END {kind}PRIVATE KEY-----", ""]), r.choice(["\n", '"']) + word(), 1))
        out.append((lead() + r.choice(["password", "passwd", "pwd"]) + r.choice([" = ", ": ", "="]) + '"', pick(low, 5) + pick(dig, 3) + pick("!#%&", 1) + pick(up, 2), '"', 1))
        for _ in range(4):
            out.append((lead(), pick(dig, r.choice([16, 16, 17, 20])), " " + word(), 0))
            out.append((lead() + r.choice(["commit ", "sha1: ", "sha256:", "md5 = ", "checksum: ", "digest ", "blob ", "hash="]), pick(hexa, r.choice([32, 40, 64])), r.choice([" ", "\n"]) + word(), 0))
            out.append((lead(), pick(hexa, r.choice([32, 40])), " " + word(), 0))
            out.append((lead() + r.choice(["", "id=", "uuid: "]), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), " ", 0))
            out.append((lead() + r.choice(["https://", "/", "www."]), "/".join([word() + pick(dig, 2), word(), word() + pick(dig, 3), word()]), r.choice([".html", " ", "?"]), 0))
            out.append((lead() + r.choice(["token = ", "password: ", "api_key="]) + '"', r.choice(["your_token_here_1", "example-password", "changeme123", "test_api_key_value", "placeholder_000000", "xxxxxxxxxxxxxxxx1", "00000000000000000000"]), '"', 0))
            out.append((lead() + r.choice(["token: ", "key: ", "secret: ", "password: "]), word() + word() + r.choice(["", ".", ","]), " " + word(), 0))
            out.append((lead() + r.choice(["order ", "invoice: ", "card ", "phone ", "isbn "]), pick(dig, r.choice([16, 18])), " ", 0))
            out.append((lead(), "_".join([word(), word(), word(), str(r.randrange(99)), word()]), " ", 0))
            out.append((lead(), word() + word() + word() + word() + str(r.randrange(10)), " ", 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree as nested tuples (feature, threshold, low, high), or a share of ones."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAST or share in (0.0, 1.0):
        return share
    best = (1e-9, None, None)
    for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        v = np.unique(x[:, f])
        for t in ((v[1:] + v[:-1]) / 2)[:: max(1, len(v) // 24)]:
            left = x[:, f] <= t
            n = int(left.sum())
            if LEAST <= n <= len(y) - LEAST:
                p, q = y[left].mean(), y[~left].mean()
                gain = share * (1 - share) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if gain > best[0]:
                    best = (gain, int(f), float(t))
    if best[1] is None:
        return share
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], y[left], rng, depth - 1), _grow(x[~left], y[~left], rng, depth - 1)


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(TREES):
        some = rng.integers(0, len(y), len(y))
        out.append(_grow(x[some], y[some], rng, DEPTH))
    return out


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    def one(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([sum(one(t, row) for t in trees) / len(trees) for row in x])


def forest_sql(trees: list, f: str) -> str:
    """The forest over the SQL of an array of features."""

    def one(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        return f"if({f}[{tree[0]}] <= {tree[1]!r}D, {one(tree[2])}, {one(tree[3])})"

    return "(" + " + ".join(map(one, trees)) + f") / {len(trees)}"


def forest(spark: SparkSession) -> list:
    """The forest trained on labelled_findings(), with features computed by the same SQL as in a scan."""
    rows = labelled_findings()
    # rows from a literal: createDataFrame would start Python workers for them
    lines = F.from_json(F.lit(json.dumps([dict(zip("bcay", r, strict=True)) for r in rows])), "array<struct<b: string, c: string, a: string, y: int>>")
    df = spark.range(0, 1, 1, 1).select(F.explode(lines).alias("r")).select("r.*")
    got = df.select(F.expr(f"array({', '.join(features('c', 'b', 'a'))})").alias("f"), "y").collect()  # as many rows as labelled
    return train(np.array([r.f for r in got]), np.array([r.y for r in got], float))


def scored(docs: DataFrame, trees: list) -> DataFrame:
    """docs with arrays _gaps (the text between candidates), _found (candidates) and _score (probability of each); null where there is no candidate."""
    low, named = F.lower("text"), F.lit(False)
    for n in NAMES:
        named = named | F.contains(low, F.lit(n))
    found = once(docs.withColumn("_named", named), "_named")
    named = F.col("_named")
    found = found.withColumn("_found", F.when(named, F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))))
    found = found.withColumn("_found", F.when(F.size("_found") > 0, F.col("_found")))
    found = once(found, "_found")
    found = once(found.withColumn("_gaps", F.when(F.col("_found").isNotNull(), F.when(named, F.split("text", ASSIGNED, -1)).otherwise(F.split("text", RUN, -1)))), "_gaps")
    each = f"transform(sequence(0, size(_found) - 1), i -> array({', '.join(features('_found[i]', '_gaps[i]', '_gaps[i + 1]'))}))"
    found = once(found.withColumn("_features", F.when(F.col("_found").isNotNull(), F.expr(each))), "_features")
    return once(found.withColumn("_score", F.expr(f"transform(_features, f -> {forest_sql(trees, 'f')})")), "_score").drop("_features", "_named")


def findings(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text, others ignored) to one row a secret: doc_id, start (code points from 0), length, secret, score.

    Null and empty texts have none. Whole texts are read, whatever their length; candidates do not overlap, the leftmost begins first. Repeated rows give
    repeated findings; a null doc_id stays null; other columns do not matter. An empty table gives an empty result.
    """
    out = scored(docs.select("doc_id", "text"), forest(docs.sparkSession))
    start = "aggregate(slice(_gaps, 1, i + 1), 0L, (s, g) -> s + length(g)) + aggregate(slice(_found, 1, i), 0L, (s, g) -> s + length(g))"
    each = F.expr(f"if(_score is null, null, transform(filter(sequence(0, size(_found) - 1), i -> _score[i] >= {threshold}D), i -> struct({start} as start, length(_found[i]) as length, _found[i] as secret, _score[i] as score)))")
    out = once(out.select("doc_id", each.alias("each")), "each")
    return out.select("doc_id", F.explode("each").alias("x")).select("doc_id", "x.start", F.col("x.length").cast("long").alias("length"), "x.secret", "x.score")


def masked(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every secret in `text` replaced by MASK and n_chars set to the new length (where it changed); columns are those of docs.

    Null and empty texts stay as they are, repeated rows stay repeated, an empty table stays empty. Other columns, of any name and type, are carried along.
    """
    slim, back = apart(docs, "text", "n_chars")
    out = scored(slim, forest(docs.sparkSession))
    text: Column = F.expr(f"concat(array_join(transform(_found, (c, i) -> concat(_gaps[i], if(_score[i] >= {threshold}D, '{MASK}', c))), ''), element_at(_gaps, -1))")
    hit = F.coalesce(F.expr(f"exists(_score, s -> s >= {threshold}D)"), F.lit(False))
    out = once(out.withColumn("_new", F.when(hit, text)), "_new")
    hit, text = F.col("_new").isNotNull(), F.col("_new")
    new = {"text": F.when(hit, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return back(out.withColumns(new))
