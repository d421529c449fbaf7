"""Document fingerprints by locally consistent parsing.

Level 0 is the text's code points. At each level runs of equal symbols become one symbol, then deterministic coin tossing gives each symbol a label from its own
name and its left neighbour's (the lowest bit in which they differ, and its value; three rounds leave labels under 8), and a phrase begins at every local
maximum of the labels. A phrase's name is a hash of its symbols. A cut depends on a few symbols around it only, so equal substrings get
equal phrases inside, wherever they stand. A fingerprint is a one-permutation MinHash of SLOTS values over the names of levels 2 and 3 (some
9 and 25 code points each); a text shorter than that is one phrase of its own.

Each pair of neighbours by descending doc_id is met in one task: texts are dealt once, by ranges of doc_id, and each range also gets the first
text of the next one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import batch, small_batches
from carecolumns.llm.words import mix

U = np.uint64
SLOTS, LEVELS, KEPT = 64, 3, (2, 3)
#: Code points that are parsed at a time (texts are not split).
AT_ONCE = 400_000
_PLACES = mix(np.arange(1, 4097, dtype=np.uint64))


def _segment_names(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A name for each segment x[begin[i]:begin[i + 1]]: a sum of mixed symbols by place, mixed again."""
    at = np.zeros(len(x), np.int64)
    at[begin] = begin
    at = np.arange(len(x)) - np.maximum.accumulate(at)
    weight = _PLACES[np.minimum(at, 4095)] + (at >> 12).astype(np.uint64) * U(0x9E3779B97F4A7C15)
    return mix(np.add.reduceat(mix(x ^ weight) * (weight | U(1)), begin) + U(1))


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    low = x & (~x + U(1))
    return (np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint64)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A round of coin tossing. Symbols differ from their left neighbour; the first of a text meets a fixed one."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ U(1)
    k = _lowest_bit(x ^ left)
    return (k << U(1)) | ((x >> k) & U(1))


def _level(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level and their texts."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(x))).astype(np.uint64)
    x, doc = mix(x[begin] + length * U(0xC2B2AE3D27D4EB4F)), doc[begin]
    first = np.ones(len(x), bool)
    first[1:] = doc[1:] != doc[:-1]
    label = x
    for _ in range(3):
        label = _toss(label, first)
    up, down = np.ones(len(x), bool), np.ones(len(x), bool)
    rise = label[1:] > label[:-1]
    up[1:], down[:-1] = rise | first[1:], ~rise & (label[1:] != label[:-1]) | first[1:]
    # a maximum begins a phrase, unless it is a text's last symbol
    peak = up & down & ~first
    last = np.ones(len(x), bool)
    last[:-1] = first[1:]
    begin = np.flatnonzero(first | peak & ~last)
    return _segment_names(x, begin), doc[begin]


def fingerprints(texts: list[str]) -> list[str]:
    """SLOTS values of 4 hexadecimal digits for each text. An empty text has 0 in all."""
    out: list[str] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
            size += len(texts[end])
            end += 1
        out += _fingerprints(texts[at:end])
        at = end
    return out


def _fingerprints(texts: list[str]) -> list[str]:
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    slots = np.full(n * SLOTS, 2**64 - 1, np.uint64)
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    if len(x):
        for level in range(1, LEVELS + 1):
            x, doc = _level(x, doc)
            if level in KEPT:
                name = mix(x + U(level))
                np.minimum.at(slots, doc * SLOTS + (name % U(SLOTS)).astype(np.int64), name >> U(6))
    slots = slots.reshape(n, SLOTS)
    empty = slots == U(2**64 - 1)
    # an empty slot takes over the next filled one to its right, told apart by the distance
    value = mix(slots)
    some = ~empty.all(1)
    rows = np.flatnonzero(some & empty.any(1))
    if len(rows):
        filled = np.where(empty[rows], 2 * SLOTS, np.arange(SLOTS))
        wide = np.concatenate((filled, filled + SLOTS), 1)
        to = np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1][:, :SLOTS]
        value[rows] = mix(np.take_along_axis(slots[rows], to % SLOTS, 1) + (to - np.arange(SLOTS)).astype(np.uint64))
    code = (value & U(0xFFFF)).astype(">u2")
    code[~some] = 0
    return [row.tobytes().hex() for row in code]


def likeness(a: str, b: str) -> float:
    """The share of slots in which two fingerprints agree."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint16), np.frombuffer(bytes.fromhex(b), np.uint16)
    return float((x == y).mean())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ahead, doc_id, text) by part and place: each text with the one after it. Rows with `ahead` only close a part."""
    held: list[tuple] = []

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows) - 1, 300):
            some = rows[k : k + 301]
            texts = [r[3] for r in some]
            pairs = [i for i in range(len(some) - 1) if not some[i][1] and some[i][0] == some[i + 1][0]]
            edited = []
            for i in pairs:
                t, n = texts[i], len(texts[i]) // 3
                edited.append(t[: len(t) - n] + texts[i + 1][:n] if n else t)
            own, new = fingerprints(texts), fingerprints(edited)
            yield batch(
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                pa.array([some[i][2] for i in pairs], pa.int64()), np.array([len(texts[i]) for i in pairs], np.int64), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([own[i] for i in pairs], pa.string()), pa.array(new, pa.string()), np.array([likeness(own[i], e) for i, e in zip(pairs, new, strict=True)], float), np.array([likeness(own[i], own[i + 1]) for i in pairs], float),
            )

    for b in batches:
        held += zip(*(c.to_pylist() for c in b.columns), strict=True)
        if len(held) > 1:
            yield from out(held)
            held = held[-1:]


#: Bytes of text in a range, and the most ranges (a range is streamed and may be larger).
RANGE_BYTES, MOST_RANGES = 64_000_000, 10_000
_LEAST = -(2**63)


def _place(bounds: list[tuple[int, int]], low: int = 0) -> Column:
    """The number of bounds (turned key, hash) at or before a row: a search tree of comparisons, whose depth is the logarithm of their number."""
    if not bounds:
        return F.lit(low)
    k = len(bounds) // 2
    turned, h = bounds[k]
    reached = (F.col("turned") > turned) | ((F.col("turned") == turned) & (F.col("hash") >= h)) if h > _LEAST else F.col("turned") >= turned
    return F.when(reached, _place(bounds[k + 1 :], low + k + 1)).otherwise(_place(bounds[:k], low))


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Bounds of ranges of like size in the order of (turned key, hash). Only sketches of the keys are gathered, and of the texts' hashes where one key spans ranges."""
    if parts < 2:
        return []
    cuts = rows.agg(F.percentile_approx("turned", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(100_000)).alias("q")).first().q or []
    often = {t: n + 1 for t, n in Counter(cuts).items() if n > 1}
    out = [(t, _LEAST) for t in set(cuts)]
    if often:
        most = max(often.values())
        for r in rows.where(F.col("turned").isin(*often)).groupBy("turned").agg(F.percentile_approx("hash", F.array(*[F.lit(k / most) for k in range(1, most)]), F.lit(10_000)).alias("q")).collect():  # a row a range at most
            out += [(r.turned, h) for h in set(r.q)]
    return sorted(set(out))


def fingerprint_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs (doc_id long, text string, others ignored) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id; after the last comes the first. Null texts are empty. Rows of one id, and the rows without an id, which
    come after all others, stand by a hash of their text, then by the text, so large groups of them are dealt over many ranges as well (all but rows that are
    equal as a whole). A single row is its own next. Texts of any length are parsed whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    # ids in descending order are these numbers in ascending order
    turned = F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(_LEAST)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"turned": turned, "hash": F.xxhash64("text")})
    if not parts:
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES)))
    rows = rows.withColumn("part", _place(_bounds(rows, parts)))
    first = {r.part: (r.at.turned, r.at.hash) for r in rows.groupBy("part").agg(F.min(F.struct("turned", "hash")).alias("at")).collect()}  # a row a range
    if not first:
        return spark.createDataFrame([], schema)
    # the first text of each range closes the range before it, that of the first range the last
    used = sorted(first)
    before = {p: used[k - 1] for k, p in enumerate(used)}
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("part"))
    every = range(used[-1] + 1)
    head = (F.col("turned") == at([first.get(p, (0, 0))[0] for p in every])) & (F.col("hash") == at([first.get(p, (0, 0))[1] for p in every]))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    rows = rows.withColumn("to", F.when(head, F.array(own, F.struct(at([before.get(p, 0) for p in every]).alias("part"), F.lit(True).alias("ahead")))).otherwise(F.array(own)))
    dealt = rows.select(F.explode("to").alias("to"), "turned", "hash", "doc_id", "text").select("to.part", "to.ahead", "turned", "hash", "doc_id", "text")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", "turned", "hash", "text")
    return dealt.select("part", "ahead", "doc_id", "text").mapInArrow(_compare, schema)
