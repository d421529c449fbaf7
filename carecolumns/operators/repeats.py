"""Texts in which a block was drawn twice in a row: the first copy, and what was drawn between the two, is taken out.

A block is LEAST letters or more, white space aside; its copy begins REACH letters behind its beginning at most. Windows of LEAST letters are hashed at every place, equal
hashes are brought together by sorting, and what they point to is compared letter by letter. Each text is worked on as a whole in its own task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from carecolumns.shipping import ship

#: Letters of a block at least, and letters between the beginnings of two copies at most.
LEAST, REACH = 60, 460
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _copies(letters: np.ndarray, least: int, reach: int) -> list[tuple[int, int]]:
    """(begin, begin of the copy) of blocks that stand again within reach, in order, each beginning where the last one's copy does or later."""
    n = len(letters) - least + 1
    if n <= least:
        return []
    up, down = (np.full(len(letters), base, np.uint64) for base in (_BASE, _INVERSE))
    for x in (up, down):
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) * up, out=sums[1:])
    window = (sums[least:] - sums[:n]) * down[:n]
    # places of equal windows stand together, in order
    _, kind = np.unique(window, return_inverse=True)
    key = kind.astype(np.int64) * (len(letters) + 1) + np.arange(n)
    order = np.sort(key)
    at = np.searchsorted(order, key + least)
    there = np.minimum(at, n - 1)
    copy = order[there] - kind.astype(np.int64) * (len(letters) + 1)
    near = np.flatnonzero((at < n) & (copy >= 0) & (copy < n) & (copy - np.arange(n) <= reach))
    out, end = [], 0
    for p in near.tolist():
        q = int(copy[p])
        if p >= end and np.array_equal(letters[p : p + least], letters[q : q + least]):
            out.append((p, q))
            end = q
    return out


def collapsed(text: str | None, least: int = LEAST, reach: int = REACH) -> str | None:
    """The text without first copies, until none is left; null stays null."""
    while text:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = np.flatnonzero(np.array([not c.isspace() for c in text]))
        found = _copies(points[solid], least, reach)
        if not found:
            break
        kept, at = [], 0
        for p, q in found:
            kept.append(text[at : solid[p]])
            at = solid[q]
        text = "".join([*kept, text[at:]])
    return text


def without_repeats(df: DataFrame, column: str, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """df with `column` collapsed and `removed`, the number of code points that went. Null texts stay null (removed 0); texts of any length are read whole; each row stays."""
    ship(df.sparkSession)

    @F.pandas_udf(StringType())
    def collapse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: collapsed(t, least, reach), na_action="ignore")

    c = F.col(f"`{column}`")
    rows = df.withColumn("__new", collapse(c)).withColumn("removed", F.coalesce(F.length(c) - F.length("__new"), F.lit(0)).cast("long"))
    return rows.withColumn(column, F.col("__new")).drop("__new")
