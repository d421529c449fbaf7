"""Shared pieces of the training-data operators: inputs, lineage cuts and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carecolumns.shipping import ship
from carecolumns.storage import cut, release, remove, shared_folder, write  # noqa: F401  (the operators take them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns `own`, as far as it has them, and all others in one struct, so that an operator's names meet none of theirs; and what gives the columns of docs back
    from rows that hold both, with further columns behind them."""
    mine = [c for c in docs.columns if c in own]
    others = [c for c in docs.columns if c not in own]
    held = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []

    def back(df: DataFrame, *more: str) -> DataFrame:
        """The columns of docs that `more` does not name, in their order, then `more`."""
        return df.select(*[F.col(f"`{c}`") if c in mine else F.col(f"others.`{c}`").alias(c) for c in docs.columns if c not in more], *more)

    return docs.select(*mine, *held), back


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that batches of long texts fit in a Python worker and those of short rows stay large; see that workers have this package."""
    ship(spark)
    for k, v in (("maxBytesPerBatch", "1m"), ("maxRecordsPerBatch", "20000")):
        if spark.conf.get(f"spark.sql.execution.arrow.{k}") != v:
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)


#: What this Python worker keeps from task to task, by the operator that it serves.
_kept: dict[tuple[str, str], object] = {}


def kept_for(operator: str, what: str = "", make: Callable[[], object] | None = None):
    """What `make` gives, kept in a Python worker for later tasks of the operator. Workers serve many stages: tasks of another operator let it go."""
    if others := [k for k in _kept if k[0] != operator]:
        for k in others:
            del _kept[k]
        pa.default_memory_pool().release_unused()
    if make is not None and (operator, what) not in _kept:
        _kept[operator, what] = make()
    return _kept.get((operator, what))


#: Ids up to this number (some 30 MB) are sent to every executor; more are joined by a shuffle.
FEW_IDS = 1_000_000


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """df with (left_semi) or without (left_anti) the ids; wide rows are not shuffled while the counted ids are few."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, column, how)


def as_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def pieces(b: pa.RecordBatch, column: str, most: int = 600_000) -> Iterator[pa.RecordBatch]:
    """Slices of b whose texts hold about `most` bytes; a longer text is a slice of its own."""
    offsets = arrow_offsets(b.column(b.schema.get_field_index(column)))
    begin = 0
    for end in range(1, b.num_rows + 1):
        if end == b.num_rows or offsets[end + 1] - offsets[begin] > most:
            yield b.slice(begin, end - begin)
            begin = end


def arrow_offsets(arr: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
