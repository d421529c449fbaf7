"""Two specifications on the same random vectors: what they compute, compared output by output within a tolerance, failures as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.operators import evaluation


def uniform(row: Column, name: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the row's number, a name and a seed alone: any engine that has MD5 draws the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), row.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def vectors(turns: DataFrame, turn: str, spec: dict, seed: int = 7) -> DataFrame:
    """(turn, fields): a random vector inside the bounds of a specification's inputs, to 4 places, for each row. Bounds that are missing are 1 and 100 more; options are drawn evenly."""
    new = []
    for f in spec.get("inputs") or []:
        u, c = uniform(F.col(turn), f["key"], seed), f.get("constraints") or {}
        options = f.get("options") or []
        if options and not f.get("options_incomplete"):
            new.append(F.get(F.array(*[F.lit(str(o["value"])) for o in options]), F.floor(u * len(options)).cast("int")).alias(f["key"]))
            continue
        low = float(c.get("min", c.get("exclusive_min", 1.0)))
        high = float(c.get("max", c.get("exclusive_max", max(low + 100, 100.0))))
        low = max(low, 1e-3) if low <= 0 < high else low  # divisors stay away from zero
        new.append(F.round(F.lit(low) + F.lit(high - low) * u, 4).alias(f["key"]))
    return turns.select(F.col(turn).alias("turn"), *new)


def differences(inputs: DataFrame, built: dict, published: dict, outputs: dict[str, str], tolerance: float = 1e-6) -> DataFrame:
    """inputs (turn, fields of both) to a row a vector and output pair: turn, output, built, published, status: agree, differ, or which of both has no value (built fails, published fails, both fail).

    Numbers agree within the tolerance times the larger of them and 1. Both are evaluated side by side over the same rows, without a join.
    """
    columns = [f"`{c}`" for c in inputs.columns]
    first = evaluation.formula(inputs, built).select(*columns, F.struct(*[F.col(f"outputs.`{k}`.value").alias(k) for k in outputs]).alias("__built"))
    second = evaluation.formula(first, published).select("turn", "__built", F.struct(*[F.col(f"outputs.`{k}`.value").alias(k) for k in outputs.values()]).alias("__published"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("output"), F.col(f"__built.`{a}`").alias("built"), F.col(f"__published.`{b}`").alias("published")) for a, b in outputs.items()]))
    rows = second.select("turn", pairs.alias("x")).select("turn", "x.*")
    a, b = F.col("built"), F.col("published")
    close = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    status = F.when(a.isNull() & b.isNull(), "both fail").when(a.isNull(), "built fails").when(b.isNull(), "published fails").when(close, "agree").otherwise("differ")
    return rows.withColumn("status", status)


def agreement(compared: DataFrame) -> DataFrame:
    """differences() rows to a row an output: vectors, compared, mismatches, failures of each side, and the share in percent that agrees (null where nothing is compared)."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    rows = compared.groupBy("output").agg(F.count("*").alias("vectors"), count("agree", "differ").alias("compared"), count("differ").alias("mismatches"), count("built fails", "both fail").alias("built_failures"), count("published fails", "both fail").alias("published_failures"))
    return rows.withColumn("agreement", F.when(F.col("compared") > 0, F.round(100.0 * (F.col("compared") - F.col("mismatches")) / F.col("compared"), 4)))
