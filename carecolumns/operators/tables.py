"""Lookups in reference tables: ladders, thresholds, dose tables and equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.functions.normal import normal_cdf
from carecolumns.functions.values import python_round

#: Rows of a ladder up to which it is a chain of conditions; longer ones are searched as arrays. Ladders that are tables themselves are joined (asof.py).
CHAIN = 64


def ladder_value(x: Column, rows: list[dict], columns: list[str], operator: str = "<", fallback: dict | None = None) -> Column:
    """The columns (a struct) of the first row with x < threshold (or <=), else of the fallback, else null."""
    pick = lambda r: F.struct(*[F.lit(float(r[c])).alias(c) for c in columns])
    if len(rows) > CHAIN:
        other = pick(fallback) if fallback else F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in columns) + ">")
        return F.when(x.isNotNull() & ~F.isnan(x), F.coalesce(F.get(F.array(*map(pick, rows)), ladder_index(x, rows, operator)), other))
    out = pick(fallback) if fallback else F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in columns) + ">")
    for r in reversed(rows):
        t = F.lit(float(r["threshold"]))
        out = F.when(x <= t if operator == "<=" else x < t, pick(r)).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x), out)


def ladder_index(x: Column, rows: list[dict], operator: str = "<") -> Column:
    """The place (from 0) of the first row with x < threshold (or <=), null if there is none. Rows without a threshold do not count."""
    limits = [(i, float(r["threshold"])) for i, r in enumerate(rows) if r.get("threshold") is not None]
    passed = lambda t: x > t if operator == "<=" else x >= t
    if len(limits) == len(rows) and all(a <= b for (_, a), (_, b) in zip(limits, limits[1:], strict=False)):
        at = F.size(F.filter(F.array(*[F.lit(t) for _, t in limits]), passed))
        out = F.when(at < len(limits), at)
    else:
        out = F.lit(None).cast("int")
        for i, t in reversed(limits):
            out = F.when(~passed(F.lit(t)), i).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x), out)


def lms(x: Column, row: Column) -> tuple[Column, Column]:
    """(z, percentile) of a measurement by a row's l, m, s. l = 0 means the logarithm; measurements of 0 or less have none."""
    pos = F.when(x > 0, x)
    ratio = F.try_divide(pos, row["m"])
    z = F.when(F.abs(row["l"]) < 1e-12, F.try_divide(F.log(ratio), row["s"])).otherwise(F.try_divide(F.pow(ratio, row["l"]) - 1, row["l"] * row["s"]))
    return z, normal_cdf(z) * 100


def between(x: Column, rows: list[dict], at: str, value: str) -> Column:
    """Linear interpolation of `value` over rows ordered by `at`, held beyond both ends."""
    rows = sorted(rows, key=lambda r: r[at])
    out = F.lit(float(rows[-1][value]))
    for a, b in reversed(list(zip(rows, rows[1:], strict=False))):
        share = (x - float(a[at])) / (float(b[at]) - float(a[at]))
        out = F.when(x <= float(b[at]), F.lit(float(a[value])) + share * (float(b[value]) - float(a[value]))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= float(rows[0][at]), F.lit(float(rows[0][value]))).otherwise(out))


def nomogram(df: DataFrame, rows: list[dict], age: str, level: str, risk: Column, lines: tuple[str, ...]) -> DataFrame:
    """df with each line's threshold at the subject's age and `above`: the last line that its level reaches. rows: h, low{line}, high{line}: without and with risk."""
    new = {}
    for line in lines:
        plain = [{"h": r["h"], "v": r["low"][line]} for r in rows]
        risky = [{"h": r["h"], "v": r["high"][line]} for r in rows]
        new[f"threshold_{line}"] = F.when(risk, between(F.col(age), risky, "h", "v")).otherwise(between(F.col(age), plain, "h", "v"))
    out = df.withColumns(new)
    above = F.lit(None).cast("string")
    for line in lines:
        above = F.when(F.col(level) >= F.col(f"threshold_{line}"), F.lit(line)).otherwise(above)
    return out.withColumn("above", above)


def dose_table(df: DataFrame, drugs: list[dict], weight: str = "weight") -> DataFrame:
    """A row for each subject and dose: drug, route, phase, low, high, capped, volume_low, volume_high.

    Doses per kg are multiplied by the weight (missing: 0), capped, and rounded to the dose's decimals (2); the volume is dose / concentration, to 2 places.
    """
    doses = []
    for d in drugs:
        for r in d["routes"]:
            for x in r["doses"]:
                low, high = (x["amt"], x["amt"]) if not isinstance(x["amt"], (list, tuple)) else (x["amt"][0], x["amt"][-1])
                doses.append(F.struct(F.lit(d["name"]).alias("drug"), F.lit(r["label"]).alias("route"), F.lit(r.get("conc")).cast("double").alias("conc"), F.lit(x.get("phase")).cast("string").alias("phase"), F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"), F.lit(bool(x.get("perKg"))).alias("per_kg"), F.lit(x.get("max")).cast("double").alias("most"), F.lit(int(x.get("decimals", 2))).alias("decimals"), F.lit(x.get("unit")).cast("string").alias("unit")))
    rows = df.withColumn("__d", F.explode(F.array(*doses)))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))

    def amount(k: str) -> Column:
        raw = F.when(F.col("__d.per_kg"), F.col(f"__d.{k}") * w).otherwise(F.col(f"__d.{k}"))
        raw = F.when(F.col("__d.most").isNotNull(), F.least(raw, F.col("__d.most"))).otherwise(raw)
        out = python_round(raw, 2)
        for places in (0, 1, 3, 4):
            out = F.when(F.col("__d.decimals") == places, python_round(raw, places)).otherwise(out)
        return out

    rows = rows.withColumns({"low": amount("a"), "high": amount("b")})
    raw_high = F.when(F.col("__d.per_kg"), F.col("__d.b") * w).otherwise(F.col("__d.b"))
    volume = lambda c: python_round(F.try_divide(F.col(c), F.col("__d.conc")), 2)
    return rows.select(*df.columns, "__d.drug", "__d.route", "__d.phase", "low", "high", F.coalesce(raw_high > F.col("__d.most"), F.lit(False)).alias("capped"), volume("low").alias("volume_low"), volume("high").alias("volume_high"), "__d.unit")


#: Morphine equivalents of methadone by daily dose (up to, factor).
METHADONE = ((20.0, 4.0), (40.0, 8.0), (60.0, 10.0), (float("inf"), 12.0))


def equivalents(doses: DataFrame, factors: dict[str, float], key: str = "subject_id") -> DataFrame:
    """doses (key, drug, dose) to (key, total): the sum of dose * factor, methadone by its bands. Drugs without a factor make the total null."""
    f = F.lit(None).cast("double")
    for drug, factor in factors.items():
        f = F.when(F.lower("drug") == drug.lower(), F.lit(float(factor))).otherwise(f)
    banded = F.lit(METHADONE[-1][1])
    for top, factor in reversed(METHADONE[:-1]):
        banded = F.when(F.col("dose") <= top, F.lit(factor)).otherwise(banded)
    part = F.col("dose") * F.when(F.lower("drug") == "methadone", banded).otherwise(f)
    return doses.groupBy(key).agg(F.when(F.count_if(part.isNull() & F.col("dose").isNotNull()) == 0, F.coalesce(F.sum(part), F.lit(0.0))).alias("total"))
