"""Canonical units: what a raw value is multiplied by, and what is added then, to have it in the base unit of its dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Dimension, base unit, then codes (lower-case letters, digits and %) of equal scale with factor and offset.
CANONICAL = """
temperature degC: degc degreesc c celsius = 1 0; degf degreesf f fahrenheit = 5/9 -160/9; k kelvin = 1 -273.15
mass kg: kg kilogram kgs = 1 0; g gm gram = 0.001 0; mg = 1e-6 0; mcg = 1e-9 0; lb lbs pound pounds = 0.45359237 0; oz ounce = 0.028349523125 0
length cm: cm centimetre centimeter = 1 0; m meter meters metre = 100 0; kilometre km = 100000 0; mm millimetre = 0.1 0; in inch inches = 2.54 0; ft feet foot = 30.48 0; mile = 160934.4 0
pressure mmHg: mmhg = 1 0; torr = 0.999999857533699 0; pascal pa = 0.00750062 0; kpa = 7.50062 0; cmh2o = 0.735559 0; atm = 760 0
time_age yr: yr year years = 1 0; mo month months = 1/12 0; wk week = 1/52.1775 0; day days = 1/365.25 0
time hr: hr hrs hour hours = 1 0; min minute minutes = 1/60 0; sec seconds = 1/3600 0; day days = 24 0
volume mL: ml millilitre milliliter = 1 0; l litre liter = 1000 0; dl = 100 0; mcl microl = 1e-3 0
fraction fraction: fraction fractiono2 ratio rate = 1 0; % percent %o2 = 0.01 0
ratio ratio: ratio fraction rate = 1 0; % percent = 0.01 0
creatinine mg/dL: mgdl mgpercent = 1 0; mcmoll umoll = 1/88.4 0; mmoll = 1000/88.4 0
cholesterol mg/dL: mgdl = 1 0; mmoll = 1/0.02586 0
bilirubin mg/dL: mgdl = 1 0; mcmoll umoll = 1/17.1 0
"""
#: Codes that pass through as they are, as no physical conversion exists.
PASSED_THROUGH = ("litreso2",)


def _number(s: str) -> float:
    a, _, b = s.partition("/")
    return float(a) / float(b) if b else float(a)


def canonical_rows() -> list[tuple[int, str, str, str, float, float]]:
    """(place of the dimension, dimension, base unit, code, factor, offset)."""
    out = []
    for place, line in enumerate(CANONICAL.strip().splitlines()):
        head, scales = line.split(": ")
        dimension, base = head.split(" ")
        for scale in scales.split("; "):
            codes, value = scale.split(" = ")
            factor, offset = map(_number, value.split(" "))
            out += [(place, dimension, base, c, factor, offset) for c in codes.split(" ")]
    return out


def canonical(spark: SparkSession) -> DataFrame:
    """Some hundred rows, one a dimension and code."""
    return spark.createDataFrame(canonical_rows(), "place int, dimension string, base string, code string, factor double, offset double")
