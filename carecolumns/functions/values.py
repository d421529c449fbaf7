"""Typed column values with an error flag: what expressions of specifications compile to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM, BOOL, STR, MIXED = "number", "boolean", "text", "mixed"


@dataclass(frozen=True)
class Value:
    """number (double) and text columns, of which a row has one at most; error tells rows without a value. kind says which can occur."""

    kind: str
    number: Column | None
    text: Column | None
    error: Column

    @property
    def num(self) -> Column:
        return self.number if self.number is not None else F.lit(None).cast("double")

    @property
    def str(self) -> Column:
        return self.text if self.text is not None else F.lit(None).cast("string")

    def numeric(self) -> tuple[Column, Column]:
        """The number, and an error where the row has none."""
        if self.kind in (NUM, BOOL):
            return self.num, self.error
        if self.kind == STR:
            return F.lit(None).cast("double"), F.lit(True)
        return self.num, self.error | self.num.isNull()

    def truth(self) -> Column:
        """Python's truth: numbers other than 0, texts other than the empty one."""
        by_number = F.coalesce(self.num != 0, F.lit(False))
        by_text = F.coalesce(self.str != "", F.lit(False))
        return {NUM: by_number, BOOL: by_number, STR: by_text}.get(self.kind, by_number | by_text)


def no_error() -> Column:
    return F.lit(False)


def number(x: Column | float, error: Column | None = None, kind: str = NUM) -> Value:
    return Value(kind, (x if isinstance(x, Column) else F.lit(float(x))).cast("double"), None, no_error() if error is None else error)


def text(x: Column | str, error: Column | None = None) -> Value:
    return Value(STR, None, x if isinstance(x, Column) else F.lit(x), no_error() if error is None else error)


def boolean(x: Column, error: Column) -> Value:
    return Value(BOOL, F.coalesce(x, F.lit(False)).cast("double"), None, error)


def undefined() -> Value:
    return Value(NUM, F.lit(None).cast("double"), None, F.lit(True))


def choose(condition: Column, condition_error: Column, yes: Value, no: Value) -> Value:
    """Only the taken side can fail."""
    kind = yes.kind if yes.kind == no.kind else NUM if {yes.kind, no.kind} <= {NUM, BOOL} else MIXED
    pick = lambda a, b: F.when(condition, a).otherwise(b)
    return Value(kind, pick(yes.num, no.num) if kind != STR else None, pick(yes.str, no.str) if kind in (STR, MIXED) else None, condition_error | pick(yes.error, no.error))


def python_round(x: Column, digits: int = 0) -> Column:
    """round(x, digits) as Python does: half to even on the exact binary value. Null, NaN and infinities stay."""
    if digits == 0:
        out = F.rint(x)
    elif digits < 0:
        out = F.rint(x / float(10**-digits)) * float(10**-digits)
    else:
        # DecimalFormat rounds the exact value half to even; other ways round the product x * 10**digits
        out = F.call_function("format_number", x, F.lit("0." + "0" * digits)).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) >= 1e15), x).otherwise(out + 0.0)
