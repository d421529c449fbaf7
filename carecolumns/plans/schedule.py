"""Compile-time order of a specification's steps and outputs.

Steps come before outputs, in file order, and are tried in passes. One that needs names not yet known waits, unless it is conditional: then it is tried, and rows in
which the taken branch was complete get its value at once, the others when a later pass completes them. A key may be written again by an output. A row in which
any step or output never gets a value has an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecolumns.functions.expressions import compile_expression, free_names, has_condition, parse
from carecolumns.functions.values import MIXED, NUM, STR, Value

#: Passes over conditional expressions that wait for one another.
ROUNDS = 3


class ScheduleError(ValueError):
    """Names that no input, step or output gives."""


@dataclass
class Item:
    key: str
    source: str
    output: bool
    tree: object = field(init=False)

    def __post_init__(self):
        self.tree = parse(self.source)


@dataclass
class Ladders:
    """Reference tables that write the same columns: each is keyed by a value, and may apply to one choice of a selector only."""

    columns: tuple[str, ...]
    tables: list[dict]

    @staticmethod
    def key_of(table: dict, known) -> str | None:
        """The name that a table is keyed by, in any of its spellings."""
        key = table.get("key") or ""
        return next((k for k in (key, key.lower(), key.replace("_", "").lower()) if k in known), None)

    def ready(self, known) -> bool:
        return all(self.key_of(t, known) and (t.get("select_key") is None or t["select_key"] in known) for t in self.tables)

    @staticmethod
    def chosen(table: dict, env: dict[str, Value]) -> Column:
        if table.get("select_key") is None:
            return F.lit(True)
        v, want = env[table["select_key"]], table.get("select_value")
        same = F.abs(v.num - float(want)) < 1e-9 if isinstance(want, (int, float)) else v.str == str(want)
        return F.coalesce(same, F.lit(False))

    def values(self, env: dict[str, Value]) -> tuple[dict[str, Value], Column]:
        """The columns' Values, and whether a table that applies has no row for its value."""
        from carecolumns.operators.tables import ladder_value

        row, outside = F.lit(None).cast("struct<" + ",".join(f"`{c}`:double" for c in self.columns) + ">"), F.lit(False)
        for t in self.tables:
            x, error = env[self.key_of(t, env)].numeric()
            here, found = self.chosen(t, env), ladder_value(x, t["rows"], list(self.columns), t.get("operator") or "<", t.get("fallback"))
            row, outside = F.when(here, F.when(~error, found)).otherwise(row), F.when(here, error | found.isNull()).otherwise(outside)
        return {c: Value(NUM, row[c], None, row.isNull()) for c in self.columns}, outside


@dataclass
class Compiled:
    """The rows with their steps as columns, the Value of every output, and whether any expression failed."""

    df: DataFrame
    env: dict[str, Value]
    outputs: dict[str, Value]
    failed: Column


def _kept(df: DataFrame, name: str, v: Value) -> tuple[DataFrame, Value]:
    """v as columns of df, so that later expressions refer to it and do not repeat it."""
    new = {f"{name}_e": F.coalesce(v.error, F.lit(True))}
    if v.kind != STR:
        new[f"{name}_n"] = v.num
    if v.kind in (STR, MIXED):
        new[f"{name}_s"] = v.str
    df = df.withColumns(new)
    col = lambda suffix: F.col(f"`{name}_{suffix}`")
    return df, Value(v.kind, col("n") if v.kind != STR else None, col("s") if v.kind in (STR, MIXED) else None, col("e"))


def schedule(items: list[Item | Ladders], known: set[str]) -> list[tuple[Item | Ladders, bool]]:
    """The order in which items are evaluated, each with whether names are missing in that pass."""
    order, have, waiting = [], set(known), list(items)
    partial: dict[int, int] = {}
    for _ in range(len(items) + ROUNDS):
        left, moved = [], False
        for item in waiting:
            if isinstance(item, Ladders):
                if item.ready(have):
                    order.append((item, False))
                    have |= set(item.columns)
                    moved = True
                else:
                    left.append(item)
                continue
            names = free_names(item.tree)
            missing = names - {item.key} - have
            tried = partial.get(id(item), 0)
            if not missing and (item.key in have or item.key not in names):
                order.append((item, False))
                have.add(item.key)
                moved = True
            elif has_condition(item.tree):
                # its names are known in some rows only, until it has been tried often enough
                order.append((item, True))
                partial[id(item)] = tried + 1
                if tried + 1 == ROUNDS:
                    have.add(item.key)
                else:
                    left.append(item)
                moved = True
            else:
                left.append(item)
        waiting = left
        if not waiting or not moved:
            break
    never = [i for i in waiting if id(i) not in partial and isinstance(i, Item)]
    if never:
        names = sorted(set().union(*(free_names(i.tree) - {i.key} for i in never)) - have)
        raise ScheduleError(f"never evaluated: {', '.join(i.key for i in never)}" + (f"; unknown names: {', '.join(names)}" if names else ""))
    return order


def run(df: DataFrame, env: dict[str, Value], items: list[Item | Ladders], prefix: str = "__v") -> Compiled:
    """Evaluate items over df. env names the Values of inputs; it is not changed."""
    env, outputs, failed = dict(env), {}, F.lit(False)
    values: dict[int, Value] = {}
    for n, (item, _) in enumerate(schedule(items, set(env))):
        if isinstance(item, Ladders):
            found, outside = item.values(env)
            for k, (name, v) in enumerate(found.items()):
                df, env[name] = _kept(df, f"{prefix}{n}_{k}", v)
            failed = failed | outside
            continue
        v = compile_expression(item.tree, env)
        if id(item) in values:
            # rows that an earlier pass completed keep their value
            first = values[id(item)]
            kind = first.kind if first.kind == v.kind else NUM if STR not in (first.kind, v.kind) and MIXED not in (first.kind, v.kind) else MIXED
            v = Value(kind, F.when(first.error, v.num).otherwise(first.num) if kind != STR else None, F.when(first.error, v.str).otherwise(first.str) if kind in (STR, MIXED) else None, first.error & v.error)
        df, v = _kept(df, f"{prefix}{n}", v)
        env[item.key] = values[id(item)] = v
        if item.output:
            outputs[item.key] = v
    for item in items:
        if isinstance(item, Item):
            failed = failed | values[id(item)].error
    return Compiled(df, env, outputs, failed)
