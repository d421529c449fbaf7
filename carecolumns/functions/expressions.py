"""The expression language of specifications, compiled to columns.

Expressions are parsed by Python's own parser after the script spellings &&, || and ! are replaced, checked against a whitelist, and turned into a Value: a
typed column with an error flag. Nothing is evaluated on the driver, and no expression text reaches the SQL parser.
"""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from carecolumns.functions.normal import normal_cdf
from carecolumns.functions.values import BOOL, MIXED, NUM, STR, Value, boolean, choose, no_error, number, python_round, text, undefined


class ExpressionError(ValueError):
    """An expression that the language does not allow."""


#: Names that an expression may use without an input of that name. Flags are what scripts left behind.
CONSTANTS = {"pi": math.pi, "e": math.e, "PI": math.pi, "E": math.e, "doCalc": 1.0, "retval": 0.0}
#: Unit factors.
FACTORS = {"lbs_to_kg": 0.45359237, "kg_to_lbs": 1 / 0.45359237, "in_to_cm": 2.54, "cm_to_in": 1 / 2.54, "mL_to_tsp": 1 / 4.92892159375, "tsp_to_mL": 4.92892159375}
_SPELLINGS = [(re.compile(r"&&"), " and "), (re.compile(r"\|\|"), " or "), (re.compile(r"!(?!=)"), " not ")]
_TEXTS = re.compile(r"'[^']*'|\"[^\"]*\"")


def normalise(source: str) -> str:
    """Script operators as words, outside of texts. `!x` binds to what follows at once, as in `!a == b`."""
    out, at = [], 0

    def swap(part: str) -> str:
        part = _SPELLINGS[0][0].sub(_SPELLINGS[0][1], part)
        part = _SPELLINGS[1][0].sub(_SPELLINGS[1][1], part)
        return _tight_not(part)

    for m in _TEXTS.finditer(source):
        out += [swap(source[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, swap(source[at:])]).strip()


def _tight_not(part: str) -> str:
    m = re.search(r"!(?!=)\s*", part)
    if not m:
        return part
    rest, depth, end = part[m.end() :], 0, 0
    for end, c in enumerate(rest):
        depth += c in "(["
        depth -= c in ")]"
        if depth < 0 or (depth == 0 and not (c.isalnum() or c in "_.()[]!")):
            break
        if depth == 0 and c in ")]":
            end += 1
            break
    else:
        end = len(rest)
    return part[: m.start()] + "(not " + _tight_not(rest[:end]) + ")" + _tight_not(rest[end:])


_OPERATORS = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.Mod)
_COMPARISONS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def parse(source: str) -> ast.expr:
    try:
        tree = ast.parse(normalise(source), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise ExpressionError(f"cannot be read: {source!r}") from e
    _check(tree, source)
    return tree


def _check(node: ast.AST, source: str) -> None:
    def fail(what: str) -> None:
        raise ExpressionError(f"{what} in {source!r}")

    match node:
        case ast.Constant(value=v):
            if not isinstance(v, (bool, int, float, str)):
                fail("a literal of another type")
            return
        case ast.Name():
            return
        case ast.BinOp(op=op) if isinstance(op, _OPERATORS):
            pass
        case ast.UnaryOp(op=ast.USub() | ast.UAdd() | ast.Not()):
            pass
        case ast.BoolOp() | ast.IfExp():
            pass
        case ast.Compare(ops=ops) if all(type(o) in _COMPARISONS for o in ops):
            pass
        case ast.Call(func=ast.Name(id=f), keywords=[]):
            if f not in FUNCTIONS:
                fail(f"unknown function {f}")
            low, high = ARGUMENTS.get(f, (1, 1))
            if not low <= len(node.args) <= high:
                fail(f"{f} with {len(node.args)} arguments")
            for a in node.args:
                _check(a, source)
            return
        case _:
            fail(f"{type(node).__name__} is not allowed")
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.expr):
            _check(child, source)


def free_names(tree: ast.expr) -> set[str]:
    """Names of inputs and steps that an expression needs."""
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called and n.id not in CONSTANTS}


def has_condition(tree: ast.expr) -> bool:
    return any(isinstance(n, ast.IfExp) for n in ast.walk(tree))


def compile_expression(source: str | ast.expr, env: dict[str, Value]) -> Value:
    """The Value of an expression over named Values. Inputs hide constants; a name that is neither is an error in the rows that need it."""
    return _compile(parse(source) if isinstance(source, str) else source, env)


def _compile(node: ast.expr, env: dict[str, Value]) -> Value:
    match node:
        case ast.Constant(value=str() as v):
            return text(v)
        case ast.Constant(value=bool() as v):
            return number(float(v), kind=BOOL)
        case ast.Constant(value=v):
            return number(float(v))
        case ast.Name(id=name):
            if name in env:
                return env[name]
            return number(CONSTANTS[name]) if name in CONSTANTS else undefined()
        case ast.BinOp(left=a, op=op, right=b):
            return _arithmetic(op, _compile(a, env), _compile(b, env))
        case ast.UnaryOp(op=ast.Not(), operand=a):
            v = _compile(a, env)
            return boolean(~v.truth(), v.error)
        case ast.UnaryOp(op=op, operand=a):
            x, error = _compile(a, env).numeric()
            return number(-x if isinstance(op, ast.USub) else x, error)
        case ast.BoolOp(op=op, values=values):
            # every operand is evaluated: a failing one fails the whole
            parts = [_compile(v, env) for v in values]
            truth, error = parts[0].truth(), parts[0].error
            for p in parts[1:]:
                truth = truth & p.truth() if isinstance(op, ast.And) else truth | p.truth()
                error = error | p.error
            return boolean(truth, error)
        case ast.IfExp(test=c, body=a, orelse=b):
            test = _compile(c, env)
            return choose(test.truth(), test.error, _compile(a, env), _compile(b, env))
        case ast.Compare(left=left, ops=ops, comparators=rest):
            values = [_compile(x, env) for x in (left, *rest)]
            truth, error = None, no_error()
            for a, op, b in zip(values, ops, values[1:], strict=False):
                t, e = _compare(_COMPARISONS[type(op)], a, b)
                # later members of a chain are only reached while the earlier ones hold
                error = error | (e if truth is None else truth & e)
                truth = t if truth is None else truth & t
            return boolean(truth, error)
        case ast.Call(func=ast.Name(id="round" | "roundToNumberOfDecimals"), args=[a, digits]):
            return _rounded(_compile(a, env), _digits(digits))
        case ast.Call(func=ast.Name(id=f), args=args):
            return FUNCTIONS[f](*(_compile(a, env) for a in args))
    raise ExpressionError(type(node).__name__)


def _arithmetic(op: ast.operator, a: Value, b: Value) -> Value:
    (x, ex), (y, ey) = a.numeric(), b.numeric()
    error = ex | ey
    match op:
        case ast.Add():
            return number(x + y, error)
        case ast.Sub():
            return number(x - y, error)
        case ast.Mult():
            return number(x * y, error)
        case ast.Div():
            return number(F.try_divide(x, y), error | F.coalesce(y == 0, F.lit(False)))
        case ast.Mod():
            # the result takes the divisor's sign
            whole = F.floor(F.try_divide(x, y)).cast("double")
            return number(x - y * whole, error | F.coalesce(y == 0, F.lit(False)))
        case _:
            return _power(a, b)


def _compare(op: str, a: Value, b: Value) -> tuple[Column, Column]:
    error = a.error | b.error
    do = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    off = F.lit(op == "!=")
    if a.kind in (NUM, BOOL) and b.kind in (NUM, BOOL):
        # NaN compares like in Python: equal to nothing
        nan = F.isnan(a.num) | F.isnan(b.num)
        return F.when(nan, off).otherwise(F.coalesce(do(a.num, b.num), F.lit(False))), error
    if a.kind == STR and b.kind == STR:
        return F.coalesce(do(a.str, b.str), F.lit(False)), error
    both_numbers, both_texts = a.num.isNotNull() & b.num.isNotNull(), a.str.isNotNull() & b.str.isNotNull()
    result = F.when(both_numbers, do(a.num, b.num)).when(both_texts, do(a.str, b.str)).otherwise(off)
    # text and number are unequal, and cannot be ordered
    return F.coalesce(result, F.lit(False)), error if op in ("==", "!=") else error | ~(both_numbers | both_texts)


def _unary(make, bad=None):
    def run(v: Value) -> Value:
        x, error = v.numeric()
        return number(make(x), error if bad is None else error | F.coalesce(bad(x), F.lit(False)))

    return run


def _power(a: Value, b: Value) -> Value:
    (x, ex), (y, ey) = a.numeric(), b.numeric()
    bad = ((x == 0) & (y < 0)) | ((x < 0) & (y != F.floor(y).cast("double")))
    out = F.pow(x, y)
    return number(out, ex | ey | F.coalesce(bad | (F.abs(out) == float("inf")) & (F.abs(x) != float("inf")), F.lit(False)))


def _extreme(pick):
    def run(*values: Value) -> Value:
        parts = [v.numeric() for v in values]
        error = parts[0][1]
        for _, e in parts[1:]:
            error = error | e
        xs = [x for x, _ in parts]
        return number(pick(*xs) if len(xs) > 1 else xs[0], error)

    return run


def _rounded(v: Value, digits: int | None = None) -> Value:
    x, error = v.numeric()
    endless = F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
    return number(python_round(x, digits or 0), error | endless if digits is None else error)


def _digits(node: ast.expr) -> int:
    """A number of digits, which must be written out."""
    sign = -1 if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) else 1
    node = node.operand if sign < 0 else node
    if not isinstance(node, ast.Constant) or not isinstance(node.value, (int, float)):
        raise ExpressionError("round needs a literal number of digits")
    return sign * int(node.value)


def _steps(step: float):
    return _unary(lambda x: F.rint(x / float(step)) * float(step))


def _percentile(v: Value) -> Value:
    x, error = v.numeric()
    return number(normal_cdf(x) * 100.0, error)


FUNCTIONS = {
    "exp": _unary(F.exp, lambda x: x > 709.782712893384),
    "ln": _unary(lambda x: F.log(F.when(x > 0, x)), lambda x: x <= 0),
    "log": _unary(lambda x: F.log(F.when(x > 0, x)), lambda x: x <= 0),
    "log10": _unary(lambda x: F.log10(F.when(x > 0, x)), lambda x: x <= 0),
    "sqrt": _unary(lambda x: F.sqrt(F.when(x >= 0, x)), lambda x: x < 0),
    "pow": _power,
    "abs": _unary(F.abs),
    "min": _extreme(F.least),
    "max": _extreme(F.greatest),
    "round": _rounded,
    "roundToNumberOfDecimals": _rounded,
    "floor": _unary(lambda x: F.floor(x).cast("double")),
    "ceil": _unary(lambda x: F.ceil(x).cast("double")),
    "sin": _unary(F.sin), "cos": _unary(F.cos), "tan": _unary(F.tan), "atan": _unary(F.atan),
    "roundToNearest5": _steps(5), "roundToNearest10": _steps(10), "roundToNearest25": _steps(25), "roundToNearest50": _steps(50), "roundToNearest100": _steps(100),
    "z_to_percentile": _percentile, "ZtoPercentile": _percentile,
    "getOutputUnit": lambda *_: number(1.0),
    **{name: _unary(lambda x, f=f: x * f) for name, f in FACTORS.items()},
}
ARGUMENTS = {"pow": (2, 2), "min": (1, 99), "max": (1, 99), "round": (1, 2), "roundToNumberOfDecimals": (1, 2), "getOutputUnit": (0, 99)}
