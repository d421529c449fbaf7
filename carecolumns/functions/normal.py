"""The normal distribution function in columns: rational approximations of erf and erfc over three ranges, exact to some 1e-15."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients published by W. J. Cody (Rational Chebyshev approximations for the error function, 1969), highest power first.
ERF = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
TAIL = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _ratio(form: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    above, below = (reduce(lambda a, c: a * x + c, p[1:], F.lit(p[0])) for p in form)
    return above / below


def erfc(x: Column) -> Column:
    """1 - erf(x); null and NaN stay."""
    y = F.abs(x)
    z = F.when(y <= 27, y)  # smaller than any double beyond
    near = 1 - x * _ratio(ERF, x * x)
    middle = F.exp(-z * z) * _ratio(MIDDLE, z)
    over = 1 / (z * z)
    tail = F.exp(-z * z) / z * (1 / math.sqrt(math.pi) - over * _ratio(TAIL, over))
    positive = F.when(y <= 4, middle).when(y <= 27, tail).otherwise(0.0)
    return F.when(x.isNull() | F.isnan(x), x).when(y <= 0.46875, near).otherwise(F.when(x < 0, 2 - positive).otherwise(positive))


def normal_cdf(z: Column) -> Column:
    """P(Z <= z)."""
    return 0.5 * erfc(-z / math.sqrt(2))
