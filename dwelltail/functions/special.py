"""erfc and the normal distribution as Column expressions (Spark SQL has neither)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody, "Rational Chebyshev approximation for the error
# function", Math. Comp. 23 (1969), for |x| <= 0.46875, 0.46875 < |x| <= 4 and |x| > 4.
ERF_NUM = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_DEN = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MID_NUM = (
    5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
    1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
)
MID_DEN = (
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
    4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
)
FAR_NUM = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
FAR_DEN = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)

SQRT2 = math.sqrt(2.0)
SQRT_2PI = math.sqrt(2.0 * math.pi)
INV_SQRT_PI = 1.0 / math.sqrt(math.pi)


def _ratio(x: Column, num: tuple, den: tuple) -> Column:
    """Horner form shared by the three ranges; the last numerator value leads."""
    top, bottom = F.lit(num[-1]) * x, x
    for a, b in zip(num[:-2], den[:-1]):
        top, bottom = (top + F.lit(a)) * x, (bottom + F.lit(b)) * x
    return (top + F.lit(num[-2])) / (bottom + F.lit(den[-1]))


def erfc(x: Column) -> Column:
    """Complementary error function, relative error below 1e-13 where it does not underflow.

    Pass a plain column reference when many rows are scored: ``x`` occurs many times.
    """
    y = F.abs(x)
    coarse = F.floor(y * F.lit(16.0)) / F.lit(16.0)
    decay = F.exp(-coarse * coarse) * F.exp(-(y - coarse) * (y + coarse))
    near = F.lit(1.0) - x * _ratio(y * y, ERF_NUM, ERF_DEN)
    mid = decay * _ratio(y, MID_NUM, MID_DEN)
    inverse = F.lit(1.0) / (y * y)
    far = decay * (F.lit(INV_SQRT_PI) - inverse * _ratio(inverse, FAR_NUM, FAR_DEN)) / y
    outer = F.when(y <= 4.0, mid).when(y < 27.0, far).otherwise(F.lit(0.0))
    # outer for positive x and 2 - outer for negative x, with one copy of the long expression
    mirrored = F.abs(F.when(x > 0, F.lit(0.0)).otherwise(F.lit(2.0)) - outer)
    return F.when(y <= 0.46875, near).otherwise(mirrored)


def normal_pdf(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return F.exp(F.lit(-0.5) * z * z) / (sigma * F.lit(SQRT_2PI))


def normal_log_pdf(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return F.lit(-0.5) * z * z - F.log(sigma) - F.lit(math.log(SQRT_2PI))


def normal_tail(y: Column, mu: Column, sigma: Column) -> Column:
    """P(Y > y); keeps its digits in the far tail."""
    return F.lit(0.5) * erfc((y - mu) / (sigma * F.lit(SQRT2)))


def normal_cdf(y: Column, mu: Column, sigma: Column) -> Column:
    return F.lit(0.5) * erfc((mu - y) / (sigma * F.lit(SQRT2)))


def softplus(x: Column) -> Column:
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))


def softmax(values: Column) -> Column:
    """Softmax of an array column."""
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(raised, lambda v: v / total)


def student_t_pdf(y: Column, loc: Column, scale: Column, dof: int) -> Column:
    """Univariate Student-t density; the gamma ratio is a constant of ``dof``."""
    constant = math.gamma((dof + 1) / 2) / (math.gamma(dof / 2) * math.sqrt(dof * math.pi))
    z = (y - loc) / scale
    return F.lit(constant) / scale * F.pow(1 + z * z / F.lit(float(dof)), F.lit(-(dof + 1) / 2))
