"""Numeric integrals over per-state grids: rows of (state, grid point) summed per state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.functions.special import student_t_pdf
from dwelltail.operators.sampling import normal, uniform


def on_grid(params: DataFrame, lo: Column, hi: Column, points: int) -> DataFrame:
    """Each parameter row with ``points`` evenly spaced ``y`` and trapezoid weights ``weight``."""
    step = (hi - lo) / F.lit(points - 1)
    placed = params.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    ends = (F.col("_j") == 0) | (F.col("_j") == points - 1)
    return placed.withColumn("y", lo + F.col("_j") * step).withColumn(
        "weight", F.when(ends, step / 2).otherwise(step)
    )


def trapezoid(
    params: DataFrame, keys: list[str], lo: Column, hi: Column, points: int, **integrands: Callable[[Column], Column]
) -> DataFrame:
    """Integrals of functions of y (and of the parameter columns) over [lo, hi] per key."""
    grid = on_grid(params, lo, hi, points)
    return grid.groupBy(*keys).agg(
        *[F.sum(F.col("weight") * f(F.col("y"))).alias(name) for name, f in integrands.items()]
    )


def density_moments(
    params: DataFrame, keys: list[str], pdf: Callable[[Column], Column], lo: Column, hi: Column, points: int
) -> DataFrame:
    """Mean, std, skewness and excess kurtosis of a density from raw moments of one pass."""
    raw = trapezoid(
        params,
        keys,
        lo,
        hi,
        points,
        m1=lambda y: y * pdf(y),
        m2=lambda y: y * y * pdf(y),
        m3=lambda y: y * y * y * pdf(y),
        m4=lambda y: y * y * y * y * pdf(y),
    )
    m1, m2, m3, m4 = (F.col(f"m{i}") for i in range(1, 5))
    variance = m2 - m1 * m1
    third = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return raw.select(
        *keys,
        m1.alias("mean"),
        F.sqrt(variance).alias("std"),
        (third / F.pow(variance, F.lit(1.5))).alias("skewness"),
        (fourth / (variance * variance) - 3).alias("kurtosis"),
    )


def grid_expectation(
    params: DataFrame, keys: list[str], pdf: Callable[[Column], Column], lo: float = 0.1, hi: float = 30.0, width: float = 0.1
) -> DataFrame:
    """Sum of x p(x) width over lo, lo + width, ... below hi."""
    last = int(round((hi - lo) / width)) - 1
    placed = params.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(last))))
    y = F.lit(lo) + F.col("_j") * F.lit(width)
    placed = placed.withColumn("y", y)
    return placed.groupBy(*keys).agg(F.sum(F.col("y") * pdf(F.col("y")) * F.lit(width)).alias("expectation"))


def monte_carlo(
    params: DataFrame,
    keys: list[str],
    loc: Column,
    scale: Column,
    draws: int,
    seed: int,
    dof: int = 6,
    **integrands: Callable[[Column], Column],
) -> DataFrame:
    """Importance-sampled integrals with a Student-t proposal; ``dof`` must be even.

    A chi-square number with 2m degrees is -2 ln of a product of m uniform numbers.
    """
    placed = params.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    parts = [F.col(key) for key in keys] + [F.col("_i")]
    log_product = F.lit(0.0)
    for m in range(dof // 2):
        log_product = log_product + F.log(uniform(seed, *parts, F.lit(f"c{m}")))
    chi2 = F.lit(-2.0) * log_product
    t = normal(seed, *parts) / F.sqrt(chi2 / F.lit(float(dof)))
    drawn = placed.withColumn("_loc", loc).withColumn("_scale", scale)
    drawn = drawn.withColumn("y", F.col("_loc") + F.col("_scale") * t)
    proposal = student_t_pdf(F.col("y"), F.col("_loc"), F.col("_scale"), dof)
    return drawn.groupBy(*keys).agg(
        *[F.avg(f(F.col("y")) / proposal).alias(name) for name, f in integrands.items()]
    )
