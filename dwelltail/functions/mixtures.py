"""Densities, tails, quantiles and risk measures of fitted mixtures as Columns.

A fitted state is one row: arrays ``w``, ``mu``, ``sigma`` of a Gaussian mixture and, for
the extreme-value mixture, ``u``, ``xi``, ``beta``, ``norm`` of the Pareto tail above u; its weights then add up to
(1 - norm) / F_bulk(u).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.functions.special import SQRT2, erfc, normal_cdf, normal_log_pdf, normal_pdf, normal_tail

#: Halvings of a bisection; enough for full double precision of the interval.
STEPS = 60
#: No component has mass beyond this many of its deviations.
SPAN = 40.0


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def components(k: int) -> list[tuple[Column, Column, Column]]:
    return [(F.get("w", F.lit(i)), F.get("mu", F.lit(i)), F.get("sigma", F.lit(i))) for i in range(k)]


def gmm_pdf(y: Column, k: int) -> Column:
    return _sum([w * normal_pdf(y, m, s) for w, m, s in components(k)])


def gmm_log_pdf(y: Column, k: int) -> Column:
    """Log density by log-sum-exp, finite where the density underflows; a component of weight 0 plays no part."""
    terms = [F.when(w > 0, F.log(w) + normal_log_pdf(y, m, s)) for w, m, s in components(k)]
    top = F.greatest(*terms) if k > 1 else terms[0]
    return F.coalesce(top + F.log(_sum([F.coalesce(F.exp(t - top), F.lit(0.0)) for t in terms])), _impossible(y, k))


def _impossible(y: Column, k: int) -> Column:
    """Minus infinity for a value under parameters that are there; NULL stays NULL."""
    known = _sum([w for w, _, _ in components(k)])
    return F.when(y.isNotNull() & known.isNotNull(), F.lit(float("-inf")))


def gmm_tail(y: Column, k: int) -> Column:
    return _sum([w * normal_tail(y, m, s) for w, m, s in components(k)])


def gmm_cdf(y: Column, k: int) -> Column:
    return _sum([w * normal_cdf(y, m, s) for w, m, s in components(k)])


def gpd_tail(excess: Column, xi: Column, beta: Column) -> Column:
    """P(excess > z) of a generalised Pareto; 0 beyond the end point of a negative shape."""
    inner = 1 + xi * excess / beta
    return (
        F.when(F.abs(xi) < 1e-8, F.exp(-excess / beta))
        .when(inner > 0, F.pow(inner, -1 / xi))
        .otherwise(F.lit(0.0))
    )


def gpd_pdf(excess: Column, xi: Column, beta: Column) -> Column:
    inner = 1 + xi * excess / beta
    return (
        F.when(F.abs(xi) < 1e-8, F.exp(-excess / beta) / beta)
        .when(inner > 0, F.pow(inner, -(xi + 1) / xi) / beta)
        .otherwise(F.lit(0.0))
    )


def emm_pdf(y: Column, k: int) -> Column:
    above = F.col("norm") * gpd_pdf(y - F.col("u"), F.col("xi"), F.col("beta"))
    return F.when(y > F.col("u"), above).otherwise(gmm_pdf(y, k))


def emm_log_pdf(y: Column, k: int) -> Column:
    """Minus infinity beyond the end point of a tail with negative shape."""
    density = F.col("norm") * gpd_pdf(y - F.col("u"), F.col("xi"), F.col("beta"))
    above = F.when(density > 0, F.log(density)).when(density == 0, F.lit(float("-inf")))
    return F.when(y > F.col("u"), above).otherwise(gmm_log_pdf(y, k))


def bulk_tail(y: Column, k: int) -> Column:
    """Tail of a bulk whose weights were scaled: 1 - F, with what they lack to one on top."""
    return 1 - _sum([w for w, _, _ in components(k)]) + gmm_tail(y, k)


def emm_tail(y: Column, k: int) -> Column:
    above = F.col("norm") * gpd_tail(y - F.col("u"), F.col("xi"), F.col("beta"))
    return F.when(y > F.col("u"), above).otherwise(bulk_tail(y, k))


def with_tail(df: DataFrame, y: Column, k: int, out: str, pareto: bool = False) -> DataFrame:
    """Adds the tail probability at ``y`` to record-sized rows.

    The standardised distances become columns first: the long erfc expression then refers to
    plain columns, which keeps the generated code short enough to be compiled.
    """
    columns = df.columns
    rows = df.withColumn("_at", y)
    for i, (_, m, s) in enumerate(components(k)):
        rows = rows.withColumn(f"_z{i}", (F.col("_at") - m) / (s * F.lit(SQRT2)))
    for i in range(k):
        rows = rows.withColumn(f"_e{i}", erfc(F.col(f"_z{i}")))
    bulk = _sum([F.lit(0.5) * w * F.col(f"_e{i}") for i, (w, _, _) in enumerate(components(k))])
    if pareto:
        above = F.col("norm") * gpd_tail(F.col("_at") - F.col("u"), F.col("xi"), F.col("beta"))
        lacking = 1 - _sum([w for w, _, _ in components(k)])
        bulk = F.when(F.col("_at") > F.col("u"), above).otherwise(lacking + bulk)
    return rows.select(*columns, bulk.alias(out))


def bisect(decreasing, target: Column, lo: Column | float, hi: Column | float, steps: int = STEPS) -> Column:
    """Root of ``decreasing(y) = target`` on [lo, hi] by a fixed number of halvings."""
    lo, hi = (end if isinstance(end, Column) else F.lit(float(end)) for end in (lo, hi))
    start = F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(ends: Column, _step: Column) -> Column:
        middle = (ends["lo"] + ends["hi"]) / 2
        right = decreasing(middle) > target
        return F.struct(
            F.when(right, middle).otherwise(ends["lo"]).alias("lo"),
            F.when(right, ends["hi"]).otherwise(middle).alias("hi"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return (found["lo"] + found["hi"]) / 2


def upper_bound(k: int) -> Column:
    ends = [m + F.lit(SPAN) * s for _, m, s in components(k)]
    return F.greatest(*ends) if k > 1 else ends[0]


def lower_bound(k: int) -> Column:
    ends = [m - F.lit(SPAN) * s for _, m, s in components(k)]
    return F.least(*ends) if k > 1 else ends[0]


def gmm_value_at_risk(alpha: float, k: int) -> Column:
    """The alpha-quantile on the whole line, negative values included."""
    return bisect(lambda y: gmm_tail(y, k), F.lit(1.0 - alpha), lower_bound(k), upper_bound(k))


def emm_value_at_risk(alpha: float, k: int) -> Column:
    """The alpha-quantile of the mixture with a Pareto tail: closed form in the tail, else in the bulk up to u."""
    bulk = bisect(lambda y: bulk_tail(y, k), F.lit(1.0 - alpha), lower_bound(k), F.greatest(F.col("u").cast("double"), lower_bound(k)))
    return F.when(F.lit(1.0 - alpha) < F.col("norm"), gpd_quantile(F.lit(1.0 - alpha))).otherwise(bulk)


def cvar_by_integral(pdf, at_risk: Column, floor: Column, alpha: float, cells: int) -> Column:
    """Mean below the alpha-quantile of any density: the trapezoid rule on [floor, at_risk], over alpha."""
    width = (at_risk - floor) / F.lit(float(cells))

    def term(i: Column) -> Column:
        y = floor + width * i
        return y * pdf(y) * F.when((i == 0) | (i == cells), 0.5).otherwise(1.0)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(cells)), F.lit(0.0), lambda acc, i: acc + term(i))
    return total * width / F.lit(alpha)


def gmm_quantile(q: Column, k: int, bound: float | None = None) -> Column:
    """Bisection on [0, bound]; the bound follows from the components unless it is given."""
    return bisect(lambda y: gmm_tail(y, k), 1 - q, 0.0, upper_bound(k) if bound is None else bound)


def gpd_quantile(tail: Column) -> Column:
    """Closed form above u: tail below ``norm``."""
    ratio = tail / F.col("norm")
    xi, beta = F.col("xi"), F.col("beta")
    step = F.when(F.abs(xi) < 1e-8, -beta * F.log(ratio)).otherwise(beta / xi * (F.pow(ratio, -xi) - 1))
    return F.col("u") + step


def emm_quantile(q: Column, k: int) -> Column:
    """Closed form in the Pareto part, bisection in the bulk up to u."""
    tail = 1 - q
    bulk = bisect(lambda y: bulk_tail(y, k), tail, 0.0, F.col("u"))
    return F.when(tail < F.col("norm"), gpd_quantile(tail)).otherwise(bulk)


def mixture_mean(k: int) -> Column:
    return _sum([w * m for w, m, _ in components(k)])


def mixture_variance(k: int) -> Column:
    """Variance within components plus variance between them."""
    mean = mixture_mean(k)
    return _sum([w * (s * s + (m - mean) * (m - mean)) for w, m, s in components(k)])


def mixture_cvar(at_risk: Column, alpha: float, k: int) -> Column:
    """Mean of a Gaussian mixture below its alpha-quantile; terms below 1e-64 are dropped."""
    terms = []
    for w, m, s in components(k):
        below = normal_cdf(at_risk, m, s)
        density = s * normal_pdf(at_risk, m, s)
        usable = (below >= 1e-64) & (density >= 1e-64)
        terms.append(F.when(usable, w / F.lit(alpha) * (below * m - s * density)).otherwise(0.0))
    return _sum(terms)


def sample_mixture(choice: Column, noise: Column, k: int) -> Column:
    """A draw: component by a uniform number against the cumulative weights, then scaled noise."""
    parts = components(k)
    drawn = parts[-1][1] + parts[-1][2] * noise
    picked = None
    total = F.lit(0.0)
    for i, (w, m, s) in enumerate(parts[:-1]):
        total = total + w
        value = m + s * noise
        picked = F.when(choice < total, value) if i == 0 else picked.when(choice < total, value)
    return drawn if picked is None else picked.otherwise(drawn)
