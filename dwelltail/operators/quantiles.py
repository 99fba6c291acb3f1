"""Conditional quantiles, discrete and interpolated, for all states in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.operators.ranks import disc_rank, select_ranks
from dwelltail.session import attach, attach_bounded, complete_rows, cut


def level_grid(top: float, bottom: float, count: int) -> list[float]:
    """Levels 1 - 10^e with ``count`` exponents evenly spaced from log10(top) to log10(bottom)."""
    import math

    first, final = math.log10(top), math.log10(bottom)
    return [1 - 10 ** (first + i * (final - first) / (count - 1)) for i in range(count)]


#: The ten levels of the ground-truth tables: 0.99 ... 0.99999.
TRUTH_LEVELS = [round(q, 16) for q in level_grid(1e-2, 1e-5, 10)]


def quantiles_wide(
    df: DataFrame, keys: list[str], value: str, levels: list[float], kind: str = "disc", **options
) -> DataFrame:
    """keys, n and one column ``q0, q1, ...`` per level.

    ``disc``: the value of rank ceil(q n). ``cont``: linear interpolation at position (n - 1) q.
    """
    if kind == "disc":
        ranks = {f"q{i}": disc_rank(q) for i, q in enumerate(levels)}
        return select_ranks(df, keys, value, ranks, levels, **options)
    ranks = {}
    for i, q in enumerate(levels):
        ranks[f"_b{i}"] = _floor_rank(q)
        ranks[f"_t{i}"] = _ceil_rank(q)
    stats = list(options.get("stats") or {})
    found = select_ranks(df, keys, value, ranks, levels, together=2, **options)
    between = [
        f"_b{i} + ((n - 1) * {float(q)!r}D - floor((n - 1) * {float(q)!r}D)) * (_t{i} - _b{i}) as q{i}"
        for i, q in enumerate(levels)
    ]
    return found.selectExpr(*keys, "n", *stats, *between)


def _floor_rank(q: float):
    return lambda n: (F.floor((n - 1) * F.lit(float(q))) + 1).cast("long")


def _ceil_rank(q: float):
    return lambda n: (F.ceil((n - 1) * F.lit(float(q))) + 1).cast("long")


def long_form(wide: DataFrame, keys: list[str], levels: list[float], value: str = "y_q") -> DataFrame:
    """keys, n, q, y_q: one row per group and level."""
    pairs = F.array(
        *[F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias(value)) for i, q in enumerate(levels)]
    )
    return wide.select(*keys, "n", F.inline(pairs))


def conditional_quantiles(
    df: DataFrame, keys: list[str], value: str, levels: list[float], kind: str = "disc", **options
) -> DataFrame:
    return long_form(quantiles_wide(df, keys, value, levels, kind, **options), keys, levels)


def restricted_quantiles(
    df: DataFrame, states: DataFrame, keys: list[str], value: str, levels: list[float], kind: str = "disc"
) -> DataFrame:
    """Quantiles of the listed states only; ``states`` is a top-N list, bounded by its N."""
    wanted = attach_bounded(df, cut(states.select(*keys)), keys)
    return conditional_quantiles(wanted, keys, value, levels, kind)


def wide_with_states(quantiles: DataFrame, states: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """State rows with one column per level, named by the level (for export)."""
    wide = quantiles.groupBy(*keys).pivot("q", [float(q) for q in levels]).agg(F.first("y_q"))
    return attach_bounded(wide, states, keys).select(
        *keys, "count", "prob", *[F.col(f"`{float(q)}`") for q in levels]
    )


def measure(df: DataFrame, keys: list[str], value: str, levels: list[float], **options) -> DataFrame:
    """Mean, count and interpolated quantiles per state."""
    return quantiles_wide(df, keys, value, levels, "cont", stats={"mean": "avg(_v)"}, **options)


def measure_states(
    df: DataFrame, requested: DataFrame, keys: list[str], value: str, levels: list[float]
) -> DataFrame:
    """The measures of requested states; a state without rows keeps a row of NULLs."""
    return requested.select(*keys).distinct().join(measure(df, keys, value, levels), keys, "left")


def lower_tail_mean(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """Value at risk (interpolated alpha-quantile) and mean of the rows at or below it."""
    at_risk = quantiles_wide(df, keys, value, [alpha], "cont").withColumnRenamed("q0", "var")
    joined = attach(complete_rows(df, value, keys), at_risk, keys)
    return joined.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("var").alias("var"),
        F.avg(F.when(F.col(value) <= F.col("var"), F.col(value))).alias("cvar"),
    )


def exceed_counts(df: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """How many rows lie at or above each interpolated quantile."""
    wide = quantiles_wide(df, keys, value, levels, "cont")
    joined = attach(complete_rows(df, value, keys), wide, keys)
    counted = joined.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.first(f"q{i}").alias(f"q{i}") for i in range(len(levels))],
        *[F.sum((F.col(value) >= F.col(f"q{i}")).cast("long")).alias(f"c{i}") for i in range(len(levels))],
    )
    triples = F.array(
        *[
            F.struct(
                F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("y_q"), F.col(f"c{i}").alias("n_exceed")
            )
            for i, q in enumerate(levels)
        ]
    )
    return counted.select(*keys, "n", F.inline(triples))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
