"""Tail probabilities, histograms, tail indices and Pareto fits per state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.operators.quantiles import quantiles_wide
from dwelltail.operators.ranks import disc_rank, select_ranks
from dwelltail.session import attach, complete_rows

MIN_EXCESSES = 30
GRID_POINTS = 60


def tail_split(df: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """Per state: threshold (discrete quantile), rows above it and rows up to it."""
    threshold = quantiles_wide(df, keys, value, [level]).withColumnRenamed("q0", "u")
    joined = attach(complete_rows(df, value, keys), threshold, keys)
    above = (F.col(value) > F.col("u")).cast("long")
    return joined.groupBy(*keys).agg(
        F.first("u").alias("u"), F.sum(above).alias("n_tail"), F.sum(1 - above).alias("n_bulk")
    )


def tail_rows(df: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """Rows above their state's threshold, with the threshold."""
    threshold = quantiles_wide(df, keys, value, [level]).select(*keys, F.col("q0").alias("u"))
    return attach(complete_rows(df, value, keys), threshold, keys).filter(F.col(value) > F.col("u"))


def tail_probability(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Share of rows strictly above each point, per state (or overall without keys)."""
    over = [F.avg((F.col(value) > F.lit(float(t))).cast("double")).alias(f"p{i}") for i, t in enumerate(points)]
    pairs = F.array(
        *[F.struct(F.lit(float(t)).alias("t"), F.col(f"p{i}").alias("tail")) for i, t in enumerate(points)]
    )
    counted = complete_rows(df, value, keys).groupBy(*keys).agg(*over)
    return counted.select(*keys, F.inline(pairs))


def tail_grid(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: int = GRID_POINTS,
    top: float = 0.99999,
    to_maximum: bool = False,
) -> DataFrame:
    """Per state ``points`` log-spaced values from ceil(p80) to ceil(p ``top``), or to ceil(max + 1)."""
    ends = quantiles_wide(df, keys, value, [0.8, top], "cont", stats={"_max": "max(_v)"})
    end = F.ceil(F.col("_max") + 1) if to_maximum else F.ceil("q1")
    return ends.select(
        *keys, "n", F.ceil("q0").cast("double").alias("lo"), end.cast("double").alias("hi")
    ).select("*", _log_grid(points).alias("grid"))


def _log_grid(points: int) -> Column:
    lo, hi = F.col("lo"), F.col("hi")
    step = (F.log10(hi) - F.log10(lo)) / F.lit(points - 1)

    def point(j: Column) -> Column:
        inner = F.round(F.pow(F.lit(10.0), F.log10(lo) + j * step), 9)
        return F.when(j == 0, lo).when(j == points - 1, hi).otherwise(inner)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), point)


def tail_curve(df: DataFrame, grids: DataFrame, keys: list[str], value: str, points: int = GRID_POINTS) -> DataFrame:
    """Share of rows at or above every grid point: each row is placed in one cell, then summed.

    ``grids`` has keys, ``lo``, ``hi`` and the ascending array ``grid``. The cell follows from the
    logarithm of the value and is corrected against the grid points beside it.
    """
    rows = attach(complete_rows(df, value, keys), grids.select(*keys, "lo", "hi", "grid"), keys)
    y = F.col(value)
    step = (F.log10("hi") - F.log10("lo")) / F.lit(points - 1)
    guess = F.when((y > 0) & (step > 0), F.floor((F.log10(y) - F.log10("lo")) / step)).otherwise(F.lit(0))
    guess = F.greatest(F.lit(0), F.least(F.lit(points - 1), guess)).cast("int")
    placed = rows.select(*keys, "grid", y.alias("_y"), guess.alias("_j"))
    # number of grid points at or below the value
    cell = (
        F.when(F.col("_y") >= F.col("hi_"), F.lit(points))
        .when(F.col("_y") < F.col("lo_"), F.lit(0))
        .when(F.get("grid", F.col("_j") + 1) <= F.col("_y"), F.col("_j") + 2)
        .when(F.get("grid", F.col("_j")) <= F.col("_y"), F.col("_j") + 1)
        .otherwise(F.col("_j"))
    )
    placed = placed.withColumn("hi_", F.get("grid", F.lit(points - 1))).withColumn("lo_", F.get("grid", F.lit(0)))
    counted = placed.groupBy(*keys, cell.alias("_cell")).count()
    sums = counted.groupBy(*keys).agg(
        F.sum("count").alias("n"),
        *[
            F.sum(F.when(F.col("_cell") > j, F.col("count")).otherwise(0)).alias(f"c{j}")
            for j in range(points)
        ],
    )
    pairs = F.arrays_zip(
        F.sequence(F.lit(0), F.lit(points - 1)).alias("j"),
        F.col("grid").alias("t"),
        F.array(*[F.col(f"c{j}") / F.col("n") for j in range(points)]).alias("tail"),
    )
    joined = attach(sums, grids.select(*keys, "grid"), keys)
    return joined.select(*keys, F.inline(pairs))


def bin_index(value: Column, lo: float, width: float, bins: int) -> Column:
    """Bin of a value in ``bins`` equal bins from ``lo``; the last bin is closed; NULL outside.

    The floor is corrected against the bin edges, so a value on an edge falls to the right.
    """
    guess = F.floor((value - F.lit(lo)) / F.lit(width)).cast("int")
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess))
    left = F.lit(lo) + guess * F.lit(width)
    right = F.lit(lo) + (guess + 1) * F.lit(width)
    fixed = (
        F.when(value < left, guess - 1)
        .when((value >= right) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    return F.when(value.between(F.lit(lo), F.lit(lo + bins * width)), fixed)


def conditional_histogram(
    df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int
) -> DataFrame:
    """keys, bin, x (bin centre), count, density over the rows inside the range."""
    width = (hi - lo) / bins
    placed = complete_rows(df, value, keys).select(*keys, bin_index(F.col(value), lo, width, bins).alias("bin"))
    counted = placed.filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").count()
    totals = counted.groupBy(*keys).agg(F.sum("count").alias("_total"))
    return attach(counted, totals, keys).select(
        *keys,
        "bin",
        (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("x"),
        "count",
        (F.col("count") / (F.col("_total") * F.lit(width))).alias("density"),
    )


def centred_histogram(
    df: DataFrame, keys: list[str], value: str, first: float, last: float, width: float = 0.1
) -> DataFrame:
    """Histogram whose bins are centred on first, first + width, ... up to last."""
    bins = int(round((last - first) / width)) + 1
    lo = first - width / 2
    return conditional_histogram(df, keys, value, lo, lo + bins * width, bins)


def histogram_mean(histogram: DataFrame, keys: list[str], width: float) -> DataFrame:
    return histogram.groupBy(*keys).agg(F.sum(F.col("x") * F.col("density") * F.lit(width)).alias("hist_mean"))


def hill_index(df: DataFrame, keys: list[str], value: str, beta: float) -> DataFrame:
    """Hill tail index from the k = floor(beta n) largest values; zeros when k = 0.

    The (k+1)-th largest is selected exactly; rows equal to it add nothing to the sum.
    """
    rows = complete_rows(df, value, keys)
    size = lambda n: F.floor(F.lit(beta) * n).cast("long")
    found = select_ranks(rows, keys, value, {"_xk": lambda n: n - size(n)}, [1 - beta])
    bounds = found.select(*keys, "n", size(F.col("n")).alias("k"), "_xk")
    joined = attach(rows, bounds, keys)
    excess = F.when(F.col(value) > F.col("_xk"), F.log(F.col(value)) - F.log(F.col("_xk")))
    summed = joined.groupBy(*keys).agg(
        F.first("n").alias("_n"), F.first("k").alias("_k"), F.first("_xk").alias("_x"), F.sum(excess).alias("_s")
    )
    some = F.col("_k") > 0
    return summed.select(
        *keys,
        F.when(some, F.col("_k") / F.col("_s")).otherwise(0.0).alias("alpha"),
        F.when(some, F.col("_x")).otherwise(0.0).alias("xk"),
        F.when(some, F.col("_k")).otherwise(0).alias("k"),
        F.when(some, F.col("_n")).otherwise(0).alias("n"),
    )


def hill_tail(index: DataFrame, keys: list[str], targets: list[float]) -> DataFrame:
    """Extrapolated tail (k/n) (x/xk)^(-alpha) at each target."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in targets])).alias("x")
    return index.filter("k > 0").select("*", at).select(
        *keys, "x", ((F.col("k") / F.col("n")) * F.pow(F.col("x") / F.col("xk"), -F.col("alpha"))).alias("tail")
    )


def conditional_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population std, sample variance, population skewness and excess kurtosis."""
    return complete_rows(df, value, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.var_samp(value).alias("cov"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
    )


def _excesses(df: DataFrame, keys: list[str], value: str, level: float) -> tuple[DataFrame, DataFrame]:
    threshold = select_ranks(df, keys, value, {"u": disc_rank(level)}, [level])
    rows = attach(complete_rows(df, value, keys), threshold, keys)
    return threshold, rows.withColumn("_z", F.when(F.col(value) > F.col("u"), F.col(value) - F.col("u")))


def gpd_fit_moments(
    df: DataFrame, keys: list[str], value: str, level: float = 0.95, positive_shape: bool = False
) -> DataFrame:
    """Generalised Pareto shape and scale from mean and variance of the excesses.

    xi = (1 - m^2/s^2) / 2, beta = m (m^2/s^2 + 1) / 2; NULL with a status when
    there are fewer than 30 excesses or they do not vary.
    """
    _, rows = _excesses(df, keys, value, level)
    stats = rows.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("u").alias("u"),
        F.count("_z").alias("n_tail"),
        F.avg("_z").alias("_m"),
        F.var_samp("_z").alias("_s2"),
    )
    return stats.select(*keys, "n", "u", "n_tail", *gpd_from_moments(positive_shape))


def gpd_from_moments(positive_shape: bool = False) -> list[Column]:
    """xi, beta, status from columns n_tail, _m, _s2."""
    status = (
        F.when(F.col("n_tail") < MIN_EXCESSES, "few_excesses")
        .when(F.coalesce(F.col("_s2"), F.lit(0.0)) <= 0, "constant_excess")
        .otherwise("ok")
    )
    ratio = F.when(status == "ok", F.col("_m") * F.col("_m") / F.col("_s2"))
    xi = F.lit(0.5) * (1 - ratio)
    if positive_shape:
        xi = F.greatest(xi, F.lit(1e-6))
    return [
        F.when(status == "ok", xi).alias("xi"),
        (F.lit(0.5) * F.col("_m") * (ratio + 1)).alias("beta"),
        status.alias("status"),
    ]


#: Candidate theta as a share of -1/max excess and as a multiple of 1/mean excess.
NEGATIVE_SHARES = (0.1, 0.25, 0.5, 0.75, 0.9)
POSITIVE_MULTIPLES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)


def gpd_fit_profile(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Pareto fit by profile likelihood over a grid of theta = xi / beta.

    For given theta the best shape is the mean of ln(1 + theta z); theta = 0 is the exponential.
    """
    _, rows = _excesses(df, keys, value, level)
    scale = rows.groupBy(*keys).agg(
        F.count("_z").alias("n_tail"), F.avg("_z").alias("_m"), F.max("_z").alias("_max")
    )
    thetas = [F.lit(-s) / F.col("_max") for s in NEGATIVE_SHARES]
    thetas += [F.lit(m) / F.col("_m") for m in POSITIVE_MULTIPLES]
    tail = attach(rows.filter(F.col("_z").isNotNull()), scale, keys)
    summed = tail.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("u").alias("u"),
        F.first("n_tail").alias("n_tail"),
        F.first("_m").alias("_m"),
        *[F.first(t).alias(f"_t{i}") for i, t in enumerate(thetas)],
        *[F.avg(F.log(1 + t * F.col("_z"))).alias(f"_x{i}") for i, t in enumerate(thetas)],
    )
    options = [
        F.struct(
            (-(F.log(F.col(f"_x{i}") / F.col(f"_t{i}")) + F.col(f"_x{i}") + 1)).alias("ll"),
            F.col(f"_x{i}").alias("xi"),
            (F.col(f"_x{i}") / F.col(f"_t{i}")).alias("beta"),
        )
        for i in range(len(thetas))
    ]
    options.append(
        F.struct((-(F.log("_m") + 1)).alias("ll"), F.lit(0.0).alias("xi"), F.col("_m").alias("beta"))
    )
    best = F.array_max(F.array(*options))
    usable = F.col("n_tail") >= MIN_EXCESSES
    return summed.withColumn("_b", best).select(
        *keys,
        "n",
        "u",
        "n_tail",
        F.when(usable, F.col("_b.xi")).alias("xi"),
        F.when(usable, F.col("_b.beta")).alias("beta"),
        F.when(usable, F.col("_b.ll") * F.col("n_tail")).alias("loglik"),
    )
