"""Model selection by cross-validated mean log-likelihood, all combinations in the same jobs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.functions.special import SQRT_2PI
from dwelltail.operators import cells, fit, mixture_em
from dwelltail.operators.kernels import ORDER, REACH, cell_moments, combine_moments, kernel_log_sums, normal_reference, rows_of_cells
from dwelltail.operators.matching import _pairs_within
from dwelltail.operators.ranks import disc_rank, select_ranks
from dwelltail.session import attach, complete_rows, cut


def cv_affine(df: DataFrame, keys: list[str], value: str, scales: list[float], fold: str = "fold") -> DataFrame:
    """param, fold, loglik: held-out mean log density of a normal per state.

    ``scales`` multiply the fitted deviation. Training statistics are the total less the
    fold, and the held-out sum follows from count, sum and square sum: one pass over the rows.
    """
    centre = df.agg(F.avg(value)).scalar()
    y = F.col(value) - centre
    parts = cut(df.groupBy(*keys, fold).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2")
    ))
    whole = parts.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "s1", "s2")])
    joined = attach(parts, whole, keys)
    n = F.col("t_n") - F.col("n")
    mean = (F.col("t_s1") - F.col("s1")) / n
    variance = (F.col("t_s2") - F.col("s2")) / n - mean * mean
    grid = F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("param")
    trained = joined.select("*", mean.alias("_m"), variance.alias("_v")).select("*", grid)
    width = F.col("_v") * F.col("param") * F.col("param")
    squares = F.col("s2") - 2 * F.col("_m") * F.col("s1") + F.col("n") * F.col("_m") * F.col("_m")
    held = F.lit(-0.5) * F.col("n") * F.log(F.lit(2 * math.pi) * width) - squares / (2 * width)
    return trained.groupBy("param", fold).agg((F.sum(held) / F.sum("n")).alias("loglik"))


def cv_ckde(
    df: DataFrame, row_id: str, columns: list[str], value: str, multiples: list[float], fold: str = "fold"
) -> DataFrame:
    """param, fold, loglik of a conditional kernel density with multiples of the reference bandwidths."""
    row = df.agg(F.count("*"), *[F.stddev_pop(c) for c in [*columns, value]]).first()
    reference = normal_reference(row[0], list(row[1:]))
    d = len(columns)
    near = [f"near_{c}" for c in columns]
    counts = cut(df.groupBy(*columns, fold).agg(F.count("*").alias("n")))
    states = cut(counts.groupBy(*columns).agg(F.sum("n").alias("n")))
    folds = counts.select(F.col(fold).alias("_held")).distinct()
    folds = [r[0] for r in folds.collect()]
    held = F.explode(F.array(*[F.lit(f) for f in folds])).alias("_held")
    results = None
    for multiple in multiples:
        *hx, hy = [multiple * h for h in reference]
        pairs = _pairs_within(states, states, columns, [0.0] * d, hx, REACH / math.sqrt(d)).drop("n")
        kernel = F.exp(F.lit(-0.5 * d) * F.col("dist") * F.col("dist"))
        pairs = cut(pairs.withColumn("_k", kernel))
        others = lambda table: table.select("*", held).filter(F.col("_held") != F.col(fold)).drop(fold)

        def around(per: int, only: DataFrame | None, hy: float = hy, pairs: DataFrame = pairs) -> DataFrame:
            linked, inside = pairs, []
            rows = df
            if only is not None:
                inside = ["_in"]
                linked = cut(pairs.join(only.select(*columns, *inside).distinct(), columns))
                rows = rows_of_cells(df.select(*columns, fold, value), columns, near, value, hy, linked)
            moments = cell_moments(rows, [*columns, fold, *inside], value, hy, per)
            moments = moments.withColumnsRenamed(dict(zip(columns, near)))
            mixed = combine_moments(moments, linked, [*columns, fold, *inside], [*near, *inside], F.col("_k"))
            if only is not None:
                mixed = mixed.join(only.withColumnRenamed(fold, "_held"), [*columns, *inside]).filter(F.col("_held") != F.col(fold))
            else:
                mixed = others(mixed)
            summed = mixed.groupBy(*columns, "_held", *inside, "_cell").agg(
                *[F.sum(f"m{p}").alias(f"m{p}") for p in range(ORDER + 1)]
            )
            return summed.withColumnRenamed("_held", fold)

        mass = others(counts).withColumnsRenamed(dict(zip(columns, near)))
        mass = pairs.join(mass, near).groupBy(*columns, F.col("_held").alias(fold)).agg(
            F.sum(F.col("_k") * F.col("n")).alias("_mass")
        )
        sums = kernel_log_sums(df, row_id, [*columns, fold], value, around, hy, own=False)
        sums = attach(sums, mass, [*columns, fold])
        density = F.col("log_sum") - F.log(F.col("_mass") * F.lit(hy * SQRT_2PI))
        scored = sums.groupBy(fold).agg(F.avg(density).alias("loglik"))
        scored = scored.select(F.lit(float(multiple)).alias("param"), fold, "loglik")
        results = scored if results is None else results.unionByName(scored)
    return results


def best_of_grid(scores: DataFrame, fold: str = "fold") -> DataFrame:
    """Per parameter the mean over folds, the best fold, and whether it is the best parameter."""
    means = scores.groupBy("param").agg(
        F.avg("loglik").alias("mean_loglik"),
        F.max_by(fold, F.struct("loglik", -F.col(fold))).alias("best_fold"),
    )
    means = cut(means)
    top = means.agg(F.max_by("param", F.struct("mean_loglik", -F.col("param")))).scalar()
    return means.withColumn("is_best", (F.col("param") == top).cast("int"))


def cv_mixture(
    df: DataFrame, keys: list[str], value: str, sizes: tuple[int, ...] = (1, 2, 3), fold: str = "fold", iterations: int = fit.ITERATIONS,
    tolerance: float = fit.TOLERANCE, small: int = cells.SMALL,
) -> DataFrame:
    """param (number of components), fold, loglik: held-out mean log density of a Gaussian mixture per state.

    One summary of the records, apart by fold, serves all sizes and folds: a fold is left out by leaving out its nodes. Every fit starts from the
    quantiles of all rows of its state. A state counts in a fold that leaves it 10 rows per component of the largest size, so
    all sizes are compared on the same rows; one whose rows do not vary counts nowhere.
    """
    most = max(sizes)
    rows = complete_rows(df.select(*keys, F.col(fold).cast("int").alias("_fold"), F.col(value).cast("double").alias("_y")), "_y", [*keys, "_fold"])
    levels = sorted({(i + 0.5) / k for k in sizes for i in range(k)})
    ranked = select_ranks(rows, keys, "_y", {f"_q{i}": disc_rank(q) for i, q in enumerate(levels)}, levels, stats={"_s2": "var_pop(_v)"})
    quantiles = [F.col(f"_q{i}") for i in range(len(levels))]
    spread = F.greatest(quantiles[-1] - quantiles[0], 0.01 * F.sqrt("_s2"))
    places = ranked.filter(F.col("_s2") > 0).select(
        *keys, "n", F.col("_s2").alias("_v"), F.array(*quantiles).alias("_qs"), quantiles[len(levels) // 2].alias("_a"), spread.alias("_b")
    )
    places = cut(places)
    joined = cells.summarise(rows, places, keys, F.col("_fold"), small).join(places, keys)

    def scored(batches):
        for batch in batches:
            known = {name: batch.column(name).to_pylist() for name in ("_v", "_a", "_b", "_qs")}
            found = []
            for place in range(batch.num_rows):
                variance, qs = known["_v"][place], dict(zip(levels, known["_qs"][place]))
                part, y, weight = cells.read_nodes(batch.column("cells")[place], known["_a"][place], known["_b"][place])
                for held in np.unique(part):
                    train, test = part != held, part == held
                    n = int(round(float(weight[train].sum())))
                    if n < fit.ROWS_PER_COMPONENT * most:
                        continue
                    for k in sizes:
                        start = np.full(k, 1.0 / k), np.array([qs[(i + 0.5) / k] for i in range(k)]), np.full(k, variance**0.5)
                        best = mixture_em.settle(y[train], weight[train], start, n, variance, iterations, tolerance)
                        total = float(weight[test] @ mixture_em.log_density(y[test], best.w, best.mu, best.sigma))
                        found.append((k, int(held), total, float(weight[test].sum())))
            columns = list(zip(*found)) or [()] * 4
            kinds = pa.int32(), pa.int32(), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "held", "total", "rows"])

    each = joined.mapInArrow(scored, "k int, held int, total double, rows double")
    return cut(each.groupBy(F.col("k").alias("param"), F.col("held").alias(fold)).agg((F.sum("total") / F.sum("rows")).alias("loglik")))


def refit_best(df: DataFrame, keys: list[str], value: str, scores: DataFrame, **options) -> DataFrame:
    """The mixture of the best size of ``scores`` (see ``cv_mixture``) over all rows, with the size as ``k``; NULLs where nothing was scored."""
    best = best_of_grid(scores).filter("is_best = 1").select("param").first()
    k = 1 if best is None else int(best["param"])
    return fit.fit_gmm(df, keys, value, k, **options).withColumn("k", F.lit(k))
