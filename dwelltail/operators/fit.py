"""Fitting every state at once: one summary of the records, then each state settled on its own summary."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.functions.mixtures import gmm_tail
from dwelltail.functions.special import normal_log_pdf, normal_pdf
from dwelltail.operators import cells, mixture_em
from dwelltail.operators.ranks import disc_rank, select_ranks
from dwelltail.operators.tails import MIN_EXCESSES, gpd_from_moments
from dwelltail.session import attach, complete_rows, cut

#: Smallest number of rows per component.
ROWS_PER_COMPONENT = 10
#: Plain steps at most, and the largest move of a plain step of a settled fit (see ``mixture_em``).
ITERATIONS = 3_000
TOLERANCE = 1e-12
#: Largest move of a plain step over the records themselves from a fit over their summary; beyond, the cells are made finer.
CERTIFIED = 1e-7
FINER, ROUNDS = 8, 3
RUNG = ("level", "u", "n_tail", "xi", "beta", "loglik")
#: Candidate shares of the records at or below the threshold of a tail.
LADDER = (0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def starting_ranks(k: int) -> tuple[dict, list[float]]:
    """Evenly spaced quantiles that k components start from."""
    levels = [(i + 0.5) / k for i in range(k)]
    return {f"_m{i}": disc_rank(q) for i, q in enumerate(levels)}, levels


def fit_gmm(
    df: DataFrame, keys: list[str], value: str, k: int = 3, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, small: int = cells.SMALL
) -> DataFrame:
    """Gaussian mixture per state by expectation maximisation.

    The records are read for the starting quantiles and once for the summary (``cells``); every step works on the summary, and one more pass
    certifies the large states: a plain step over their records moves nothing. Starts from evenly spaced state quantiles with the
    state's variance; a state stops when it is settled (a bound without unit, see ``mixture_em``), or after ``iterations`` plain
    steps: ``settled``, ``steps`` and ``loglik`` (mean) say where. A state with fewer than 10k rows gets NULL parameters and the
    status ``few_rows``.
    """
    rows = complete_rows(df.select(*keys, F.col(value).cast("double").alias("_y")), "_y", keys)
    ranks, levels = starting_ranks(k)
    # the variance is taken in the sketch pass of the selection
    starts = select_ranks(rows, keys, "_y", ranks, levels, stats={"_s2": "var_pop(_v)"})
    return _settled(rows, starts, keys, k, iterations, tolerance, small)


def _places(params: DataFrame, k: int) -> DataFrame:
    """``params`` with centre and unit of the cells: the middle starting quantile, and the distance of the outer ones."""
    spread = F.greatest(F.col(f"_m{k - 1}") - F.col("_m0"), 0.01 * F.sqrt("_v"))
    return params.select("*", F.col(f"_m{k // 2}").alias("_a"), (spread if k > 1 else F.sqrt("_v")).alias("_b"))


def _settled(rows, starts, keys, k, iterations, tolerance, small, tail: tuple[str, ...] = ()) -> DataFrame:
    """Fit from the start quantiles; ``tail`` names the columns of a censored fit (``u``, ``n_tail``)."""
    numbers = [F.col(f"_m{i}").cast("double").alias(f"_m{i}") for i in range(k)]
    params = cut(starts.select(*keys, "n", *tail, F.col("_s2").alias("_v"), *numbers))
    usable = (F.col("n") >= ROWS_PER_COMPONENT * k) & (F.col("_v") > 0)

    def solve(summary: DataFrame, open_: DataFrame, per_unit: int) -> DataFrame:
        return _each_state(summary.join(open_, keys), keys, k, iterations, tolerance, per_unit, tail)

    only = F.col("_y") <= F.col("u").cast("double") if tail else None
    fitted = _certified(rows, params.filter(usable), keys, k, small, solve, tail, only=only)
    packed = fitted.select(*keys, "w", "mu", "sigma", "steps", "loglik", "_done")
    joined = params.withColumn("_usable", usable).join(packed, keys, "left")
    status = F.when(F.col("_usable"), "ok").when(F.col("n") < ROWS_PER_COMPONENT * k, "few_rows").otherwise("constant")
    return joined.select(*keys, "n", *tail, status.alias("status"), "w", "mu", "sigma", "steps", "loglik", F.col("_done").alias("settled"))


def _certified(rows, params, keys, k, small, solve, tail, part: Column | None = None, only: Column | None = None) -> DataFrame:
    """``solve`` on summaries of the rows, with finer cells for large states whose records a plain step still moves."""
    fitted, open_, per_unit = None, _places(params, k), cells.PER_UNIT
    for number in range(ROUNDS + 1):
        open_ = cut(open_)
        summary = cells.summarise(rows, open_, keys, part, small, per_unit, only)
        found = cut(solve(summary, open_, per_unit))
        large = found.filter((F.col("n") > small) & F.col("w").isNotNull())
        if number == ROUNDS or large.isEmpty():
            break
        # one plain step over the records, of the large states only
        moved = cut(_certificate(rows, large, keys, k, tail), F.count_if(F.col("_move") > CERTIFIED))
        if not moved._measured:
            break
        coarse = moved.filter(F.col("_move") > CERTIFIED).select(*keys)
        good = found.join(coarse, keys, "left_anti")
        fitted = good if fitted is None else fitted.unionByName(good)
        open_, per_unit = open_.join(coarse, keys, "left_semi"), per_unit * FINER
    return found if fitted is None else fitted.unionByName(found)


def _each_state(joined, keys, k, iterations, tolerance, per_unit, tail) -> DataFrame:
    """Settle every state on its summary: n, the tail columns, ``_v``, w, mu, sigma, steps, loglik (mean), ``_done``."""
    carried = ["n", *tail, "_v"]

    def settled(batches):
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in [*carried, "_a", "_b", *[f"_m{i}" for i in range(k)]]}
            results = []
            for place in range(batch.num_rows):
                row = {name: values[place] for name, values in columns.items()}
                _, y, weight = cells.read_nodes(batch.column("cells")[place], row["_a"], row["_b"], per_unit)
                start = np.full(k, 1.0 / k), np.array([row[f"_m{i}"] for i in range(k)]), np.full(k, row["_v"] ** 0.5)
                censored = (float(row["u"]), float(row["n_tail"])) if tail else None
                fit = mixture_em.settle(y, weight, start, row["n"], row["_v"], iterations, tolerance, censored)
                results.append((fit.w, fit.mu, fit.sigma, fit.steps, fit.loglik / row["n"], fit.done))
            w, mu, sigma, steps, loglik, done = zip(*results) if results else [()] * 6
            listed = [pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in (w, mu, sigma)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in [*keys, *carried]] + listed + [pa.array(steps, pa.int32()), pa.array(loglik, pa.float64()), pa.array(done, pa.bool_())],
                names=[*keys, *carried, "w", "mu", "sigma", "steps", "loglik", "_done"],
            )

    kept = joined.select(*keys, *carried).schema
    added = joined.sparkSession.createDataFrame([], "w array<double>, mu array<double>, sigma array<double>, steps int, loglik double, _done boolean").schema
    return joined.mapInArrow(settled, type(kept)(kept.fields + added.fields))


def _certificate(rows, fitted, keys, k, tail) -> DataFrame:
    """Per state ``_move``: the largest move of one plain step over its records, as ``mixture_em`` measures it."""
    each = range(k)
    params = fitted.select(*keys, "n", *tail, "_v", *[F.col(c)[i].alias(f"_{c[0]}{i}") for c in ("w", "mu", "sigma") for i in each])
    joined = attach(rows, params, keys)
    if tail:
        joined = joined.filter(F.col("_y") <= F.col("u").cast("double"))
    logs = [f"ln(greatest(_w{i}, 1e-300D)) - ln(_s{i}) - 0.5D * pow((_y - _m{i}) / _s{i}, 2D) as _d{i}" for i in each]
    top = f"greatest({', '.join(f'_d{i}' for i in each)})" if k > 1 else "_d0"
    whole = " + ".join(f"exp(_d{i} - _top)" for i in each)
    shared = joined.selectExpr("*", *logs).selectExpr("*", f"{top} as _top").selectExpr("*", f"{whole} as _whole")
    shared = shared.selectExpr("*", *[f"exp(_d{i} - _top) / _whole as _r{i}" for i in each], *[f"_y - _m{i} as _x{i}" for i in each])
    sums = [f"sum({term}) as _{name}{i}" for i in each for name, term in (("n", f"_r{i}"), ("a", f"_r{i} * _x{i}"), ("b", f"_r{i} * _x{i} * _x{i}"))]
    kept = [f"first({c}) as {c}" for c in params.columns if c not in keys]
    summed = shared.groupBy(*keys).agg(*[F.expr(text) for text in [*sums, *kept]])

    def moved(batches):
        for batch in batches:
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in batch.schema.names if name not in keys}
            result = []
            for place in range(batch.num_rows):
                row = {name: values[place] for name, values in columns.items()}
                w, m, s, count, first, second = (np.array([row[f"_{c}{i}"] for i in each]) for c in "wmsnab")
                if tail:
                    mass, z, hazard = mixture_em.above(row["u"], w, m, s)
                    mine = row["n_tail"] * (mass / mass.sum() if mass.sum() > 0 else 1.0 / k)
                    count, first, second = count + mine, first + mine * s * hazard, second + mine * s * s * (1 + z * hazard)
                safe = np.maximum(count, 1e-12)
                spread = np.sqrt(np.maximum(second / safe - (first / safe) ** 2, mixture_em.VARIANCE_FLOOR * row["_v"]))
                some = count > 1e-12
                moves = [count / row["n"] - w, np.where(some, w * first / safe, 0.0) / row["_v"] ** 0.5, np.where(some, w * np.log(spread / s), 0.0)]
                result.append(float(np.abs(moves).max()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keys] + [pa.array(result, pa.float64())], names=[*keys, "_move"])

    return summed.mapInArrow(moved, summed.select(*keys, F.lit(0.0).alias("_move")).schema)


def fit_emm(
    df: DataFrame,
    keys: list[str],
    value: str,
    k: int = 2,
    iterations: int = ITERATIONS,
    level: float = 0.95,
    positive_shape: bool = False,
    tolerance: float = TOLERANCE,
    small: int = cells.SMALL,
) -> DataFrame:
    """Gaussian bulk with a generalised Pareto tail above the state's ``level`` quantile.

    The bulk is fitted to the rows up to u; of those above only their number counts (a censored fit). ``norm`` is the
    share of rows above u, and the weights are scaled to the rest: they add up to (1 - norm) / F_bulk(u), so that
    the tail is continuous at u.
    """
    rows = complete_rows(df.select(*keys, F.col(value).alias("_y")), "_y", keys)
    ranks, levels = starting_ranks(k)
    starts = cut(select_ranks(rows, keys, "_y", ranks | {"u": disc_rank(level)}, [*levels, level], stats={"_s2": "var_pop(_v)"}))
    over = attach(rows, starts.select(*keys, "u"), keys)
    z = F.when(F.col("_y") > F.col("u"), F.col("_y") - F.col("u"))
    excess = cut(
        over.groupBy(*keys)
        .agg(F.count(z).alias("n_tail"), F.avg(z).alias("_m"), F.var_samp(z).alias("_s2"))
        .select(*keys, "n_tail", *gpd_from_moments(positive_shape))
        .withColumnRenamed("status", "_tail")
    )
    counted = starts.join(excess.select(*keys, "n_tail"), keys)
    doubled = rows.withColumn("_y", F.col("_y").cast("double"))
    bulk = _settled(doubled, counted, keys, k, iterations, tolerance, small, ("u", "n_tail"))
    joined = bulk.join(excess.drop("n_tail"), keys).withColumn("norm", F.col("n_tail") / F.col("n"))
    below = 1 - gmm_tail(F.col("u").cast("double"), k)
    joined = joined.withColumn("_scale", F.try_divide(1 - F.col("norm"), below))
    joined = joined.withColumn("w", F.transform("w", lambda w: w * F.col("_scale")))
    status = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.col("_tail"))
    return joined.select(
        *keys, "n", "n_tail", "w", "mu", "sigma", "u", "xi", "beta", "norm", "steps", "loglik", "settled", status.alias("status")
    )


def fit_emm_ladder(
    df: DataFrame,
    keys: list[str],
    value: str,
    k: int = 2,
    levels: tuple[float, ...] = LADDER,
    iterations: int = ITERATIONS,
    tolerance: float = TOLERANCE,
    small: int = cells.SMALL,
) -> DataFrame:
    """``fit_emm`` with a threshold learned per state: the rung of a ladder of levels with the highest likelihood of bulk and tail together.

    Records are summarised once, apart between neighbouring thresholds, so every rung's excess moments, censored bulk and likelihood
    come from parts of one summary. A rung needs 30 excesses that vary and an end point above the largest record; equal likelihoods
    go to the lower rung. ``rungs`` has them all: level, u, n_tail, xi, beta, loglik (mean; NULL where a rung cannot be used).
    Without a usable rung the parameters are NULL (``few_excesses``).
    """
    levels = sorted(levels)
    rows = complete_rows(df.select(*keys, F.col(value).cast("double").alias("_y")), "_y", keys)
    ranks, starts = starting_ranks(k)
    ranks |= {f"_u{j}": disc_rank(q) for j, q in enumerate(levels)}
    ranked = select_ranks(rows, keys, "_y", ranks, [*starts, *levels], stats={"_s2": "var_pop(_v)", "_top": "max(_v)"})
    us = F.array(*[F.col(f"_u{j}") for j in range(len(levels))])
    params = cut(ranked.select(*keys, "n", F.col("_s2").alias("_v"), "_top", *[f"_m{i}" for i in range(k)], us.alias("_us")))
    usable = (F.col("n") >= ROWS_PER_COMPONENT * k) & (F.col("_v") > 0)

    def solve(summary: DataFrame, open_: DataFrame, per_unit: int) -> DataFrame:
        return _each_ladder(summary.join(open_, keys), keys, k, levels, iterations, tolerance, per_unit)

    part = F.size(F.filter("_us", lambda u: u < F.col("_y")))
    fitted = _certified(rows, params.filter(usable), keys, k, small, solve, ("u", "n_tail"), part)
    joined = params.withColumn("_usable", usable).join(fitted.drop("n", "_v"), keys, "left").withColumn("norm", F.col("n_tail") / F.col("n"))
    below = F.try_divide(1 - F.col("norm"), 1 - gmm_tail(F.col("u"), k))
    status = F.when(~F.col("_usable"), F.when(F.col("n") < ROWS_PER_COMPONENT * k, "few_rows").otherwise("constant"))
    status = status.when(F.col("u").isNull(), "few_excesses").otherwise("ok")
    # one row per state, stored: planning what follows need not carry the long expression of the scale
    return cut(joined.select(
        *keys, "n", "n_tail", F.transform("w", lambda w: w * below).alias("w"), "mu", "sigma", "u", "xi", "beta", "norm", "level", "steps", "loglik",
        F.col("_done").alias("settled"), status.alias("status"), "rungs",
    ))


def _each_ladder(joined, keys, k, levels, iterations, tolerance, per_unit) -> DataFrame:
    columns = ["n", "_v", "_top", "_a", "_b", "_us", *[f"_m{i}" for i in range(k)]]

    def climbed(batches):
        for batch in batches:
            known = {name: batch.column(name).to_pylist() for name in columns}
            out = {name: [] for name in ("u", "n_tail", "w", "mu", "sigma", "xi", "beta", "level", "steps", "loglik", "_done", "rungs")}
            for place in range(batch.num_rows):
                row = {name: values[place] for name, values in known.items()}
                part, y, weight = cells.read_nodes(batch.column("cells")[place], row["_a"], row["_b"], per_unit)
                start = np.full(k, 1.0 / k), np.array([row[f"_m{i}"] for i in range(k)]), np.full(k, row["_v"] ** 0.5)
                best, rungs = None, []
                for j, (level, u) in enumerate(zip(levels, row["_us"])):
                    at = mixture_em.spliced(y, weight, part <= j, u, row["_top"], start, row["n"], row["_v"], iterations, tolerance, MIN_EXCESSES)
                    mean = None if at is None or not np.isfinite(at.loglik) else at.loglik / row["n"]
                    rungs.append((level, u, None if at is None else at.n_tail, *((None, None) if at is None else (at.xi, at.beta)), mean))
                    if mean is not None and (best is None or mean > best[0]):
                        best = mean, level, u, at
                mean, level, u, at = best or (None,) * 4
                bulk = at and at.bulk
                for name, found in zip(out, (
                    u, at and at.n_tail, bulk and bulk.w.tolist(), bulk and bulk.mu.tolist(), bulk and bulk.sigma.tolist(), at and at.xi, at and at.beta,
                    level, bulk and bulk.steps, mean, bulk and bulk.done, rungs,
                )):
                    out[name].append(found)
            kinds = dict(n_tail=pa.int64(), steps=pa.int32(), _done=pa.bool_()) | dict.fromkeys(("w", "mu", "sigma"), pa.list_(pa.float64()))
            rung = pa.struct([(n, pa.int64() if n == "n_tail" else pa.float64()) for n in RUNG])
            arrays = [
                pa.array([[dict(zip(RUNG, r)) for r in v] for v in values], pa.list_(rung))
                if name == "rungs" else pa.array(values, kinds.get(name, pa.float64()))
                for name, values in out.items()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in [*keys, "n", "_v"]] + arrays, names=[*keys, "n", "_v", *out])

    rung = "array<struct<level:double,u:double,n_tail:bigint,xi:double,beta:double,loglik:double>>"
    added = (
        "u double, n_tail long, w array<double>, mu array<double>, sigma array<double>, xi double, beta double, level double, steps int, "
        f"loglik double, _done boolean, rungs {rung}"
    )
    kept = joined.select(*keys, "n", "_v").schema
    return joined.mapInArrow(climbed, type(kept)(kept.fields + joined.sparkSession.createDataFrame([], added).schema.fields))


def fit_affine(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Location and log scale of one normal per state: y = exp(a) z + b."""
    return complete_rows(df, value, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("b"),
        F.when(F.stddev_pop(value) > 0, F.log(F.stddev_pop(value))).alias("a"),
    )


def affine_log_pdf(y: Column) -> Column:
    return normal_log_pdf((y - F.col("b")) * F.exp(-F.col("a")), F.lit(0.0), F.lit(1.0)) - F.col("a")


def fit_kernel_mixture(
    df: DataFrame,
    keys: list[str],
    value: str,
    centres: list[float],
    iterations: int = 10,
    scales: tuple[float, ...] = (0.7, 0.3),
    train_scales: bool = False,
) -> DataFrame:
    """Weights per state of normal kernels at given centres, with scales shared by all states.

    Scales start as shares of the overall standard deviation and stay, unless ``train_scales`` updates
    them with the weights. Output: keys, n and the arrays w, mu, sigma (centre-major order).
    """
    rows = complete_rows(df.select(*keys, F.col(value).alias("_y")), "_y", keys)
    deviation = rows.agg(F.stddev_pop("_y")).first()[0]
    widths = [s * deviation for s in scales]
    where = [(c, j) for c in centres for j in range(len(scales))]
    k = len(where)
    params = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    params = cut(params.select(*keys, "n", *[F.lit(1.0 / k).alias(f"_w{i}") for i in range(k)]))
    for _ in range(iterations):
        joined = attach(rows, params, keys)
        terms = [F.col(f"_w{i}") * normal_pdf(F.col("_y"), F.lit(c), F.lit(widths[j])) for i, (c, j) in enumerate(where)]
        joined = joined.select(*keys, "n", "_y", *[t.alias(f"_k{i}") for i, t in enumerate(terms)])
        joined = joined.withColumn("_d", _sum([F.col(f"_k{i}") for i in range(k)]))
        share = [
            F.when(F.col("_d") > 0, F.col(f"_k{i}") / F.col("_d")).otherwise(F.lit(1.0 / k)) for i in range(k)
        ]
        squares = []
        if train_scales:
            gaps = [F.col("_y") - F.lit(c) for c, _ in where]
            squares = [F.sum(share[i] * gaps[i] * gaps[i]).alias(f"_q{i}") for i in range(k)]
        stepped = cut(
            joined.groupBy(*keys).agg(
                F.first("n").alias("n"), *[F.avg(share[i]).alias(f"_w{i}") for i in range(k)], *squares
            )
        )
        if train_scales:
            widths = _shared_widths(stepped, [j for _, j in where], widths)
            stepped = cut(stepped.drop(*[f"_q{i}" for i in range(k)]))
        params = stepped
    return params.select(
        *keys,
        "n",
        F.array(*[F.col(f"_w{i}") for i in range(k)]).alias("w"),
        F.array(*[F.lit(float(c)) for c, _ in where]).alias("mu"),
        F.array(*[F.lit(float(widths[j])) for _, j in where]).alias("sigma"),
    )


def _shared_widths(stepped: DataFrame, scale_of: list[int], widths: list[float]) -> list[float]:
    """Deviation around the centres per shared scale, over all states (one row of sums)."""
    sums = []
    for j in range(len(widths)):
        own = [i for i, s in enumerate(scale_of) if s == j]
        sums.append(F.sum(_sum([F.col(f"_q{i}") for i in own])).alias(f"q{j}"))
        sums.append(F.sum(F.col("n") * _sum([F.col(f"_w{i}") for i in own])).alias(f"m{j}"))
    row = stepped.agg(*sums).first()
    return [
        (row[f"q{j}"] / row[f"m{j}"]) ** 0.5 if row[f"m{j}"] > 0 and row[f"q{j}"] > 0 else old
        for j, old in enumerate(widths)
    ]
