"""Predicted against measured: quantile errors, tail errors, violation probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.functions import mixtures
from dwelltail.operators.quantiles import conditional_quantiles, union_all
from dwelltail.operators.tails import conditional_histogram, tail_curve, tail_grid
from dwelltail.session import attach, complete_rows, cut

FLOOR = 1e-16


def quantile_of(model: str, k: int) -> Callable[[Column], Column]:
    return (lambda q: mixtures.gmm_quantile(q, k)) if model == "gmm" else (lambda q: mixtures.emm_quantile(q, k))


def add_tail(df: DataFrame, y: Column, model: str, k: int, out: str) -> DataFrame:
    return mixtures.with_tail(df, y, k, out, pareto=model != "gmm")


def pdf_of(model: str, k: int) -> Callable[[Column], Column]:
    return (lambda y: mixtures.gmm_pdf(y, k)) if model == "gmm" else (lambda y: mixtures.emm_pdf(y, k))


def fitted(params: DataFrame) -> DataFrame:
    return params.filter(F.col("status") == "ok")


def quantile_errors(
    measured: DataFrame, params: DataFrame, keys: list[str], model: str, k: int
) -> DataFrame:
    """model, keys, q, rel_err = (predicted - measured) / measured, p_state.

    ``measured`` is the long quantile table (keys, n, q, y_q) of the test rows, ``params`` a fit
    of the same states; both have one row (per level) and state.
    """
    total = measured.groupBy(*keys).agg(F.first("n").alias("n")).agg(F.sum("n")).scalar()
    predicted = quantile_of(model, k)(F.col("q"))
    joined = measured.join(fitted(params).drop("n"), keys)
    return joined.select(
        F.lit(model).alias("model"),
        *keys,
        "q",
        F.try_divide(predicted - F.col("y_q"), F.col("y_q")).alias("rel_err"),
        (F.col("n") / total).alias("p_state"),
    )


def tail_errors(measured: DataFrame, params: DataFrame, keys: list[str], model: str, k: int) -> DataFrame:
    """model, q, log10_err: mean over states of |log10 tail(y_q) - log10(1 - q)|, floor 1e-16."""
    joined = add_tail(measured.join(fitted(params).drop("n"), keys), F.col("y_q"), model, k, "_tail")
    error = F.abs(F.log10(F.greatest("_tail", F.lit(FLOOR))) - F.log10(1 - F.col("q")))
    return joined.groupBy(F.lit(model).alias("model"), "q").agg(F.avg(error).alias("log10_err"))


def error_summary(errors: DataFrame, groups: tuple[str, ...] = ("model", "q")) -> DataFrame:
    """Mean absolute error and the shares of states with a negative or other error."""
    return errors.groupBy(*groups).agg(
        F.avg(F.abs("rel_err")).alias("mean_abs_err"),
        F.avg((F.col("rel_err") < 0).cast("double")).alias("share_negative"),
        F.avg((F.col("rel_err") >= 0).cast("double")).alias("share_other"),
    )


def violation_probability(
    requests: DataFrame, params: DataFrame, keys: list[str], budget: str, model: str, k: int
) -> DataFrame:
    """``dvp``: probability that the delay of a record in its state exceeds the budget."""
    small = cut(fitted(params).drop("n", "n_tail", "status", "steps", "loglik"))
    scored = add_tail(attach(requests, small, keys), F.col(budget), model, k, "dvp")
    return scored.select(*requests.columns, "dvp")


def calibration(
    rows: DataFrame, params: DataFrame, keys: list[str], value: str, budgets: list[float], model: str, k: int
) -> DataFrame:
    """keys, budget, n, observed share above the budget, mean predicted probability, their ratio."""
    counted = complete_rows(rows, value, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.avg((F.col(value) > F.lit(float(b))).cast("double")).alias(f"o{i}") for i, b in enumerate(budgets)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(float(b)).alias("budget"), F.col(f"o{i}").alias("observed"))
            for i, b in enumerate(budgets)
        ]
    )
    measured = counted.select(*keys, "n", F.inline(pairs))
    joined = measured.join(fitted(params).drop("n", "n_tail", "steps", "loglik"), keys)
    scored = add_tail(joined, F.col("budget"), model, k, "predicted")
    return scored.select(*keys, "budget", "n", "observed", "predicted")


def log_likelihood(rows: DataFrame, params: DataFrame, keys: list[str], value: str, models: dict[str, Column]) -> DataFrame:
    """model, n, loglik: mean conditional log density of all rows under each model.

    ``models`` maps a name to a log density over the columns of one joined parameter table.
    """
    scored = attach(complete_rows(rows, value, keys), params, keys)
    wide = scored.agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"_l{i}") for i, c in enumerate(models.values())]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(f"_l{i}").alias("loglik"))
            for i, name in enumerate(models)
        ]
    )
    return wide.select("n", F.inline(pairs)).select("model", "n", "loglik")


def state_report(
    rows: DataFrame,
    params: DataFrame,
    keys: list[str],
    value: str,
    levels: list[float],
    lo: float,
    hi: float,
    bins: int,
    model: str,
    k: int,
) -> DataFrame:
    """One long table (keys, kind, x, series, value) with all that a state's report shows.

    Kinds: ``pdf`` (histogram and model density), ``tail`` (measured and model curve),
    ``quantile`` (measured, model, ratio), ``exceed`` (rows at or above the quantile),
    ``tail_error`` (log10 error at the quantile), ``mean`` and ``count``.
    """
    params = cut(fitted(params))
    model_columns = params.drop("n", "n_tail", "status", "steps", "loglik")
    rows = complete_rows(rows, value, keys)

    def shaped(df: DataFrame, kind: str, x: Column, series: dict[str, Column]) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(s).alias("series"), c.cast("double").alias("value")) for s, c in series.items()]
        )
        return df.select(*keys, F.lit(kind).alias("kind"), x.cast("double").alias("x"), F.inline(cells))

    histogram = conditional_histogram(rows, keys, value, lo, hi, bins).join(model_columns, keys)
    pdf = shaped(
        histogram, "pdf", F.col("x"), {"data": F.col("density"), model: pdf_of(model, k)(F.col("x"))}
    )
    curve = tail_curve(rows, cut(tail_grid(rows, keys, value)), keys, value).join(model_columns, keys)
    curve = add_tail(curve, F.col("t"), model, k, "_model")
    tail = shaped(curve, "tail", F.col("t"), {"data": F.col("tail"), model: F.col("_model")})
    measured = cut(conditional_quantiles(rows, keys, value, levels, "cont")).join(model_columns, keys)
    predicted = measured.withColumn("_p", quantile_of(model, k)(F.col("q")))
    quantile = shaped(
        predicted, "quantile", F.col("q"), {"data": F.col("y_q"), model: F.col("_p"), "ratio": F.col("_p") / F.col("y_q")}
    )
    measured = add_tail(measured, F.col("y_q"), model, k, "_tail")
    error = F.abs(F.log10(F.greatest("_tail", F.lit(FLOOR))) - F.log10(1 - F.col("q")))
    tail_error = shaped(measured, "tail_error", F.col("q"), {model: error})
    wide = measured.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == q, F.col("y_q"))).alias(f"q{i}") for i, q in enumerate(levels)]
    )
    counted = attach(rows, wide, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        *[F.sum((F.col(value) >= F.col(f"q{i}")).cast("long")).alias(f"c{i}") for i in range(len(levels))],
    )
    counted = cut(counted).join(model_columns, keys)
    exceed = union_all(
        [shaped(counted, "exceed", F.lit(float(q)), {"data": F.col(f"c{i}")}) for i, q in enumerate(levels)]
    )
    mean = shaped(
        counted, "mean", F.lit(0.0), {"data": F.col("mean"), model: mixtures.mixture_mean(k)}
    )
    count = shaped(counted, "count", F.lit(0.0), {"data": F.col("n")})
    return union_all([pdf, tail, quantile, tail_error, exceed, mean, count])
