"""Exact order statistics against sorting, in every path of the selection."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwelltail.operators.quantiles import conditional_quantiles, lower_tail_mean, measure_states, quantiles_wide
from dwelltail.operators.ranks import disc_rank, select_ranks

LEVELS = [0.01, 0.5, 0.9, 0.99, 0.999]


def skewed(seed, n=6000):
    """A third of the rows in one group, another group of ties, a lone row."""
    rng = np.random.default_rng(seed)
    groups = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n))
    values = np.round(rng.exponential(10.0, n), 2)
    values[groups == 3] = np.round(values[groups == 3] / 20.0)
    rows = [(int(g), float(v)) for g, v in zip(groups, values)]
    return [*rows, (9, 4.5)]


def expected(rows, q):
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    return {g: sorted(vs)[max(1, math.ceil(q * len(vs))) - 1] for g, vs in by.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "options", [{}, {"blocks": 3}, {"accuracy": 20}, {"accuracy": 20, "slack": 0.0}]
)
def test_disc_quantiles_equal_sorting(spark, seed, options):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    found = conditional_quantiles(df, ["g"], "v", LEVELS, **options)
    got = {(r["g"], r["q"]): r["y_q"] for r in found.collect()}
    for q in LEVELS:
        for g, v in expected(rows, q).items():
            assert got[g, q] == v


def test_missed_brackets_are_selected_again(spark):
    """Brackets that cannot hold the rank (negative slack) still end in the exact value."""
    rows = skewed(3)
    df = spark.createDataFrame(rows, "g int, v double")
    found = select_ranks(df, ["g"], "v", {"m": disc_rank(0.5)}, [0.5], accuracy=10, slack=-1.0)
    assert {r["g"]: r["m"] for r in found.collect()} == expected(rows, 0.5)


def test_cont_quantiles_equal_numpy(spark):
    rows = skewed(4)
    df = spark.createDataFrame(rows, "g int, v double")
    for r in quantiles_wide(df, ["g"], "v", LEVELS, "cont").collect():
        values = [v for g, v in rows if g == r["g"]]
        for i, q in enumerate(LEVELS):
            assert r[f"q{i}"] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, None), (None, 5.0), (1, 4.0)], "g int, v double")
    row = quantiles_wide(df, ["g"], "v", [0.5]).first()
    assert (row["n"], row["q0"]) == (2, 2.0)


def test_state_without_rows_keeps_a_row(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "g int, v double")
    requested = spark.createDataFrame([(1,), (7,)], "g int")
    got = {r["g"]: r["mean"] for r in measure_states(df, requested, ["g"], "v", [0.5]).collect()}
    assert got == {1: 3.0, 7: None}


def test_lower_tail_mean(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 11)], "g int, v double")
    row = lower_tail_mean(df, ["g"], "v", 0.25).first()
    assert row["var"] == pytest.approx(3.25)
    assert row["cvar"] == pytest.approx(2.0)


def test_selection_does_not_gather_rows(spark, small):
    """The records are broadcast-joined and pre-aggregated; no exchange carries whole groups."""
    from dwelltail.operators.ranks import _count_within
    from dwelltail.session import cut
    from dwelltail.sources import derived

    rows = derived.dataset(spark, small, "bu").select("state1", F.col("delay").alias("_v"))
    brackets = rows.groupBy("state1").agg(
        F.count("*").alias("n"), F.lit(5).alias("_r0"), F.lit(0.0).alias("_lo0"), F.lit(1e9).alias("_hi0")
    )
    plan = _count_within(rows, cut(brackets), ["state1"], 1, 1, 10**9)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan
