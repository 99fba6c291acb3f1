"""Settled mixtures: the leaps against plain steps, the cells against the records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwelltail.operators import cells, fit, mixture_em


def sample(seed=3, n=5_000):
    draw = np.random.default_rng(seed)
    return {
        "skewed": draw.exponential(50.0, n), "two": np.where(draw.random(n) < 0.3, draw.normal(5, 1, n), draw.normal(20, 4, n)),
        "far": np.where(draw.random(n) < 0.999, draw.normal(0, 1, n), draw.normal(0, 1, n) * 1e5),
        "narrow": np.where(draw.random(n) < 0.5, draw.normal(0, 1, n), draw.normal(1.5, 0.004, n)), "ties": np.round(draw.exponential(3.0, n)),
    }


def start(y, k):
    return np.full(k, 1 / k), np.quantile(y, [(i + 0.5) / k for i in range(k)], method="inverted_cdf"), np.full(k, y.std())


@pytest.mark.parametrize("name", ["skewed", "two"])
@pytest.mark.parametrize("tail", [False, True])
def test_leaps_end_where_plain_steps_do(name, tail):
    y = sample()[name]
    n, variance = len(y), y.var()
    theta, censored = start(y, 2), None
    if tail:
        u = np.quantile(y, 0.95, method="inverted_cdf")
        y, censored = y[y <= u], (u, float((y > u).sum()))
    found = mixture_em.settle(y, np.ones(len(y)), theta, n, variance, fit.ITERATIONS, fit.TOLERANCE, censored)
    assert found.done and found.steps < 400
    for _ in range(10_000):
        *theta, loglik = mixture_em.step(y, np.ones(len(y)), *theta, n, variance, censored)
    for got, want in zip((found.w, found.mu, found.sigma), theta):
        assert got == pytest.approx(want, rel=1e-6)
    assert found.loglik == pytest.approx(loglik, rel=1e-12)


def test_a_stop_has_no_unit():
    y = sample()["skewed"]
    fits = [mixture_em.settle(y * c, np.ones(len(y)), start(y * c, 3), len(y), (y * c).var(), fit.ITERATIONS, fit.TOLERANCE) for c in (1.0, 1e-6, 1e6)]
    for c, found in zip((1e-6, 1e6), fits[1:]):
        assert found.w == pytest.approx(fits[0].w, rel=1e-6) and found.sigma == pytest.approx(fits[0].sigma * c, rel=1e-6)


def frame(spark, values):
    rows = [(name, float(v)) for name, y in values.items() for v in y]
    return spark.createDataFrame(rows, "state string, _y double").repartition(4)


def test_nodes_carry_every_sum(spark):
    values = sample()
    rows = frame(spark, values)
    places = rows.groupBy("state").agg(F.count("*").alias("n"), F.median("_y").alias("_a"), (F.stddev("_y") / 2).alias("_b"))
    known = {r["state"]: r for r in places.collect()}
    table = cells.summarise(rows, places, ["state"], F.when(F.col("_y") > F.col("_a"), 1).otherwise(0), small=100).toArrow()
    for i in range(table.num_rows):
        state, r = table["state"][i].as_py(), known[table["state"][i].as_py()]
        part, node, weight = cells.read_nodes(table["cells"][i], r["_a"], r["_b"])
        y = values[state]
        assert len(node) < 30_000
        for side in (0, 1):
            own, w, at = y[(y > r["_a"]) == side], weight[part == side], node[part == side]
            assert w.sum() == pytest.approx(len(own)) and w @ at == pytest.approx(own.sum(), rel=1e-9, abs=1e-6)
            assert w @ at**2 == pytest.approx((own**2).sum(), rel=1e-9)
            for scale in (0.5, 3.0):
                z, zn = (own - r["_a"]) / (r["_b"] * scale), (at - r["_a"]) / (r["_b"] * scale)
                assert w @ np.exp(-zn * zn / 2) == pytest.approx(np.exp(-z * z / 2).sum(), rel=1e-10, abs=1e-9)


def test_cells_give_the_fit_of_the_records(spark):
    values = sample()
    df = frame(spark, values).withColumnRenamed("_y", "y")
    by_cells = {r["state"]: r for r in fit.fit_gmm(df, ["state"], "y", 2, small=100).collect()}
    by_rows = {r["state"]: r for r in fit.fit_gmm(df, ["state"], "y", 2, small=10**6).collect()}
    for name, y in values.items():
        found = mixture_em.settle(y, np.ones(len(y)), start(y, 2), len(y), y.var(), fit.ITERATIONS, fit.TOLERANCE)
        for got in (by_cells[name], by_rows[name]):
            assert got["settled"] and got["loglik"] == pytest.approx(found.loglik / len(y), abs=1e-8)
            for column, want in (("w", found.w), ("mu", found.mu), ("sigma", found.sigma)):
                assert got[column] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-5 * y.std())


def test_censored_cells_and_small_states(spark):
    values = {"a": sample()["skewed"], "b": sample()["two"][:15], "c": np.array([1.0]), "d": np.full(400, 2.0)}
    df = frame(spark, values).withColumnRenamed("_y", "y")
    fits = [{r["state"]: r for r in fit.fit_emm(df, ["state"], "y", 2, small=small).collect()} for small in (100, 10**6)]
    one, other = (f["a"] for f in fits)
    assert one["w"] == pytest.approx(other["w"], rel=1e-6) and one["sigma"] == pytest.approx(other["sigma"], rel=1e-6)
    assert one["u"] == other["u"] and one["norm"] == pytest.approx(0.05, abs=0.001)
    assert {s: fits[0][s]["status"] for s in "abcd"} == {"a": "ok", "b": "few_rows", "c": "few_rows", "d": "constant"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "state string, y double")
    assert fit.fit_gmm(none, ["state"], "y").count() == 0 and fit.fit_emm(none, ["state"], "y").count() == 0
