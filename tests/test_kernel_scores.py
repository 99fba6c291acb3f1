"""Kernel densities at given rows against sums over all sources."""

import math

import numpy as np
import pytest

from dwelltail.operators import kernels


def log_sum(terms):
    terms = np.array(terms, float)
    top = terms.max()
    return top + math.log(np.exp(terms - top).sum())


def sources(n=600, seed=5):
    draw = np.random.default_rng(seed)
    x1, x2 = draw.integers(0, 6, n), draw.integers(0, 3, n)
    y = np.where(draw.random(n) < 0.9, draw.exponential(20.0, n) + 3 * x1, draw.normal(900, 2, n))
    y[:5] = y[5]  # repeated rows
    return [(int(i), float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(x1, x2, y))]


#: Ordinary places, the gap between the two bulks, far above, far below, x between and outside the sources' states.
ASKED = [(0, 2.0, 1.0, 15.0), (1, 2.0, 1.0, 450.0), (2, 5.0, 2.0, 2000.0), (3, 0.0, 0.0, -3000.0), (4, 2.5, 0.5, 30.0), (5, 9.0, 4.0, 900.0),
         (6, 1.0, 1.0, 150.0), (7, 1.0, 1.0, 150.0), (8, 3.0, 1.0, 1e6)]
SCHEMA = "id long, x1 double, x2 double, y double"


def scores(df):
    return {r["id"]: r["log_pdf"] for r in df.collect()}


@pytest.mark.parametrize("hx", [[0.7, 0.5], [0.1, 0.1]])
def test_ckde_scores(spark, hx):
    rows, hy = sources(), 2.5
    found = scores(kernels.ckde_score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ASKED, SCHEMA), "id", ["x1", "x2"], "y", [*hx, hy]))
    for i, a, b, y in ASKED:
        near = [(-0.5 * ((a - p) / hx[0]) ** 2 - 0.5 * ((b - q) / hx[1]) ** 2, v) for _, p, q, v in rows]
        if max(k for k, _ in near) < -0.5 * kernels.REACH**2:
            assert found[i] is None
            continue
        want = log_sum([k - 0.5 * ((y - v) / hy) ** 2 for k, v in near]) - log_sum([k for k, _ in near]) - math.log(hy * math.sqrt(2 * math.pi))
        assert found[i] == pytest.approx(want, rel=1e-9, abs=1e-8), i


@pytest.mark.parametrize("weighting", ["uniform", "distance"])
def test_nkde_scores(spark, weighting):
    rows, h, eps = sources(), 2.5, 0.6
    found = scores(kernels.nkde_score(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ASKED, SCHEMA), "id", ["x1", "x2"], "y", eps, h, weighting))
    x = np.array([r[1:3] for r in rows])
    spread = x.std(0)
    for i, a, b, y in ASKED:
        gaps = np.sqrt(((((x - [a, b]) / spread) ** 2).sum(1)) / 2)
        chosen = np.flatnonzero(gaps <= eps)
        if len(chosen) <= 5:
            chosen = np.array(sorted(range(len(rows)), key=lambda j: (round(gaps[j], 12), *x[j], j))[:5])
        weight = np.ones(len(chosen)) if weighting == "uniform" else gaps[chosen]
        if not weight.sum() > 0:
            assert found[i] is None
            continue
        used = weight > 0
        terms = np.log(weight[used]) - 0.5 * ((y - np.array([rows[j][3] for j in chosen])[used]) / h) ** 2
        want = log_sum(terms) - math.log(weight.sum() * h * math.sqrt(2 * math.pi))
        assert found[i] == pytest.approx(want, rel=1e-9, abs=1e-8), i


def test_missing_and_empty(spark):
    asked = spark.createDataFrame([(1, 1.0, None, 2.0), (2, 1.0, 1.0, None), (3, 1.0, 1.0, 2.0), (4, float("nan"), 1.0, 2.0)], SCHEMA)
    rows, none = spark.createDataFrame(sources(80), SCHEMA), spark.createDataFrame([], SCHEMA)
    for score in (kernels.ckde_score, kernels.nkde_score):
        found = scores(score(rows, asked, "id", ["x1", "x2"], "y"))
        assert found[3] is not None and [found[i] for i in (1, 2, 4)] == [None] * 3
        assert scores(score(none, asked, "id", ["x1", "x2"], "y")) == dict.fromkeys((1, 2, 3, 4))
        assert scores(score(rows, none, "id", ["x1", "x2"], "y")) == {}


def test_crowded_rows_are_scored_between_nodes(spark, monkeypatch):
    """Many queries in few cells, near and far, do not meet the sources one by one; all agree with sums over all sources."""
    rows, h, eps = sources(), 2.5, 0.6
    places = [12.0 + 0.01 * i for i in range(120)] + [2000.0 + 0.01 * i for i in range(120)] + [460.0 + 0.005 * i for i in range(60)]
    asked = [(i, 2.0, 1.0, y) for i, y in enumerate(places)]
    met, attach = [], kernels.attach

    def noted(left, small, keys, how="inner"):
        if keys[-1] == "_cell" or keys == ["x1", "x2"] and "_mass" in small.columns:
            met.append(left.count())
        return attach(left, small, keys, how)

    monkeypatch.setattr(kernels, "attach", noted)
    found = scores(kernels.nkde_score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), "id", ["x1", "x2"], "y", eps, h))
    assert len(met) >= 2 and sum(met) < 61 * len(asked) / 2
    x = np.array([r[1:3] for r in rows])
    chosen = np.flatnonzero(np.sqrt(((((x - [2.0, 1.0]) / x.std(0)) ** 2).sum(1)) / 2) <= eps)
    assert len(chosen) > kernels.NEAREST
    for i, _, _, y in asked:
        want = log_sum([-0.5 * ((y - rows[j][3]) / h) ** 2 for j in chosen]) - math.log(len(chosen) * h * math.sqrt(2 * math.pi))
        assert found[i] == pytest.approx(want, rel=1e-9, abs=1e-8), i
