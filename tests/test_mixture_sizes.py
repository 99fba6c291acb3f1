"""Cross-validated size of a mixture and the refit of the best one, against fits of the rows themselves."""

import numpy as np
import pytest

from dwelltail.operators import fit, mixture_em, selection

FOLDS, SIZES = 4, (1, 2)


def values(n=1_200, seed=8):
    draw = np.random.default_rng(seed)
    return {
        "two": np.where(draw.random(n) < 0.4, draw.normal(5, 1, n), draw.normal(20, 3, n)),
        "one": draw.normal(3, 2, n // 2), "few": draw.normal(0, 1, 12), "same": np.full(90, 4.0),
    }


def frame(spark, data):
    rows = [(s, i % FOLDS, float(v)) for s, y in data.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows + [("two", 0, None), (None, 1, 2.0)], "state string, fold int, y double").repartition(3)


@pytest.mark.parametrize("small", [100, 10**6])
def test_sizes_are_scored_on_the_fold_left_out(spark, small):
    data = values()
    found = {(r["param"], r["fold"]): r["loglik"] for r in selection.cv_mixture(frame(spark, data), ["state"], "y", SIZES, small=small).collect()}
    assert set(found) == {(k, f) for k in SIZES for f in range(FOLDS)}
    for k in SIZES:
        for held in range(FOLDS):
            logs = []
            for name in ("two", "one"):  # the others are too few, or do not vary
                y = data[name]
                part = np.arange(len(y)) % FOLDS
                start = np.full(k, 1 / k), np.quantile(y, [(i + 0.5) / k for i in range(k)], method="inverted_cdf"), np.full(k, y.std())
                train = y[part != held]
                best = mixture_em.settle(train, np.ones(len(train)), start, len(train), y.var(), fit.ITERATIONS, fit.TOLERANCE)
                logs.append(mixture_em.log_density(y[part == held], best.w, best.mu, best.sigma))
            assert found[k, held] == pytest.approx(np.concatenate(logs).mean(), abs=1e-7)


def test_the_best_size_is_fitted_to_all_rows(spark):
    df = frame(spark, values())
    scores = selection.cv_mixture(df, ["state"], "y", SIZES)
    assert {r["param"]: r["is_best"] for r in selection.best_of_grid(scores).collect()} == {1: 0, 2: 1}
    refitted = {r["state"]: r for r in selection.refit_best(df, ["state"], "y", scores).collect()}
    whole = {r["state"]: r for r in fit.fit_gmm(df, ["state"], "y", 2).collect()}
    for name in whole:
        assert refitted[name]["k"] == 2 and refitted[name]["mu"] == whole[name]["mu"] and refitted[name]["status"] == whole[name]["status"]


def test_nothing_to_score(spark):
    none = spark.createDataFrame([], "state string, fold int, y double")
    scores = selection.cv_mixture(none, ["state"], "y", SIZES)
    assert scores.count() == 0 and selection.refit_best(none, ["state"], "y", scores).count() == 0
