"""Special functions, fits, kernels and scores against closed forms and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwelltail.functions import integrals, mixtures, special
from dwelltail.operators import centres, conditional_net, evaluate, fit, kernels, matching, selection, tails


def test_erfc_against_the_math_library(spark):
    points = [i / 37 for i in range(-222, 963)]
    df = spark.createDataFrame([(x,) for x in points], "x double").select("x", special.erfc(F.col("x")).alias("e"))
    for r in df.collect():
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-13, abs=1e-307)
    own = conditional_net._np_erfc(np.array(points[:600]))
    assert own == pytest.approx([math.erfc(x) for x in points[:600]], rel=1e-12)


def test_softmax_softplus_student(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1000.0],)], "a array<double>")
    assert df.select(special.softmax(F.col("a")).alias("s")).first()["s"] == pytest.approx([0, 0, 1])
    row = spark.range(1).select(
        special.softplus(F.lit(0.0)).alias("a"),
        special.softplus(F.lit(50.0)).alias("b"),
        special.student_t_pdf(F.lit(0.0), F.lit(0.0), F.lit(1.0), 6).alias("t"),
    ).first()
    assert tuple(row) == pytest.approx((math.log(2), 50.0, 0.3827327723098716))


PARAMS = [(1, [0.3, 0.7], [10.0, 30.0], [2.0, 5.0], 40.0, 0.2, 6.0)]


def params(spark):
    df = spark.createDataFrame(
        PARAMS, "state int, w array<double>, mu array<double>, sigma array<double>, u double, xi double, beta double"
    )
    return df.withColumn("norm", mixtures.gmm_tail(F.col("u"), 2))


def phi_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def test_mixture_functions(spark):
    at = [5.0, 25.0, 40.0, 41.0, 80.0]
    df = params(spark).select("*", F.explode(F.array(*[F.lit(y) for y in at])).alias("y"))
    df = mixtures.with_tail(mixtures.with_tail(df, F.col("y"), 2, "g"), F.col("y"), 2, "e", pareto=True)
    rows = df.select(
        "y", "g", "e", "norm",
        mixtures.gmm_tail(F.col("y"), 2).alias("g2"),
        mixtures.emm_tail(F.col("y"), 2).alias("e2"),
        mixtures.gmm_log_pdf(F.col("y"), 2).alias("lp"),
        mixtures.gmm_pdf(F.col("y"), 2).alias("p"),
    ).collect()
    for r in rows:
        y = r["y"]
        want = 0.3 * phi_tail((y - 10) / 2) + 0.7 * phi_tail((y - 30) / 5)
        assert r["g"] == pytest.approx(want, rel=1e-12) == pytest.approx(r["g2"], rel=1e-12)
        tail = want if y <= 40 else r["norm"] * (1 + 0.2 * (y - 40) / 6) ** (-5)
        assert r["e"] == pytest.approx(tail, rel=1e-12) == pytest.approx(r["e2"], rel=1e-12)
        assert r["lp"] == pytest.approx(math.log(r["p"]), rel=1e-9)


def test_quantiles_invert_the_tail(spark):
    df = params(spark).select("*", F.explode(F.array(*[F.lit(q) for q in (0.1, 0.5, 0.9, 0.999, 0.99999)])).alias("q"))
    df = df.withColumn("e", mixtures.emm_quantile(F.col("q"), 2)).withColumn("g", mixtures.gmm_quantile(F.col("q"), 2))
    df = mixtures.with_tail(mixtures.with_tail(df, F.col("e"), 2, "te", pareto=True), F.col("g"), 2, "tg")
    for r in df.collect():
        assert r["te"] == pytest.approx(1 - r["q"], rel=1e-9)
        assert r["tg"] == pytest.approx(1 - r["q"], rel=1e-9)


def test_pareto_limits(spark):
    df = spark.range(1).select(
        mixtures.gpd_tail(F.lit(3.0), F.lit(0.0), F.lit(2.0)).alias("exponential"),
        mixtures.gpd_tail(F.lit(5.0), F.lit(-0.5), F.lit(2.0)).alias("beyond"),
        mixtures.gpd_pdf(F.lit(0.0), F.lit(0.3), F.lit(2.0)).alias("start"),
    )
    assert tuple(df.first()) == pytest.approx((math.exp(-1.5), 0.0, 0.5))


def test_moments_and_shortfall_by_integration(spark):
    df = params(spark)
    lo, hi = F.lit(-40.0), F.lit(90.0)
    shape = integrals.density_moments(df, ["state"], lambda y: mixtures.gmm_pdf(y, 2), lo, hi, 20001).first()
    closed = df.select(mixtures.mixture_mean(2).alias("m"), mixtures.mixture_variance(2).alias("v")).first()
    assert (shape["mean"], shape["std"] ** 2) == pytest.approx((closed["m"], closed["v"]), rel=1e-9)
    risky = df.withColumn("var", mixtures.gmm_quantile(F.lit(0.05), 2))
    cvar = risky.select(mixtures.mixture_cvar(F.col("var"), 0.05, 2).alias("c")).first()["c"]
    below = integrals.trapezoid(risky, ["state"], lo, F.col("var"), 20001, m=lambda y: y * mixtures.gmm_pdf(y, 2))
    assert cvar == pytest.approx(below.first()["m"] / 0.05, rel=1e-6)
    carlo = integrals.monte_carlo(
        df, ["state"], F.lit(24.0), F.lit(20.0), 20000, 3, mass=lambda y: mixtures.gmm_pdf(y, 2)
    )
    assert carlo.first()["mass"] == pytest.approx(1.0, abs=0.05)


def draws(seed=1, n=6000):
    rng = np.random.default_rng(seed)
    rows = []
    for s, (a, b) in enumerate([(10.0, 30.0), (5.0, 50.0)]):
        pick = rng.random(n) < 0.4
        rows += [(s, float(v)) for v in np.where(pick, rng.normal(a, 2.0, n), rng.normal(b, 4.0, n))]
    return rows


def test_mixture_fit_recovers_components(spark):
    df = spark.createDataFrame([*draws(), (7, 1.0), (7, 2.0)], "state int, y double")
    found = {r["state"]: r for r in fit.fit_gmm(df, ["state"], "y", 2, 12).collect()}
    for s, means in ((0, (10.0, 30.0)), (1, (5.0, 50.0))):
        pairs = sorted(zip(found[s]["mu"], found[s]["w"], found[s]["sigma"]))
        assert [p[0] for p in pairs] == pytest.approx(means, abs=0.3)
        assert pairs[0][1] == pytest.approx(0.4, abs=0.03) and pairs[0][2] == pytest.approx(2.0, abs=0.2)
    assert found[7]["status"] == "few_rows" and found[7]["w"] is None


def test_kernel_mixture_trains_shared_scales(spark):
    rng = np.random.default_rng(12)
    rows = [(s, float(rng.normal(0.0 if rng.random() < p else 50.0, 3.0))) for s, p in ((0, 0.2), (1, 0.7)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "state int, y double")
    found = {r["state"]: r for r in fit.fit_kernel_mixture(df, ["state"], "y", [0.0, 50.0], 6, (0.7,), True).collect()}
    assert found[0]["sigma"] == pytest.approx([3.0, 3.0], abs=0.15)
    assert (found[0]["w"][0], found[1]["w"][0]) == pytest.approx((0.2, 0.7), abs=0.03)


def test_pareto_fits_recover_shape(spark):
    rng = np.random.default_rng(2)
    values = 3.0 / 0.2 * ((1 - rng.random(40000)) ** -0.2 - 1)
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 5.0)] * 200, "state int, y double")
    moments = {r["state"]: r for r in tails.gpd_fit_moments(df, ["state"], "y", 0.9).collect()}
    assert moments[1]["xi"] == pytest.approx(0.2, abs=0.08)
    assert moments[2]["status"] == "few_excesses" and moments[2]["xi"] is None
    profile = tails.gpd_fit_profile(df, ["state"], "y", 0.9).filter("state = 1").first()
    assert profile["xi"] == pytest.approx(0.2, abs=0.1)
    emm = {r["state"]: r for r in fit.fit_emm(df, ["state"], "y", 2, 5, 0.9).collect()}
    assert emm[1]["status"] == "ok" and emm[1]["norm"] == pytest.approx(0.1, abs=0.05)
    assert emm[2]["status"] == "constant"


def test_hill_histogram_and_tail_edges(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 21)] + [(2, 4.0)], "state int, y double")
    hill = {r["state"]: r for r in tails.hill_index(df, ["state"], "y", 0.2).collect()}
    want = 1 / (sum(math.log(v / 16) for v in (17, 18, 19, 20)) / 4)
    assert (hill[1]["alpha"], hill[1]["xk"], hill[1]["k"]) == pytest.approx((want, 16.0, 4))
    assert tuple(hill[2])[1:] == (0.0, 0.0, 0, 0)
    bins = tails.conditional_histogram(df.filter("state = 1"), ["state"], "y", 0.0, 20.0, 4).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [4, 5, 5, 6]  # 20 belongs to the closed last bin
    tenth = spark.createDataFrame([(1, v / 10) for v in range(0, 10)], "state int, y double")
    counts, _ = np.histogram([v / 10 for v in range(0, 10)], bins=[i * 0.1 for i in range(11)])
    got = {r["bin"]: r["count"] for r in tails.conditional_histogram(tenth, ["state"], "y", 0.0, 1.0, 10).collect()}
    assert [got.get(i, 0) for i in range(10)] == list(counts)
    over = {r["t"]: r["tail"] for r in tails.tail_probability(df.filter("state = 1"), ["state"], "y", [10.0]).collect()}
    assert over == {10.0: 0.5}
    grids = tails.tail_grid(df, ["state"], "y", points=5)
    curve = tails.tail_curve(df, grids, ["state"], "y", points=5).filter("state = 1").orderBy("j").collect()
    values = list(range(1, 21))
    assert [r["tail"] for r in curve] == [sum(v >= r["t"] for v in values) / 20 for r in curve]
    longer = tails.tail_grid(df, ["state"], "y", points=5, to_maximum=True).filter("state = 1").first()
    assert (longer["lo"], longer["hi"]) == (17.0, 21.0)


def kernel_table(seed=4, n=240):
    """Whole-number x, a sparse x far away, and an isolated y."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, n)
    rows = [(i, float(x[i]), float(np.round(rng.normal(10 + x[i], 2.0), 3))) for i in range(n)]
    return [*rows, (n, 2.0, 90.0), (n + 1, 60.0, 11.0), (n + 2, 60.0, 12.5)]


def brute_weights(xs, q, eps, ids):
    dist = np.abs(xs - q)
    near = dist <= eps
    if near.sum() <= 5:
        near = np.zeros(len(xs), bool)
        near[np.lexsort((ids, xs, dist))[:5]] = True
    return near


def test_neighbour_density_equals_loop(spark):
    rows = kernel_table()
    df = spark.createDataFrame(rows, "id long, x double, y double")
    ids, x, y = (np.array(c) for c in zip(*rows))
    z = (x - x.mean()) / x.std()
    eps, h = 0.2, 1.5
    found = {(r["x"], r["y"]): r["log_pdf"] for r in kernels.nkde(df, ["x"], "y", [9.0, 12.0], eps, h, order="id").collect()}
    for q in set(x):
        near = brute_weights(z, (q - x.mean()) / x.std(), eps, ids)
        for p in (9.0, 12.0):
            k = np.exp(-0.5 * ((p - y[near]) / h) ** 2) / (h * math.sqrt(2 * math.pi))
            assert found[q, p] == pytest.approx(math.log(k.mean()), rel=1e-9)


def test_leave_one_out_equals_loop(spark):
    """Includes rows of a sparse state and a row that no kernel reaches in double precision."""
    rows = kernel_table()
    df = spark.createDataFrame(rows, "id long, x double, y double")
    ids, x, y = (np.array(c) for c in zip(*rows))
    z = (x - x.mean()) / x.std()
    got = {(r["bandwidth"], r["epsilon"]): r["loglik"] for r in kernels.nkde_loo(df, "id", ["x"], "y", [1.0, 3.0], [0.05, 0.2]).collect()}
    for h in (1.0, 3.0):
        for eps in (0.05, 0.2):
            total = 0.0
            for i in range(len(x)):
                near = brute_weights(z, z[i], eps, ids)
                size = near.sum()
                near[i] = False
                e = -0.5 * ((y[i] - y[near]) / h) ** 2
                total += e.max() + math.log(np.exp(e - e.max()).sum()) - math.log((size - 1) * h * math.sqrt(2 * math.pi))
            assert got[h, eps] == pytest.approx(total / len(x), rel=1e-6)


def test_conditional_kde_equals_loop(spark):
    rows = kernel_table(6)
    df = spark.createDataFrame(rows, "id long, x double, y double")
    _, x, y = (np.array(c) for c in zip(*rows))
    n = len(x)
    hx, hy = 1.06 * x.std() * n ** (-1 / 6), 1.06 * y.std() * n ** (-1 / 6)
    pdf = {(r["x"], r["y"]): r["pdf"] for r in kernels.ckde(df, ["x"], "y", [9.0, 20.0]).collect()}
    cdf = {(r["x"], r["y"]): r["cdf"] for r in kernels.ckde(df, ["x"], "y", [9.0, 20.0], "cdf").collect()}
    for q in set(x):
        kx = np.exp(-0.5 * ((q - x) / hx) ** 2)
        for p in (9.0, 20.0):
            ky = np.exp(-0.5 * ((p - y) / hy) ** 2) / (hy * math.sqrt(2 * math.pi))
            assert pdf[q, p] == pytest.approx((kx * ky).sum() / kx.sum(), rel=1e-9)
            ks = np.array([1 - phi_tail((p - v) / hy) for v in y])
            assert cdf[q, p] == pytest.approx((kx * ks).sum() / kx.sum(), rel=1e-9)


def test_cross_validated_kde_equals_loop(spark):
    rows = [(i, x, y, i % 3) for i, x, y in kernel_table(7)]
    df = spark.createDataFrame(rows, "id long, x double, y double, fold int")
    _, x, y, fold = (np.array(c) for c in zip(*rows))
    n = len(x)
    got = {(r["param"], r["fold"]): r["loglik"] for r in selection.cv_ckde(df, "id", ["x"], "y", [0.5, 1.0]).collect()}
    for m in (0.5, 1.0):
        hx, hy = m * 1.06 * x.std() * n ** (-1 / 6), m * 1.06 * y.std() * n ** (-1 / 6)
        for f in range(3):
            train, scores = fold != f, []
            for i in np.where(fold == f)[0]:
                a = -0.5 * ((x[i] - x[train]) / hx) ** 2
                e = a - 0.5 * ((y[i] - y[train]) / hy) ** 2
                mass = np.exp(a).sum()
                scores.append(e.max() + math.log(np.exp(e - e.max()).sum()) - math.log(mass * hy * math.sqrt(2 * math.pi)))
            assert got[m, f] == pytest.approx(np.mean(scores), rel=1e-6)


def test_distance_weights_and_squared_distance(spark):
    df = spark.createDataFrame([(1.0, 0.0, 3), (2.0, 0.0, 1)], "x double, dist double, take int")
    pairs = spark.createDataFrame([(1.0, 1.0, 0.0, 6), (1.0, 2.0, 0.5, 4)], "x double, near_x double, dist double, take int")
    weights = [r["weight"] for r in matching.neighbor_weights(pairs, ["x"], "distance").orderBy("near_x").collect()]
    assert weights == pytest.approx([0.0, 0.25])
    found = matching.distances_to(df, ["x", "dist"], [(4.0, 4.0)], squared=True).first()["dist"]
    assert found == [25.0]


def test_least_squares_density_integrates_to_one(spark):
    rows = kernel_table(9)[:240]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    means, stds = matching.scales_of(df, ["x", "y"])
    chosen = [((r[1] - means[0]) / stds[0], (r[2] - means[1]) / stds[1]) for r in rows[:12]]
    fitted = kernels.lscde_fit(df, ["x"], "y", chosen)
    alpha = kernels.lscde_alpha(fitted, chosen, regularization=0.1)
    assert len(alpha) == 12 and min(alpha) > 0
    grid = spark.createDataFrame([(2.0, -40.0 + 0.1 * i) for i in range(1000)], "x double, y double")
    mass = kernels.lscde_pdf(grid, df, ["x"], "y", chosen, alpha).agg(F.sum("pdf") * 0.1).first()[0]
    assert mass == pytest.approx(1.0, abs=1e-6)
    many = spark.range(4000).select("id", F.lit(2.0).alias("x"))
    drawn = kernels.lscde_sample(many, df, ["x"], "y", chosen, alpha, "id").agg(F.avg("sample"), F.stddev_pop("sample")).first()
    at = spark.createDataFrame([(2.0, 12.0)], "x double, y double")
    want = kernels.lscde_pdf(at, df, ["x"], "y", chosen, alpha).first()
    assert tuple(drawn) == pytest.approx((want["mean"], want["std"]), rel=0.05)


def test_centres(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 10.0, 0.0), (3, 0.0, 9.0), (4, 10.0, 9.0)], "id long, x double, y double")
    assert [c[0] for c in centres.centres_farthest(df, ["x", "y"], 3, "id")] == [0, 4, 2]
    assert centres.centres_random(df, ["x"], 3, "id").count() == 3
    assert centres.centres_kmeans(df, ["x", "y"], 2).count() == 2
    edges = centres.centres_edges(df, ["x", "y"], 4, "id")
    assert len({c[0] for c in edges}) == 2
    assert centres.without(df, "id", edges).count() == 3


def test_affine_selection_prefers_the_true_width(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i % 2, float(rng.normal(5, 2)), i % 4) for i in range(4000)], "state int, y double, fold int")
    best = selection.best_of_grid(selection.cv_affine(df, ["state"], "y", [0.5, 1.0, 2.0]))
    assert {r["param"]: r["is_best"] for r in best.collect()} == {0.5: 0, 1.0: 1, 2.0: 0}


def test_network_gradient_and_fit(spark):
    rng = np.random.default_rng(5)
    for tail in (False, True):
        shape = conditional_net.Shape(1, 2, tail)
        flat = shape.start(3)
        x, y, w = rng.normal(size=(7, 1)), rng.normal(size=7), np.ones(7)
        _, slope = conditional_net.batch_gradient(shape, flat, x, y, w, 0.1)
        for i in rng.integers(0, shape.length, 12):
            step = np.zeros(shape.length)
            step[i] = 1e-5
            up = conditional_net.batch_gradient(shape, flat + step, x, y, w, 0.1)[0]
            down = conditional_net.batch_gradient(shape, flat - step, x, y, w, 0.1)[0]
            assert slope[i] == pytest.approx((up - down) / 2e-5, abs=1e-3, rel=1e-3)
    rows = [(int(s), float(rng.normal(10 * s, 1 + s))) for s in rng.integers(0, 3, 3000)]
    df = spark.createDataFrame(rows, "state int, y double")
    net = conditional_net.fit_conditional_net(df, ["state"], "y", k=2, steps=60, learning_rate=0.05)
    assert net.losses[-1] < net.losses[0] - 0.3
    found = net.parameters(df.select("state").distinct())
    means = {r["state"]: r["m"] for r in found.select("state", mixtures.mixture_mean(2).alias("m")).collect()}
    assert [means[s] for s in range(3)] == pytest.approx([0, 10, 20], abs=3)


def test_violation_probability_matches_counting(spark):
    rows = draws(9)
    df = spark.createDataFrame(rows, "state int, y double")
    fitted = fit.fit_gmm(df, ["state"], "y", 2, 12)
    for r in evaluate.calibration(df, fitted, ["state"], "y", [12.0, 30.0], "gmm", 2).collect():
        assert r["predicted"] == pytest.approx(r["observed"], abs=0.02)
    plan = evaluate.violation_probability(
        df.withColumn("budget", F.lit(20.0)), fitted, ["state"], "budget", "gmm", 2
    )._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_log_densities_are_never_null(spark):
    """Weight 0 plays no part; beyond the end point of a negative shape the density is 0, its logarithm minus infinity."""
    row = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 5.0], [2.0, 1.0], 3.0, -0.5, 1.0, 0.1, 9.0)],
        "w array<double>, mu array<double>, sigma array<double>, u double, xi double, beta double, norm double, y double",
    )
    zero, dead = row.select(mixtures.gmm_log_pdf(F.lit(1.0), 2), mixtures.emm_log_pdf(F.col("y"), 2)).first()
    assert zero == pytest.approx(math.log(math.exp(-0.125) / (2 * math.sqrt(2 * math.pi)))) and dead == -math.inf
    none = row.withColumn("w", F.array(F.lit(0.0), F.lit(0.0))).select(mixtures.gmm_log_pdf(F.lit(1.0), 2)).first()[0]
    assert none == -math.inf


def test_value_at_risk_below_zero(spark):
    """Against a plain search and the closed form of one normal; a scaled bulk with a Pareto tail by numbers."""
    df = spark.createDataFrame([([1.0], [1.0], [2.0])], "w array<double>, mu array<double>, sigma array<double>")
    risk = df.withColumn("v", mixtures.gmm_value_at_risk(0.05, 1))
    at, mean = risk.select("v", mixtures.mixture_cvar(F.col("v"), 0.05, 1)).first()
    assert at == pytest.approx(1 - 2 * 1.6448536269514722) and mean == pytest.approx(1 - 2 * 2.0627128075074253, rel=1e-6)
    by_parts = risk.select(mixtures.cvar_by_integral(lambda y: mixtures.gmm_pdf(y, 1), F.col("v"), F.lit(-30.0), 0.05, 4000)).first()[0]
    assert by_parts == pytest.approx(mean, abs=1e-4)


def test_tail_mass_of_the_pareto_mixture(spark):
    rng = np.random.default_rng(15)
    df = spark.createDataFrame([(s, float(v)) for s in (0, 1) for v in rng.exponential(50, 3000)], "state int, y double")
    fitted = fit.fit_emm(df, ["state"], "y", 2)
    for row in fitted.collect():
        assert row["status"] == "ok" and row["norm"] == pytest.approx(row["n_tail"] / row["n"]) and row["steps"] > 3
    ends = fitted.select((mixtures.emm_tail(F.col("u"), 2) - F.col("norm")).alias("gap"), mixtures.emm_tail(F.lit(-1e6), 2).alias("whole"))
    for row in ends.collect():
        assert abs(row["gap"]) < 1e-9 and row["whole"] == pytest.approx(1.0)


def test_fit_stops_when_settled(spark):
    df = spark.createDataFrame(draws(), "state int, y double")
    found = fit.fit_gmm(df, ["state"], "y", 2).collect()
    assert all(3 < r["steps"] < fit.ITERATIONS for r in found)
    rows = draws()
    for r in found:
        own = np.array([y for s, y in rows if s == r["state"]])
        dens = sum(w * np.exp(-0.5 * ((own - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for w, m, s in zip(r["w"], r["mu"], r["sigma"]))
        assert r["loglik"] == pytest.approx(np.log(dens).mean(), rel=1e-3)


def test_kernels_take_missing_and_constant_coordinates(spark):
    rows = [(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (None, 4.0), (3.0, None), (2.0, 2.0), (2.5, 1.0), (1.0, 1.5), (2.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    far = {(r["x"], r["y"]): r["log_pdf"] for r in kernels.nkde(df, ["x"], "y", [2.0, 5000.0], bandwidth=0.7, order="y").collect()}
    assert set(far) == {(x, p) for x in (1.0, 2.0, 2.5) for p in (2.0, 5000.0)} and all(v is not None and v > -1e9 for v in far.values())
    assert kernels.ckde(df, ["x"], "y", [2.0]).count() == 3
    flat = df.withColumn("x", F.lit(1.0))
    assert kernels.nkde(flat, ["x"], "y", [2.0], bandwidth=0.7).count() == 1
