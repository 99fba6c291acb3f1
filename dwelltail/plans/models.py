"""Fitted distributions: mixtures, tails, kernels, their scores and their evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dwelltail.functions import integrals, mixtures
from dwelltail.operators import (
    centres,
    conditional_net,
    evaluate,
    fit,
    kernels,
    quantiles,
    sampling,
    selection,
)
from dwelltail.plans import fit_sql as q
from dwelltail.plans.ground_truth import GPD
from dwelltail.plans.registry import (
    BC,
    EV,
    KERN,
    TAIL,
    hash_sql,
    level_list,
    normal_sql,
    query,
    rounded,
    scratch,
    uniform_sql,
)
from dwelltail.session import attach, cut
from dwelltail.sources import derived, io
from dwelltail.sources.schemas import EVALUATION, PARAMETERS

K, BULK = q.K, q.BULK
STATE = ["state"]
GM = f"{TAIL},\n{q.em_sql('tl', STATE, K, 'gm')}"
EM = f"{TAIL},\n{q.emm_sql('tl', STATE, BULK, 'em')}"
TARGETS = [50.0, 100.0, 200.0, 400.0]
TARGET_SQL = f"t as (select unnest({level_list(TARGETS)}) as y)"


def gmm(spark, sf):
    return fit.fit_gmm(derived.tail_rows(spark, sf), STATE, "y", K)


def emm(spark, sf):
    return fit.fit_emm(derived.tail_rows(spark, sf), STATE, "y", BULK)


def at_targets(params, targets=TARGETS):
    listed = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("y")
    return params.select("*", listed)


def flat(params, k, extra=()):
    """w, mu, sigma as numbered columns."""
    columns = []
    for i in range(k):
        columns += [F.col("w")[i].alias(f"w{i}"), F.col("mu")[i].alias(f"m{i}"), F.col("sigma")[i].alias(f"s{i}")]
    keys = [c for c in params.columns if c.startswith("state") or c in ("n", "n_train", "replica")]
    return params.select(*keys, *columns, *extra)


def flat_sql(k, digits=6):
    return ", ".join(f"round({c}{i}, {digits}) as {c}{i}" for i in range(k) for c in ("w", "m", "s"))


# --- fits ---


@query(f"with recursive {GM} select state, n, {flat_sql(K)} from gm")
def em_gmm(spark, sf):
    return rounded(flat(gmm(spark, sf), K))


@query(
    f"""with recursive {EM} select state, n, {flat_sql(BULK)}, n_tail, u, round(xi, 6) as xi, round(beta, 6) as beta,
 round(norm, 9) as norm, 'ok' as status from em"""
)
def fit_emm(spark, sf):
    fitted = flat(emm(spark, sf), BULK, ("n_tail", "u", "xi", "beta", "norm", "status"))
    return rounded(fitted.withColumn("norm", F.round("norm", 9)), 6).drop("norm").join(
        fitted.select("state", F.round("norm", 9).alias("norm")), "state"
    )


# --- thresholds learned per state ---

_LADDER = f"""{TAIL}, tll as (select level, state, y from tl, (select unnest({level_list(fit.LADDER)}) as level)),
 tu as (select state, unnest({level_list(fit.LADDER)}) as level, unnest(quantile_disc(y, {level_list(fit.LADDER)})) as u from tl group by state),
 {q.emm_sql('tll', ['level', 'state'], BULK, 'el', thresholds='tu')},
 tops as (select level, state, max(y) as top, count(*) as rows from tll group by level, state),
 lls as (select level, state, avg(case when y > u then case when 1 + xi * (y - u) / beta > 0
   then ln(norm / beta) - (1 + 1 / xi) * ln(1 + xi * (y - u) / beta) else '-inf'::double end else ln({q.gmm_pdf_sql('y', BULK)}) end) as ll
  from tll join el using (level, state) group by level, state),
 best as (select state, arg_min(level, (-ll, level)) as level from lls where isfinite(ll) group by state)"""


@query(
    f"""with recursive {_LADDER} select state, level, u, n_tail, round(xi, 6) as xi, round(beta, 6) as beta,
 case when isfinite(ll) then round(ll, 6) end as loglik, case when b.level is null then 0 else 1 end as is_best
 from el join lls using (level, state) left join best b using (level, state)"""
)
def gpd_threshold(spark, sf):
    """Every rung of the ladder with its tail and the likelihood of bulk and tail together."""
    fitted = fit.fit_emm_ladder(derived.tail_rows(spark, sf), STATE, "y", BULK)
    rungs = fitted.select("state", F.col("level").alias("_best"), F.explode("rungs").alias("r")).filter("r.n_tail is not null")
    return rungs.select(
        "state", "r.level", "r.u", "r.n_tail", *[F.round(f"r.{c}", 6).alias(c) for c in ("xi", "beta", "loglik")],
        F.coalesce((F.col("r.level") == F.col("_best")).cast("int"), F.lit(0)).alias("is_best"),
    )


@query(
    f"""with recursive {_LADDER} select state, el.n, {flat_sql(BULK)}, n_tail, el.level, u, round(xi, 6) as xi, round(beta, 6) as beta,
 round(norm, 6) as norm, 'ok' as status from el join best using (level, state)"""
)
def fit_emm_u(spark, sf):
    fitted = fit.fit_emm_ladder(derived.tail_rows(spark, sf), STATE, "y", BULK)
    return rounded(flat(fitted, BULK, ("n_tail", "level", "u", "xi", "beta", "norm", "status")))


_BOOT = f"""{TAIL}, ix as (select *, row_number() over (order by id) - 1 as idx from tl)"""


def _boot_sql(name: str, n: int, replicas: int, seed: int) -> str:
    return f"""{name}_d as (select (i // {n})::int as replica, i % {n} as draw from (select unnest(range(0, {n * replicas})) as i)),
 {name}_i as (select replica, {hash_sql(seed, 'replica', 'draw')} % (select count(*) from tl) as idx from {name}_d),
 {name} as (select {n} as n_train, replica, state, y from {name}_i join ix using (idx))"""


@query(
    f"""with recursive {_BOOT}, {_boot_sql('bt', 2000, 3, 7)},
 {q.em_sql('bt', ['n_train', 'replica', 'state'], 2, 'gm')}
 select n_train, replica, state, n, {flat_sql(2)} from gm"""
)
def fit_replicas(spark, sf):
    sample = sampling.bootstrap(derived.tail_rows(spark, sf), "id", 2000, 3, seed=7)
    fitted = fit.fit_gmm(sample.withColumn("n_train", F.lit(2000)), ["n_train", "replica", "state"], "y", 2)
    return rounded(flat(fitted, 2))


@query(
    f"""with recursive {_BOOT}, {_boot_sql('bt', 2000, 2, 8)} select 'events' as predictor, replica, n_train, state, y from bt"""
)
def replicas_roundtrip(spark, sf):
    path = scratch(spark, "replicas")
    sample = sampling.bootstrap(derived.tail_rows(spark, sf), "id", 2000, 2, seed=8)
    marked = sample.select(F.lit("events").alias("predictor"), "replica", F.lit(2000).alias("n_train"), "state", "y")
    io.write_replicas(marked, path)
    schema = "n_train int, state string, y double, predictor string, replica int"
    return spark.read.schema(schema).parquet(path)


def _bc_params(spark, sf):
    return fit.fit_gmm(derived.dataset(spark, sf, "bc"), ["state1", "state2"], "delay", 2)


_BC2 = f"{BC}, b2 as (select state1, state2, delay as y from bc), {q.em_sql('b2', ['state1', 'state2'], 2, 'gm')}"


@query(
    f"""with recursive {_BC2} select 'gmm' as model, 'bc' as predictor, state1, state2, n, {flat_sql(2, 4)}, 'ok' as status from gm"""
)
def params_roundtrip(spark, sf):
    path = scratch(spark, "params")
    params = _bc_params(spark, sf).withColumn("model", F.lit("gmm")).withColumn("predictor", F.lit("bc"))
    io.write_parameters(io.conform(params, PARAMETERS), path)
    read = io.read_parameters(spark, path)
    spread = [F.col(c)[i].alias(f"{n}{i}") for i in range(2) for c, n in (("w", "w"), ("mu", "m"), ("sigma", "s"))]
    return rounded(read.select("model", "predictor", "state1", "state2", "n", *spread, "status"), 4)


@query(f"with recursive {TAIL} select state, count(*) as n, round(avg(y), 6) as b, round(ln(stddev_pop(y)), 6) as a from tl group by state")
def affine_normal(spark, sf):
    return rounded(fit.fit_affine(derived.tail_rows(spark, sf), STATE, "y"))


_KM_STEPS = 12
_CE = f"ce as (select y as c, row_number() over (order by {hash_sql(9, 'id')}, id) - 1 as r from tl)"


def _kernel_sql() -> str:
    chain = [
        TAIL,
        _CE,
        "sd as (select stddev_pop(y) as s from tl)",
        "kn as (select (r * 2)::int as j, c as mu, 0.7 * s as sigma from ce, sd where r < 4 union all "
        "select (r * 2 + 1)::int, c, 0.3 * s from ce, sd where r < 4)",
        f"kd as (select id, state, j, {q.phi('y', 'mu', 'sigma')} as d from tl, kn)",
        "k0 as (select distinct state, j, 0.125::double as w from kd)",
    ]
    for t in range(1, _KM_STEPS + 1):
        chain.append(
            f"r{t} as (select id, state, j, w * d / sum(w * d) over (partition by id) as r from kd join k{t - 1} using (state, j))"
        )
        chain.append(f"k{t} as (select state, j, avg(r) as w from r{t} group by state, j)")
    return ",\n".join(chain)


@query(
    f"""with recursive {_kernel_sql()} select state, j, round(mu, 6) as mu, round(sigma, 6) as sigma, round(w, 6) as w
 from k{_KM_STEPS} join kn using (j)"""
)
def kernel_mixture(spark, sf):
    rows = derived.tail_rows(spark, sf)
    chosen = [r["y"] for r in centres.centres_random(rows, ["y"], 4, "id", seed=9).orderBy(sampling.hashed(9, F.col("id")), "id").collect()]
    fitted = fit.fit_kernel_mixture(rows, STATE, "y", chosen, _KM_STEPS)
    long = fitted.select("state", F.posexplode(F.arrays_zip("mu", "sigma", "w")).alias("j", "_p"))
    return rounded(long.select("state", "j", "_p.mu", "_p.sigma", "_p.w"))


# --- densities, tails, quantiles ---


@query(
    f"""with recursive {GM}, p as (select id, state, {q.gmm_pdf_sql('y', K)} as d from tl join gm using (state))
 select id, state, round(d, 9) as pdf, round(ln(d), 6) as log_pdf from p"""
)
def gmm_pdf(spark, sf):
    scored = attach(derived.tail_rows(spark, sf), gmm(spark, sf).drop("n", "status"), STATE)
    return scored.select(
        "id",
        "state",
        F.round(mixtures.gmm_pdf(F.col("y"), K), 9).alias("pdf"),
        F.round(mixtures.gmm_log_pdf(F.col("y"), K), 6).alias("log_pdf"),
    )


@query(
    f"""with recursive {GM}, p as (select id, state, {q.gmm_tail_sql('y', K)} as t from tl join gm using (state))
 select id, state, round(log10(t), 6) as log10_tail, round(1 - t, 9) as cdf from p"""
)
def gmm_tail(spark, sf):
    scored = attach(derived.tail_rows(spark, sf), gmm(spark, sf).drop("n", "status"), STATE)
    scored = mixtures.with_tail(scored, F.col("y"), K, "tail")
    return scored.select(
        "id", "state", F.round(F.log10("tail"), 6).alias("log10_tail"), F.round(1 - F.col("tail"), 9).alias("cdf")
    )


@query(
    f"""with recursive {GPD} select id, state, round({q.gpd_tail_sql('y - u')}, 9) as tail, round({q.gpd_pdf_sql('y - u')}, 9) as pdf
 from tl join gpd using (state) where y > u and n_tail >= 30"""
)
def gpd_tail(spark, sf):
    from dwelltail.operators.tails import gpd_fit_moments

    rows = derived.tail_rows(spark, sf)
    fitted = gpd_fit_moments(rows, STATE, "y").filter("status = 'ok'").select("state", "u", "xi", "beta")
    excess = F.col("y") - F.col("u")
    return attach(rows, fitted, STATE).filter("y > u").select(
        "id",
        "state",
        F.round(mixtures.gpd_tail(excess, F.col("xi"), F.col("beta")), 9).alias("tail"),
        F.round(mixtures.gpd_pdf(excess, F.col("xi"), F.col("beta")), 9).alias("pdf"),
    )


def _emm_rows(spark, sf):
    return attach(derived.tail_rows(spark, sf), emm(spark, sf).filter("status = 'ok'").drop("n", "n_tail"), STATE)


@query(f"with recursive {EM} select id, state, round({q.emm_pdf_sql('y')}, 9) as pdf from tl join em using (state)")
def emm_pdf(spark, sf):
    return _emm_rows(spark, sf).select("id", "state", F.round(mixtures.emm_pdf(F.col("y"), BULK), 9).alias("pdf"))


@query(f"with recursive {EM} select id, state, round({q.emm_tail_sql('y')}, 9) as tail from tl join em using (state)")
def emm_tail(spark, sf):
    scored = mixtures.with_tail(_emm_rows(spark, sf), F.col("y"), BULK, "tail", pareto=True)
    return scored.select("id", "state", F.round("tail", 9).alias("tail"))


QLEVELS = [0.5, 0.9, 0.99, 0.999, 0.9999]


def _levels_sql(levels, source: str) -> str:
    return f"{source}_lv as (select state, q from {source}, (select unnest({level_list(levels)}) as q))"


def _emm_quantile_sql(levels) -> str:
    return f"""{EM}, {_levels_sql(levels, 'em')}, ej as (select * from em_lv join em using (state)),
 {q.bisect_sql('ej', ['state', 'q'], q.bulk_tail_sql('@Y@'), '(1 - q)', 'u', 'eb')},
 eq as (select state, q, case when 1 - q < norm then u + beta / xi * (pow((1 - q) / norm, -xi) - 1) else root end as y_hat
 from ej join eb using (state, q))"""


def _gmm_quantile_sql(levels) -> str:
    hi = "greatest(" + ", ".join(f"m{i} + 40 * s{i}" for i in range(K)) + ")"
    return f"""{_levels_sql(levels, 'gm')}, gj as (select * from gm_lv join gm using (state)),
 {q.bisect_sql('gj', ['state', 'q'], q.gmm_tail_sql('@Y@', K), '(1 - q)', hi, 'gb')},
 gq as (select state, q, root as y_hat from gb)"""


@query(f"with recursive {_emm_quantile_sql(QLEVELS)} select state, q, round(y_hat, 4) as y_hat from eq")
def emm_quantile(spark, sf):
    placed = at_targets(emm(spark, sf).filter("status = 'ok'"), QLEVELS).withColumnRenamed("y", "q")
    return placed.select("state", "q", F.round(mixtures.emm_quantile(F.col("q"), BULK), 4).alias("y_hat"))


# --- integrals and risk measures ---

_MOMENTS = f"""{GM}, mm as (select *, {' + '.join(f'w{i} * m{i}' for i in range(K))} as mean from gm),
 mv as (select *, {' + '.join(f'w{i} * (s{i} * s{i} + (m{i} - mean) * (m{i} - mean))' for i in range(K))} as var from mm)"""


def _grid_sql(source: str, lo: str, hi: str, points: int) -> str:
    return f"""g as (select *, {lo} + j * (({hi}) - ({lo})) / {points - 1} as y,
 case when j in (0, {points - 1}) then 0.5 else 1.0 end * (({hi}) - ({lo})) / {points - 1} as wt
 from {source}, (select unnest(range(0, {points})) as j))"""


def _with_moments(spark, sf):
    params = gmm(spark, sf).withColumn("mean", mixtures.mixture_mean(K))
    return params.withColumn("sd", F.sqrt(mixtures.mixture_variance(K)))


@query(f"with recursive {_MOMENTS} select state, round(mean, 6) as mean, round(var, 4) as variance, round(sqrt(var), 6) as std from mv")
def mixture_moments(spark, sf):
    return gmm(spark, sf).select(
        "state",
        F.round(mixtures.mixture_mean(K), 6).alias("mean"),
        F.round(mixtures.mixture_variance(K), 4).alias("variance"),
        F.round(F.sqrt(mixtures.mixture_variance(K)), 6).alias("std"),
    )


_LO, _HI = "mean - 10 * sqrt(var)", "mean + 10 * sqrt(var)"


@query(
    f"""with recursive {_MOMENTS}, {_grid_sql('mv', _LO, _HI, 2001)}
 select state, round(sum(wt * {q.gmm_pdf_sql('y', K)}), 9) as mass from g group by state"""
)
def trapezoid(spark, sf):
    params = _with_moments(spark, sf)
    lo, hi = F.col("mean") - 10 * F.col("sd"), F.col("mean") + 10 * F.col("sd")
    return rounded(integrals.trapezoid(params, STATE, lo, hi, 2001, mass=lambda y: mixtures.gmm_pdf(y, K)), 9)


@query(
    f"""with recursive {_MOMENTS}, {_grid_sql('mv', _LO, _HI, 2001)}, p as (select state, wt, y, {q.gmm_pdf_sql('y', K)} as d from g),
 r as (select state, sum(wt * y * d) as m1, sum(wt * y * y * d) as m2, sum(wt * pow(y, 3) * d) as m3,
 sum(wt * pow(y, 4) * d) as m4 from p group by state)
 select state, round(m1, 6) as mean, round(sqrt(m2 - m1 * m1), 6) as std,
 round((m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(m2 - m1 * m1, 1.5), 6) as skewness,
 round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / pow(m2 - m1 * m1, 2) - 3, 6) as kurtosis from r"""
)
def density_moments(spark, sf):
    params = _with_moments(spark, sf)
    lo, hi = F.col("mean") - 10 * F.col("sd"), F.col("mean") + 10 * F.col("sd")
    return rounded(integrals.density_moments(params, STATE, lambda y: mixtures.gmm_pdf(y, K), lo, hi, 2001))


@query(
    f"""with recursive {GM}, t as (select unnest([50.0::double, 100.0, 200.0]) as t), s as (select * from gm, t),
 {_grid_sql('s', 't', '1000.0', 2001)}
 select state, t, round(sum(wt * {q.gmm_pdf_sql('y', K)}), 9) as tail from g group by state, t"""
)
def tail_by_integral(spark, sf):
    params = at_targets(gmm(spark, sf), [50.0, 100.0, 200.0]).withColumnRenamed("y", "t")
    found = integrals.trapezoid(
        params, ["state", "t"], F.col("t"), F.lit(1000.0), 2001, tail=lambda y: mixtures.gmm_pdf(y, K)
    )
    return rounded(found, 9)


@query(
    f"""with recursive {GM}, g as (select *, 0.1::double + j * 0.1::double as y from gm, (select unnest(range(0, 299)) as j))
 select state, round(sum(y * {q.gmm_pdf_sql('y', K)} * 0.1), 6) as expectation from g group by state"""
)
def grid_expectation(spark, sf):
    return rounded(integrals.grid_expectation(gmm(spark, sf), STATE, lambda y: mixtures.gmm_pdf(y, K)))


ALPHA = 0.05


#: The SQL brackets the quantile between these, the columns by the components; the halvings are as many as it needs.
_FAR = 1000.0


def _value_at_risk_sql(source: str, tail: str) -> str:
    """Table ``ar``: the alpha-quantile as the root of the tail between -1000 and 1000, by a plain search."""
    return f"""ar_r as (select state, 0 as step, {-_FAR}::double as lo, {_FAR}::double as hi from {source}
 union all select state, step + 1, case when {tail} > {1 - ALPHA} then (lo + hi) / 2 else lo end,
  case when {tail} > {1 - ALPHA} then hi else (lo + hi) / 2 end from ar_r join {source} using (state) where step < 70),
 ar as (select state, (lo + hi) / 2 as var from ar_r where step = 70)"""


_CELLS = 20_000
# E[y | y <= var] by the trapezoid rule over the forty deviations below it, from the density alone
_CVAR_SQL = """cg as (select state, var, floor, unnest(range(0, {cells} + 1)) as i from (select state, var, {floor} as floor from ar join {source} using (state))),
 cy as (select state, var, i, floor + (var - floor) * i / {cells}.0 as y, (var - floor) / {cells}.0 as h from cg),
 cv as (select state, any_value(var) as var, sum(y * {pdf} * h * case when i in (0, {cells}) then 0.5 else 1 end) / {alpha} as cvar
  from cy join {source} using (state) group by state)"""


def _floor_sql(k: int) -> str:
    return "least(" + ", ".join(f"m{i} - 12 * s{i}" for i in range(k)) + ")"


@query(
    f"""with recursive {GM}, {_value_at_risk_sql('gm', q.gmm_tail_sql('((lo + hi) / 2)', K))},
 {_CVAR_SQL.format(cells=_CELLS, floor=_floor_sql(K), source='gm', pdf=q.gmm_pdf_sql('y', K), alpha=ALPHA)}
 select state, round(var, 6) as var, round(cvar, 2) as cvar from cv"""
)
def mixture_var_cvar(spark, sf):
    params = gmm(spark, sf).filter("status = 'ok'").withColumn("var", mixtures.gmm_value_at_risk(ALPHA, K))
    return params.select(
        "state",
        F.round("var", 6).alias("var"),
        F.round(mixtures.mixture_cvar(F.col("var"), ALPHA, K), 2).alias("cvar"),
    )


@query(
    f"""with recursive {EM}, {_value_at_risk_sql('em', q.emm_tail_sql('((lo + hi) / 2)'))},
 {_CVAR_SQL.format(cells=_CELLS, floor=_floor_sql(BULK), source='em', pdf=q.emm_pdf_sql('y'), alpha=ALPHA)}
 select state, round(var, 6) as var, round(cvar, 2) as cvar from cv"""
)
def emm_var_cvar(spark, sf):
    """Risk below the alpha-quantile of the mixture with a Pareto tail, by an integral over its density."""
    params = emm(spark, sf).filter("status = 'ok'").withColumn("var", mixtures.emm_value_at_risk(ALPHA, BULK))
    floor = F.least(*[m - F.lit(12.0) * s for _, m, s in mixtures.components(BULK)])
    held = params.withColumn("_floor", floor)
    cvar = mixtures.cvar_by_integral(lambda y: mixtures.emm_pdf(y, BULK), F.col("var"), F.col("_floor"), ALPHA, _CELLS)
    return held.select("state", F.round("var", 6).alias("var"), F.round(cvar, 2).alias("cvar"))


@query(
    f"""with recursive {GM}, s as (select id, state, {uniform_sql(21, 'id', "'c'")} as c, {normal_sql(21, 'id')} as z, gm.* exclude (state)
 from tl join gm using (state))
 select id, state, round(case when c < w0 then m0 + s0 * z when c < w0 + w1 then m1 + s1 * z else m2 + s2 * z end, 6) as y
 from s"""
)
def mixture_sample(spark, sf):
    scored = attach(derived.tail_rows(spark, sf).select("id", "state"), gmm(spark, sf).drop("n", "status"), STATE)
    scored = scored.withColumn("_c", sampling.uniform(21, F.col("id"), F.lit("c")))
    scored = scored.withColumn("_z", sampling.normal(21, F.col("id")))
    drawn = mixtures.sample_mixture(F.col("_c"), F.col("_z"), K)
    return scored.select("id", "state", F.round(drawn, 6).alias("y"))


_T6 = math.gamma(3.5) / (math.gamma(3.0) * math.sqrt(6 * math.pi))
_U = [uniform_sql(31, "state", "i", f"'c{m}'") for m in range(3)]


@query(
    f"""with recursive {_MOMENTS}, d as (select *, i from mv, (select unnest(range(0, 2000)) as i)),
 t as (select *, {normal_sql(31, 'state', 'i')} / sqrt(-2.0 * (ln({_U[0]}) + ln({_U[1]}) + ln({_U[2]})) / 6) as t from d),
 y as (select *, mean + 2 * sqrt(var) * t as y, {_T6!r}::double / (2 * sqrt(var)) * pow(1 + t * t / 6, -3.5) as f from t)
 select state, round(avg({q.gmm_pdf_sql('y', K)} / f), 6) as mass,
 round(avg((y - mean) * (y - mean) * {q.gmm_pdf_sql('y', K)} / f), 4) as covariance from y group by state"""
)
def mc_integral(spark, sf):
    params = _with_moments(spark, sf)
    found = integrals.monte_carlo(
        params,
        STATE,
        F.col("mean"),
        2 * F.col("sd"),
        2000,
        31,
        mass=lambda y: mixtures.gmm_pdf(y, K),
        covariance=lambda y: (y - F.col("mean")) * (y - F.col("mean")) * mixtures.gmm_pdf(y, K),
    )
    return found.select("state", F.round("mass", 6).alias("mass"), F.round("covariance", 4).alias("covariance"))


@query(
    f"""with recursive {GM}, af as (select state, avg(y) as b, stddev_pop(y) as sd from tl group by state),
 l as (select ln({q.gmm_pdf_sql('y', K)}) as g, ln({q.phi('y', 'b', 'sd')}) as a from tl join gm using (state) join af using (state))
 select 'gmm' as model, count(*) as n, round(avg(g), 6) as loglik from l union all
 select 'affine', count(*), round(avg(a), 6) from l"""
)
def loglik_score(spark, sf):
    rows = derived.tail_rows(spark, sf)
    params = gmm(spark, sf).drop("n").join(fit.fit_affine(rows, STATE, "y").drop("n"), STATE)
    models = {"gmm": mixtures.gmm_log_pdf(F.col("y"), K), "affine": fit.affine_log_pdf(F.col("y"))}
    return rounded(evaluate.log_likelihood(rows, params, STATE, "y", models))


# --- kernel estimators ---

Y_POINTS = [5.0, 10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 150.0, 200.0, 300.0]
_CK = f"""{KERN}, st as (select 1.06 * stddev_pop(x) * pow(count(*), -1.0 / 6) as hx,
 1.06 * stddev_pop(y) * pow(count(*), -1.0 / 6) as hy from kr), qx as (select distinct x from kr),
 g as (select unnest({level_list(Y_POINTS)}) as y)"""
_KX = "exp(-0.5 * ((qx.x - kr.x) / hx) * ((qx.x - kr.x) / hx))"


@query(
    f"""with recursive {_CK}, gs as (select kr.x as x, g.y as y, count(*) as n, sum({q.phi('g.y', 'kr.y', 'hy')}) as s
 from kr, g, st group by all)
 select qx.x as x, kr.y as y, round(sum({_KX} * s) / sum({_KX} * n), 9) as pdf from qx, gs kr, st group by qx.x, kr.y"""
)
def ckde_pdf(spark, sf):
    return rounded(kernels.ckde(derived.kernel_rows(spark, sf), ["x"], "y", Y_POINTS), 9)


@query(
    f"""with recursive {_CK}, gs as (select kr.x as x, g.y as y, count(*) as n, sum({q.normal_cdf_sql('g.y', 'kr.y', 'hy')}) as s
 from kr, g, st group by all)
 select qx.x as x, kr.y as y, round(sum({_KX} * s) / sum({_KX} * n), 9) as cdf from qx, gs kr, st group by qx.x, kr.y"""
)
def ckde_cdf(spark, sf):
    return rounded(kernels.ckde(derived.kernel_rows(spark, sf), ["x"], "y", Y_POINTS, "cdf"), 9)


def _near_sql(eps: float) -> str:
    return f"""pr as (select a.x as x, b.x as nx, a.n as own, b.n as n from sp a, sp b, sc
 where abs((a.x - m) / s - (b.x - m) / s) <= {eps})"""


_NK = f"""{KERN}, sc as (select avg(x) as m, stddev_pop(x) as s, stddev_pop(y) as sy, count(*) as total from kr),
 sp as (select x, count(*) as n from kr group by x)"""


@query(
    f"""with recursive {_NK}, {_near_sql(0.4)},
 bw as (select 1.06 * any_value(sy) * pow(sum(own * n) / any_value(total) - 1, -0.2) as h from pr, sc),
 g as (select unnest({level_list(Y_POINTS)}) as y),
 gs as (select kr.x as nx, g.y as y, sum({q.phi('g.y', 'kr.y', 'h')}) as s from kr, g, bw group by all)
 select x, y, round(ln(sum(s) / sum(n)), 6) as log_pdf from pr join gs using (nx) group by x, y"""
)
def nkde_pdf(spark, sf):
    return rounded(kernels.nkde(derived.kernel_rows(spark, sf), ["x"], "y", Y_POINTS))


#: Every row is scored at its own value and this far above it, where the kernel sums underflow.
BEYOND = 2000.0
_SCORED = f"""q as (select 2 * id as id, x, y from kr union all select 2 * id + 1, x, y + {BEYOND} from kr)"""


def _score_sql(pairs: str, log_weight: str, width: str) -> str:
    """Log of the kernel sum of every row of ``q``: ``pairs`` (a table: x, nx, ...) links states; relative to the largest term."""
    term = f"{log_weight} - 0.5 * pow((q.y - kr.y) / {width}, 2)"
    joined = f"from q join {pairs} using (x) join kr on kr.x = nx"
    return f"""top as (select q.id as id, max({term}) as top {joined} group by q.id),
 ls as (select q.id as id, any_value(top) + ln(sum(exp({term} - top))) as ls {joined} join top on top.id = q.id group by q.id)"""


def _scored_rows(rows):
    return rows.select((2 * F.col("id")).alias("id"), "x", "y").unionByName(
        rows.select((2 * F.col("id") + 1).alias("id"), "x", (F.col("y") + BEYOND).alias("y"))
    )


@query(
    f"""with recursive {KERN}, h as (select 1.06 * stddev_pop(x) * pow(count(*), -1.0 / 6) as hx, 1.06 * stddev_pop(y) * pow(count(*), -1.0 / 6) as hy
 from kr), sp as (select x, count(*) as n from kr group by x), {_SCORED},
 pr as (select a.x as x, b.x as nx, -0.5 * pow((a.x - b.x) / hx, 2) as lk, b.n as n, hy from sp a, sp b, h),
 ma as (select x, ln(sum(n * exp(lk)) * any_value(hy) * {q.special.SQRT_2PI!r}::double) as norm from pr group by x),
 {_score_sql('pr', 'lk', 'hy')}
 select id, round(ls - norm, 4) as log_pdf from ls join q using (id) join ma using (x)"""
)
def ckde_score(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    return rounded(kernels.ckde_score(rows, _scored_rows(rows), "id", ["x"], "y"), 4)


@query(
    f"""with recursive {_NK}, {_near_sql(0.4)}, bw as (select 1.06 * any_value(sy) * pow(sum(own * n) / any_value(total) - 1, -0.2) as h from pr, sc), {_SCORED},
 ps as (select x, nx, n, h from pr, bw), ma as (select x, ln(sum(n) * any_value(h) * {q.special.SQRT_2PI!r}::double) as norm from ps group by x),
 {_score_sql('ps', '0', 'h')}
 select id, round(ls - norm, 4) as log_pdf from ls join q using (id) join ma using (x)"""
)
def nkde_score(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    return rounded(kernels.nkde_score(rows, _scored_rows(rows), "id", ["x"], "y"), 4)


LOO_WIDTHS, LOO_EPS = [10.0, 25.0], [0.05, 0.2]


def _loo_sql(eps: float) -> str:
    terms = ", ".join(
        f"sum(exp(-0.5 * pow((a.y - b.y) / {h}, 2))) filter (where a.id <> b.id) as k{i}" for i, h in enumerate(LOO_WIDTHS)
    )
    parts = " union all ".join(
        f"select {h}::double as bandwidth, {eps}::double as epsilon, "
        f"avg(ln(k{i} / ((n - 1) * {h} * {q.special.SQRT_2PI!r}::double))) as loglik from l"
        for i, h in enumerate(LOO_WIDTHS)
    )
    return f"""(with pr as (select a.x as x, b.x as nx from sp a, sp b, sc where abs((a.x - m) / s - (b.x - m) / s) <= {eps}),
 l as (select a.id, count(*) as n, {terms} from kr a join pr using (x) join kr b on b.x = pr.nx group by a.id) {parts})"""


@query(
    f"""with recursive {_NK}, u as ({' union all '.join('select * from ' + _loo_sql(e) for e in LOO_EPS)})
 select bandwidth, epsilon, round(loglik, 6) as loglik from u"""
)
def nkde_loo_grid(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    return rounded(kernels.nkde_loo(rows, "id", ["x"], "y", LOO_WIDTHS, LOO_EPS))


N_CENTRES, LS_WIDTH = 10, 0.5


def _normalised_centres(rows):
    """Ten random rows in z-scores, in hash order."""
    from dwelltail.operators.matching import scales_of

    chosen = centres.centres_random(rows, ["x", "y"], N_CENTRES, "id", seed=13)
    means, stds = scales_of(rows, ["x", "y"])
    listed = chosen.orderBy(sampling.hashed(13, F.col("id")), "id").collect()
    return [((r["x"] - means[0]) / stds[0], (r["y"] - means[1]) / stds[1]) for r in listed]


@query(
    f"""with recursive {KERN}, sc as (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from kr),
 z as (select id, (x - mx) / sx as x, (y - my) / sy as y from kr, sc),
 c as (select (row_number() over (order by {hash_sql(13, 'id')}, id) - 1)::int as centre, x as cx, y as cy from z
 order by centre limit {N_CENTRES})
 select centre, round(avg(exp(-0.5 * ((x - cx) * (x - cx) + (y - cy) * (y - cy)) / {LS_WIDTH ** 2})), 9) as h,
 round(avg(abs(x - cx)), 9) as a from z, c group by centre"""
)
def lscde_fit(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    return rounded(kernels.lscde_fit(rows, ["x"], "y", _normalised_centres(rows), LS_WIDTH), 9)


@query()
def lscde_pdf(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    chosen = _normalised_centres(rows)
    fitted = kernels.lscde_fit(rows, ["x"], "y", chosen, LS_WIDTH)
    alpha = kernels.lscde_alpha(fitted, chosen, LS_WIDTH, regularization=0.1)
    return rounded(kernels.lscde_pdf(rows, rows, ["x"], "y", chosen, alpha, LS_WIDTH))


@query()
def lscde_sample(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    chosen = _normalised_centres(rows)
    alpha = kernels.lscde_alpha(kernels.lscde_fit(rows, ["x"], "y", chosen, LS_WIDTH), chosen, LS_WIDTH, 0.1)
    return rounded(kernels.lscde_sample(rows.select("id", "x"), rows, ["x"], "y", chosen, alpha, "id", LS_WIDTH))


# --- centres ---


@query(f"with recursive {KERN} select id, x, y from kr order by {hash_sql(17, 'id')}, id limit 20")
def centers_random(spark, sf):
    return centres.centres_random(derived.kernel_rows(spark, sf), ["x", "y"], 20, "id", seed=17)


def _farthest_sql(k: int) -> str:
    chain = [KERN, "f0 as (select 0 as centre, id, x, y from kr order by id limit 1)"]
    for t in range(1, k):
        gaps = ", ".join(f"(kr.x - f{i}.x) * (kr.x - f{i}.x) + (kr.y - f{i}.y) * (kr.y - f{i}.y)" for i in range(t))
        tables = ", ".join(f"f{i}" for i in range(t))
        chain.append(f"f{t} as (select {t} as centre, kr.id, kr.x, kr.y from kr, {tables} order by least({gaps}) desc, kr.id limit 1)")
    return ",\n".join(chain)


@query(f"with recursive {_farthest_sql(5)} " + " union all ".join(f"select * from f{i}" for i in range(5)))
def centers_farthest(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    return centres.as_rows(rows, centres.centres_farthest(rows, ["x", "y"], 5, "id"), ["x", "y"], "id")


@query()
def centers_kmeans(spark, sf):
    return rounded(centres.centres_kmeans(derived.kernel_rows(spark, sf), ["x", "y"], 8))


def _edges_sql(wanted: int) -> str:
    chain = [
        KERN,
        "mu as (select avg(x) as mx, avg(y) as my from kr)",
        f"o as (select id, x, y, (x - mx) * (x - mx) + (y - my) * (y - my) as far from kr, mu order by far desc, id limit {2 * wanted})",
        "e0 as (select 0 as centre, id, x, y from o order by far, id desc limit 1)",
    ]
    for t in range(1, wanted):
        gaps = ", ".join(
            f"1 - (o.x * e{i}.x + o.y * e{i}.y) / (sqrt(o.x * o.x + o.y * o.y) * sqrt(e{i}.x * e{i}.x + e{i}.y * e{i}.y))"
            for i in range(t)
        )
        tables = ", ".join(f"e{i}" for i in range(t))
        taken = ", ".join(f"e{i}.id" for i in range(t))
        chain.append(
            f"e{t} as (select {t} as centre, o.id, o.x, o.y from o, {tables} where o.id not in ({taken}) "
            f"order by round(least({gaps}), 12) desc, o.id limit 1)"
        )
    return ",\n".join(chain)


@query(f"with recursive {_edges_sql(4)} " + " union all ".join(f"select * from e{i}" for i in range(4)))
def centers_edges(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    return centres.as_rows(rows, centres.centres_edges(rows, ["x", "y"], 10, "id"), ["x", "y"], "id")


# --- model selection ---

FOLDS = 5
SCALES = [0.8, 1.0, 1.25]
_BEST = """a as (select param, avg(loglik) as mean_loglik, arg_max(fold, loglik) as best_fold from s group by param)
 select param, round(mean_loglik, 6) as mean_loglik, best_fold,
 case when mean_loglik = (select max(mean_loglik) from a) then 1 else 0 end as is_best from a"""


@query(
    f"""with recursive {TAIL}, f as (select *, (ntile({FOLDS}) over (order by id) - 1)::int as fold from tl),
 tr as (select h.fold, state, avg(y) as m, stddev_pop(y) as sd from f, (select distinct fold from f) h
 where f.fold <> h.fold group by all),
 g as (select unnest({level_list(SCALES)}) as param),
 s as (select param, fold, avg(ln({q.phi('y', 'm', '(sd * param)')})) as loglik from f join tr using (fold, state), g
 group by param, fold), {_BEST}"""
)
def cv_grid(spark, sf):
    folded = sampling.kfold(derived.tail_rows(spark, sf), "id", FOLDS)
    return rounded(selection.best_of_grid(selection.cv_affine(folded, STATE, "y", SCALES)))


COMPONENTS = (1, 2, 3)
_CV_GMM = f"""{TAIL}, f as (select *, (ntile({FOLDS}) over (order by id) - 1)::int as fold from tl),
 tr as (select held, state, y from f, (select distinct fold as held from f) where fold <> held),
 tn as (select held, state, count(*) as n from tr group by held, state),
 {", ".join(f"""st{k} as (select held, state, n, v, qs from tn join (select state, var_pop(y) as v, quantile_disc(y, {level_list([(i + 0.5) / k for i in range(k)])}) as qs
  from tl group by state) using (state) where n >= {10 * max(COMPONENTS)}),
 {q.em_sql('tr', ['held', 'state'], k, f'g{k}', starts=f'st{k}')}""" for k in COMPONENTS)},
 s as ({" union all ".join(f"select {k} as param, fold, avg(ln({q.gmm_pdf_sql('y', k)})) as loglik from f join g{k} on held = fold and g{k}.state = f.state group by fold" for k in COMPONENTS)})"""


def _sizes_scored(spark, sf):
    # stored once: numbering the rows by their order costs more than a copy, and three passes follow
    folded = cut(sampling.kfold(derived.tail_rows(spark, sf), "id", FOLDS).select("state", "fold", "y"))
    return selection.cv_mixture(folded, STATE, "y", COMPONENTS)


@query(f"with recursive {_CV_GMM}, {_BEST}")
def cv_grid_gmm(spark, sf):
    return rounded(selection.best_of_grid(_sizes_scored(spark, sf)))


@query(
    f"""with recursive {_CV_GMM}, a as (select param, avg(loglik) as l from s group by param), top as (select arg_max(param, l) as k from a),
 {", ".join(q.em_sql('tl', STATE, k, f'r{k}') for k in COMPONENTS)}
 {" union all ".join(f"select state, n, {k} as k, " + ", ".join(
     (f"round({c}{i}, 6)" if i < k else "null::double") + f" as {c}{i}" for i in range(max(COMPONENTS)) for c in "wms") + f" from r{k} where {k} = (select k from top)" for k in COMPONENTS)}"""
)
def cv_refit(spark, sf):
    best = selection.refit_best(derived.tail_rows(spark, sf), STATE, "y", _sizes_scored(spark, sf))
    columns = [F.round(F.get(name, F.lit(i)), 6).alias(f"{name[0]}{i}") for i in range(max(COMPONENTS)) for name in ("w", "mu", "sigma")]
    return best.select("state", "n", "k", *columns)


MULTIPLES = [0.5, 1.0, 2.0]


@query(
    f"""with recursive {KERN}, f as (select *, (ntile({FOLDS}) over (order by id) - 1)::int as fold from kr),
 h as (select 1.06 * stddev_pop(x) * pow(count(*), -1.0 / 6) as hx, 1.06 * stddev_pop(y) * pow(count(*), -1.0 / 6) as hy
 from kr), c as (select x, fold, count(*) as n from f group by all),
 ma as (select q.x as x, q.fold as fold, {', '.join(
     f'sum(c.n * exp(-0.5 * pow((q.x - c.x) / ({m} * hx), 2))) as a{i}' for i, m in enumerate(MULTIPLES))}
 from c q, c, h where c.fold <> q.fold group by q.x, q.fold),
 k as (select q.id, any_value(q.x) as x, any_value(q.fold) as fold, {', '.join(
     f'sum(exp(-0.5 * (pow((q.x - t.x) / ({m} * hx), 2) + pow((q.y - t.y) / ({m} * hy), 2)))) as k{i}'
     for i, m in enumerate(MULTIPLES))}
 from f q, f t, h where q.fold <> t.fold group by q.id),
 s as ({' union all '.join(
     f'select {m}::double as param, fold, avg(ln(k{i} / (a{i} * {m} * hy * {q.special.SQRT_2PI!r}::double))) as loglik '
     f'from k join ma using (x, fold), h group by fold' for i, m in enumerate(MULTIPLES))}), {_BEST}"""
)
def cv_grid_ckde(spark, sf):
    folded = sampling.kfold(derived.kernel_rows(spark, sf), "id", FOLDS)
    return rounded(selection.best_of_grid(selection.cv_ckde(folded, "id", ["x"], "y", MULTIPLES)))


# --- evaluation ---

EVAL_LEVELS = [0.9, 0.99, 0.999]
_ERRORS = f"""{_emm_quantile_sql(EVAL_LEVELS)}, {q.em_sql('tl', STATE, K, 'gm')}, {_gmm_quantile_sql(EVAL_LEVELS)},
 me as (select state, count(*) as n, unnest({level_list(EVAL_LEVELS)}) as q,
 unnest(quantile_cont(y, {level_list(EVAL_LEVELS)})) as y_q from tl group by state),
 er as (select 'emm' as model, state, q, (y_hat - y_q) / y_q as rel_err, n / (select count(*) from tl) as p_state
 from me join eq using (state, q) union all
 select 'gmm', state, q, (y_hat - y_q) / y_q, n / (select count(*) from tl) from me join gq using (state, q))"""


def _errors(spark, sf):
    rows = derived.tail_rows(spark, sf)
    measured = quantiles.conditional_quantiles(rows, STATE, "y", EVAL_LEVELS, "cont")
    return evaluate.quantile_errors(measured, emm(spark, sf), STATE, "emm", BULK).unionByName(
        evaluate.quantile_errors(measured, gmm(spark, sf), STATE, "gmm", K)
    )


@query(
    f"with recursive {_ERRORS} select model, state, q, round(rel_err, 6) as rel_err, round(p_state, 9) as p_state from er"
)
def quantile_rel_error(spark, sf):
    return rounded(_errors(spark, sf)).withColumn("p_state", F.round("p_state", 9))


@query(
    f"""with recursive {_ERRORS} select model, q, round(avg(abs(rel_err)), 6) as mean_abs_err,
 round(avg(case when rel_err < 0 then 1.0 else 0.0 end), 6) as share_negative,
 round(avg(case when rel_err >= 0 then 1.0 else 0.0 end), 6) as share_other from er group by model, q"""
)
def error_summary(spark, sf):
    return rounded(evaluate.error_summary(_errors(spark, sf)))


TAIL_LEVELS = quantiles.level_grid(0.99999, 0.00001, 20)


@query(
    f"""with recursive {EM}, {q.em_sql('tl', STATE, K, 'gm')},
 me as (select state, unnest({level_list(TAIL_LEVELS)}) as q, unnest(quantile_cont(y, {level_list(TAIL_LEVELS)})) as y_q
 from tl group by state),
 e as (select 'emm' as model, q, abs(log10(greatest({q.emm_tail_sql('y_q')}, 1e-16)) - log10(1 - q)) as e
 from me join em using (state) union all
 select 'gmm', q, abs(log10(greatest({q.gmm_tail_sql('y_q', K)}, 1e-16)) - log10(1 - q)) from me join gm using (state))
 select model, round(q, 9) as q, round(avg(e), 6) as log10_err from e group by model, q"""
)
def tail_log_error(spark, sf):
    rows = derived.tail_rows(spark, sf)
    measured = quantiles.conditional_quantiles(rows, STATE, "y", TAIL_LEVELS, "cont")
    errors = evaluate.tail_errors(measured, emm(spark, sf), STATE, "emm", BULK).unionByName(
        evaluate.tail_errors(measured, gmm(spark, sf), STATE, "gmm", K)
    )
    return errors.select("model", F.round("q", 9).alias("q"), F.round("log10_err", 6).alias("log10_err"))


@query(
    f"""with recursive {_BC2}, me as (select state1, state2, unnest([0.9::double, 0.99]) as q, unnest(quantile_cont(y, [0.9::double, 0.99])) as y_q
 from b2 group by state1, state2)
 select 'gmm' as model, (select count(*) from b2) as n_train, state1, state2, q, 'log10_err' as metric,
 round(abs(log10(greatest({q.gmm_tail_sql('y_q', 2)}, 1e-16)) - log10(1 - q)), 6) as value from me join gm using (state1, state2)"""
)
def eval_store(spark, sf):
    path = scratch(spark, "evaluation")
    keys = ["state1", "state2"]
    data = derived.dataset(spark, sf, "bc")
    measured = quantiles.conditional_quantiles(data, keys, "delay", [0.9, 0.99], "cont")
    total = measured.filter("q = 0.9").agg(F.sum("n")).scalar()
    joined = measured.withColumn("n_train", total).join(_bc_params(spark, sf).drop("n"), keys)
    joined = mixtures.with_tail(joined, F.col("y_q"), 2, "_tail")
    value = F.abs(F.log10(F.greatest("_tail", F.lit(evaluate.FLOOR))) - F.log10(1 - F.col("q")))
    result = joined.withColumn("model", F.lit("gmm")).withColumn("metric", F.lit("log10_err")).withColumn("value", value)
    io.write_evaluation(io.conform(result, EVALUATION), path)
    read = io.read_evaluation(spark, path)
    return rounded(read.select("model", "n_train", *keys, "q", "metric", "value"))


_REQUESTS = f"{EV}, rq as (select event_id as id, event_type as state, 60 + k as budget from ev)"


def _requests(spark, sf):
    return derived.event_columns(spark, sf).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("state"), (60 + F.col("k")).alias("budget")
    )


@query(
    f"""with recursive {_REQUESTS}, {EM} select id, state, budget, round({q.emm_tail_sql('budget')}, 9) as dvp
 from rq join em using (state)"""
)
def dvp_score(spark, sf):
    return rounded(evaluate.violation_probability(_requests(spark, sf), emm(spark, sf), STATE, "budget", "emm", BULK), 9)


@query(
    f"""with recursive {EM}, b as (select unnest({level_list(TARGETS)}) as budget),
 o as (select state, budget, count(*) as n, avg(case when y > budget then 1.0 else 0.0 end) as observed from tl, b
 group by state, budget)
 select state, budget, o.n, round(observed, 9) as observed, round({q.emm_tail_sql('budget')}, 9) as predicted
 from o join em using (state)"""
)
def dvp_calibration(spark, sf):
    rows = derived.tail_rows(spark, sf)
    return rounded(evaluate.calibration(rows, emm(spark, sf), STATE, "y", TARGETS, "emm", BULK), 9)


SIZES = [1000, 4000]


def _by_size_sql() -> str:
    keys = ["n_train", "state"]
    both = "bs as (select n_train, state, y from b1 union all select n_train, state, y from b4)"
    hi = "greatest(m0 + 40 * s0, m1 + 40 * s1)"
    return f"""{_BOOT}, {_boot_sql('b1', 1000, 1, 41)}, {_boot_sql('b4', 4000, 1, 41)}, {both},
 {q.em_sql('bs', keys, 2, 'gm')}, gj as (select * from gm, (select unnest([0.9::double, 0.99]) as q)),
 {q.bisect_sql('gj', [*keys, 'q'], q.gmm_tail_sql('@Y@', 2), '(1 - q)', hi, 'gb')},
 me as (select state, unnest([0.9::double, 0.99]) as q, unnest(quantile_cont(y, [0.9::double, 0.99])) as y_q from tl group by state),
 e as (select n_train, q, (root - y_q) / y_q as e from gb join me using (state, q))"""


@query(
    f"""with recursive {_by_size_sql()} select 'gmm' as model, n_train, q, round(avg(abs(e)), 6) as mean_abs_err,
 round(avg(case when e < 0 then 1.0 else 0.0 end), 6) as share_negative,
 round(avg(case when e >= 0 then 1.0 else 0.0 end), 6) as share_other from e group by n_train, q"""
)
def error_by_train_size(spark, sf):
    rows = derived.tail_rows(spark, sf)
    samples = [
        sampling.bootstrap(rows, "id", n, 1, seed=41).select(F.lit(n).alias("n_train"), "state", "y") for n in SIZES
    ]
    params = fit.fit_gmm(quantiles.union_all(samples), ["n_train", "state"], "y", 2)
    measured = quantiles.conditional_quantiles(rows, STATE, "y", [0.9, 0.99], "cont")
    joined = measured.join(evaluate.fitted(params).drop("n"), STATE)
    errors = joined.select(
        F.lit("gmm").alias("model"),
        "n_train",
        "q",
        ((mixtures.gmm_quantile(F.col("q"), 2) - F.col("y_q")) / F.col("y_q")).alias("rel_err"),
    )
    return rounded(evaluate.error_summary(errors, ("model", "n_train", "q")))


_REPORT = f"""{_emm_quantile_sql(EVAL_LEVELS)},
 me as (select state, unnest({level_list(EVAL_LEVELS)}) as q, unnest(quantile_cont(y, {level_list(EVAL_LEVELS)})) as y_q
 from tl group by state),
 h as (select state, least(floor(y / 5.0), 59)::int as bin, count(*) as c from tl where y between 0 and 300 group by all),
 hd as (select state, (bin + 0.5) * 5.0 as x, c / (sum(c) over (partition by state) * 5.0) as density from h),
 ge as (select state, ceil(quantile_cont(y, 0.8)) as lo, ceil(quantile_cont(y, 0.99999)) as hi from tl group by state),
 gr as (select state, case j when 0 then lo when 59 then hi
 else round(pow(10.0, log10(lo) + j * ((log10(hi) - log10(lo)) / 59)), 9) end as t from ge, (select unnest(range(0, 60)) as j)),
 tc as (select state, t, count(*) filter (where y >= t) / count(*) as tail from gr join tl using (state) group by state, t),
 ev2 as (select state, q, count(*) filter (where y >= y_q) as c from tl join me using (state) group by state, q),
 rp as (
 select state, 'pdf' as kind, x, 'data' as series, density as value from hd
 union all select state, 'pdf', x, 'emm', {q.emm_pdf_sql('x')} from hd join em using (state)
 union all select state, 'tail', t, 'data', tail from tc
 union all select state, 'tail', t, 'emm', {q.emm_tail_sql('t')} from tc join em using (state)
 union all select state, 'quantile', q, 'data', y_q from me join em using (state)
 union all select state, 'quantile', q, 'emm', y_hat from eq
 union all select state, 'quantile', q, 'ratio', y_hat / y_q from eq join me using (state, q)
 union all select state, 'tail_error', q, 'emm', abs(log10(greatest({q.emm_tail_sql('y_q')}, 1e-16)) - log10(1 - q))
 from me join em using (state)
 union all select state, 'exceed', q, 'data', c from ev2 join em using (state)
 union all select state, 'mean', 0.0, 'data', avg(y) from tl join em using (state) group by state
 union all select state, 'mean', 0.0, 'emm', w0 * m0 + w1 * m1 from em
 union all select state, 'count', 0.0, 'data', count(*) from tl join em using (state) group by state)"""


@query(
    f"""with recursive {_REPORT} select state, kind, round(x, 6) as x, series, round(value, 6) as value
 from rp where state in (select state from em)"""
)
def state_report(spark, sf):
    report = evaluate.state_report(
        derived.tail_rows(spark, sf), emm(spark, sf), STATE, "y", EVAL_LEVELS, 0.0, 300.0, 60, "emm", BULK
    )
    return rounded(report)


@query()
def fit_conditional_net(spark, sf):
    data = derived.dataset(spark, sf, "bu")
    keys = ["state1", "state2", "state3"]
    net = conditional_net.fit_conditional_net(data, keys, "delay", k=2, tail=True, steps=20, bins=64)
    found = net.parameters(data.select(*keys).distinct())
    spread = [F.col(c)[i].alias(f"{c}{i}") for i in range(2) for c in ("w", "mu", "sigma")]
    return rounded(found.select(*keys, *spread, "u", "xi", "beta", "norm"))
