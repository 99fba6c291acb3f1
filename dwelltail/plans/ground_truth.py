"""Records, states, samples, matches and measures: everything that needs no fitted model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltail.operators import matching, quantiles, records, sampling, states, tails
from dwelltail.plans.registry import (
    BC,
    BD,
    BU,
    CURVE,
    KERN,
    LOGS,
    RECORDS,
    SNAPS,
    TAIL,
    hash_sql,
    level_list,
    normal_sql,
    query,
    rounded,
    scratch,
)
from dwelltail.session import cut
from dwelltail.sources import derived, io
from dwelltail.sources.schemas import DELAY_COLUMNS, STATE_COLUMNS, state_columns

BU_KEYS, BC_KEYS, BD_KEYS = (state_columns(p) for p in ("bu", "bc", "bd"))
LEVELS = quantiles.TRUTH_LEVELS
S3 = "state1, state2, state3"
MEASURE_LEVELS = [0.8, 0.9, 0.99]
ROUND_DELAYS = ", ".join(f"round({c}, 4) as {c}" for c in DELAY_COLUMNS)


def full_records(spark, sf):
    return records.logs_to_records(records.with_occupancies(derived.logs(spark, sf)))


# --- sources and sinks ---


@query(f"with {BU} select round(delay, 2) as delay, {S3} from bu")
def scan_records(spark, sf):
    return rounded(derived.dataset(spark, sf, "bu"), 2)


@query(
    f"""with {BU}, f as (select {S3}, count(*) as count, count(*) / (select count(*) from bu) as prob
 from bu group by all) select {S3}, count, round(prob, 9) as prob from f
 order by count desc, {S3} limit 60"""
)
def states_csv_roundtrip(spark, sf):
    path = scratch(spark, "states")
    frequency = states.state_frequency(derived.dataset(spark, sf, "bu"), BU_KEYS)
    io.write_states_csv(frequency, path, 60)
    return rounded(io.read_states_csv(spark, path, "bu"), 9)


@query(
    f"""with {BC}, {BD} select 'bc' as predictor, state2 as state, count(*) as n, round(avg(delay), 4) as mean
 from bc group by all union all
 select 'bd', state1, count(*), round(avg(delay), 4) from bd group by all"""
)
def append_csv(spark, sf):
    path = scratch(spark, "results")
    schema = T.StructType.fromDDL("predictor string, state int, n bigint, mean double")
    for name, key in (("bc", "state2"), ("bd", "state1")):
        result = (
            derived.dataset(spark, sf, name)
            .groupBy(F.lit(name).alias("predictor"), F.col(key).alias("state"))
            .agg(F.count("*").alias("n"), F.round(F.avg("delay"), 4).alias("mean"))
        )
        io.append_results_csv(result, path)
    return io.read_results_csv(spark, path, schema)


@query(
    """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as event_time, count(*) as n,
 round(sum(value), 2) as total from events group by all"""
)
def timeseries_load(spark, sf):
    path = scratch(spark, "series")
    hourly = (
        derived.table(spark, sf, "events")
        .groupBy(F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "dd-MM-yy HH:mm:ss").alias("event_time"))
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    )
    hourly.write.option("header", True).csv(path)
    schema = T.StructType.fromDDL("event_time string, n bigint, total double")
    loaded = io.load_time_series(spark, path, schema)
    return loaded.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""with {RECORDS} select run_id, id, {ROUND_DELAYS}, {', '.join(STATE_COLUMNS)} from records"""
)
def records_roundtrip(spark, sf):
    path = scratch(spark, "records")
    io.write_records(full_records(spark, sf), path)
    read = io.read_records(spark, path)
    return rounded(read.select("run_id", "id", *records.record_columns()), 4)


@query(
    f"""with {BU}, {BC}, {BD} select 0 as run_id, delay, state3 as state from bu union all
 select 1, delay, state2 from bc union all select 2, delay, state1 from bd"""
)
def concat_runs(spark, sf):
    frames = []
    for name in ("bu", "bc", "bd"):
        data = derived.dataset(spark, sf, name)
        frames.append(data.select("delay", F.col(state_columns(name)[-1]).alias("state")))
    return io.concat_runs(frames)


# --- records and predictor datasets ---


@query(f"with {RECORDS} select run_id, id, {ROUND_DELAYS}, {', '.join(STATE_COLUMNS)} from records")
def logs_to_records(spark, sf):
    return rounded(full_records(spark, sf), 4)


@query(
    f"""with {RECORDS} select round(end2enddelay, 4) as delay, h1_uplink_netstate::int as state1,
 h1_compute_netstate::int as state2, h1_downlink_netstate::int as state3 from records"""
)
def predictor_bu(spark, sf):
    return rounded(records.predictor_view(full_records(spark, sf), "bu"), 4)


@query(
    f"""with {RECORDS} select round(totaldelay_compute + totaldelay_downlink, 4) as delay,
 h2_compute_netstate::int as state1, h2_downlink_netstate::int as state2 from records"""
)
def predictor_bc(spark, sf):
    return rounded(records.predictor_view(full_records(spark, sf), "bc"), 4)


@query(
    f"""with {RECORDS} select round(totaldelay_downlink, 4) as delay, h3_downlink_netstate::int as state1
 from records"""
)
def predictor_bd(spark, sf):
    return rounded(records.predictor_view(full_records(spark, sf), "bd"), 4)


@query(f"with {BU} select delay, {S3} from bu where state1 = 1 and state2 = 1 and state3 = 2")
def filter_state(spark, sf):
    return records.of_state(derived.dataset(spark, sf, "bu"), {"state1": 1, "state2": 1, "state3": 2})


@query(f"with {LOGS} select run_id, id, round(starttime, 6) as starttime from logs order by run_id, id limit 1000")
def first_n(spark, sf):
    thin = derived.logs(spark, sf).select("run_id", "id", "starttime")
    return rounded(records.first_rows(thin, 1000))


@query(
    f"""with {BU}, t as (select *, row_number() over (order by id) - 1 as i from (select event_id as id, event_type
 as state, value as y from events)) select state, count(*) as n, round(sum(y), 2) as total from t
 where i >= 100 and i < 5000 group by state"""
)
def row_range(spark, sf):
    part = records.row_range(derived.tail_rows(spark, sf), 100, 5000)
    return part.groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"))


@query(
    f"""with {LOGS}, r as (select run_id, id, round(endtime - starttime, 4) as end2enddelay,
 row_number() over (partition by run_id order by id) as rn, count(*) over (partition by run_id) as n from logs)
 select run_id, id, end2enddelay from r where rn > floor(cast(0.1 as decimal(3,1)) * n)"""
)
def drop_transient(spark, sf):
    logs = derived.logs(spark, sf)
    thin = logs.select("run_id", "id", F.round(F.col("endtime") - F.col("starttime"), 4).alias("end2enddelay"))
    return records.drop_transient(thin, 0.1)


@query(f"with {TAIL} select id, round(y + 0.5 * {normal_sql(11, 'id')}, 6) as y from tl")
def noise_jitter(spark, sf):
    return rounded(sampling.jitter(derived.tail_rows(spark, sf).select("id", "y"), "y", "id", 0.5, seed=11))


@query(
    f"""with {KERN}, c as (select 1.0 / sqrt(count(*)) / 2 as s from kr)
 select id, round(x + s * {normal_sql(5, 'id')}, 6) as x, round(y + s * {normal_sql(6, 'id')}, 6) as y from kr, c"""
)
def noise_jitter_adaptive(spark, sf):
    level = lambda n, dims: F.lit(1.0) / F.sqrt(n) / F.lit(dims)
    return rounded(sampling.jitter_scaled(derived.kernel_rows(spark, sf), ["x", "y"], "id", level, seed=5))


@query(
    f"""with {KERN} select id, round((x - (select avg(x) from kr)) / (select stddev_pop(x) from kr), 6) as x,
 round((y - (select avg(y) from kr)) / (select stddev_pop(y) from kr), 6) as y from kr"""
)
def zscore(spark, sf):
    return rounded(sampling.zscore(derived.kernel_rows(spark, sf), ["x", "y"]))


@query(
    f"""with {TAIL}, u as (select state, quantile_disc(y, 0.95) as u from tl group by state)
 select state, u, count(*) filter (where y > u) as n_tail, count(*) filter (where y <= u) as n_bulk
 from tl join u using (state) group by all"""
)
def tail_split(spark, sf):
    return tails.tail_split(derived.tail_rows(spark, sf), ["state"], "y", 0.95)


# --- sampling ---


@query(
    f"""with {TAIL}, ix as (select *, row_number() over (order by id) - 1 as idx from tl),
 dr as (select (i // 5000)::int as replica, i % 5000 as draw from (select unnest(range(0, 50000)) as i)),
 dd as (select replica, draw, {hash_sql(1, 'replica', 'draw')} % (select count(*) from tl) as idx from dr)
 select replica, draw, id, state, y from dd join ix using (idx)"""
)
def bootstrap_replicas(spark, sf):
    return sampling.bootstrap(derived.tail_rows(spark, sf), "id", 5000, 10, seed=1)


@query(
    f"""with {TAIL}, ix as (select *, row_number() over (partition by state order by id) - 1 as idx,
 count(*) over (partition by state) as n from tl),
 dd as (select state, idx as draw, {hash_sql(2, 'state', 'idx')} % n as idx from ix)
 select state, draw, id, y from dd join ix using (state, idx)"""
)
def bootstrap_state(spark, sf):
    return sampling.bootstrap_state(derived.tail_rows(spark, sf), "id", ["state"], seed=2)


@query(
    f"""with {TAIL}, t as (select * from tl order by id limit 1000),
 f as (select *, row_number() over (order by id) - 1 as idx from t),
 dd as (select i as draw, {hash_sql(3, '0', 'i')} % 1000 as idx
 from (select unnest(range(0, 1000)) as i)) select draw, id, state, y from dd join f using (idx)"""
)
def bootstrap_first_n(spark, sf):
    return sampling.bootstrap_first(derived.tail_rows(spark, sf), "id", 1000, seed=3)


@query(
    f"""with {TAIL}, r as (select *, row_number() over (partition by state order by {hash_sql(4, 'id')}, id) as rn
 from tl where state in ('click', 'view', 'error')) select id, state, y from r where rn <= 150"""
)
def cap_per_state(spark, sf):
    rows = derived.tail_rows(spark, sf)
    return sampling.cap_per_value(rows, "state", ["click", "view", "error"], 150, "id", seed=4)


@query(
    f"""with {TAIL}, f as (select id, (ntile(7) over (order by id) - 1)::int as fold from tl)
 select id, fold from f"""
)
def kfold(spark, sf):
    return sampling.kfold(derived.tail_rows(spark, sf).select("id"), "id", 7)


# --- joins and matching ---

_TOP60 = f"top as (select {S3}, count(*) as count from bu group by all order by count desc, {S3} limit 60)"


@query(
    f"""with {BU}, {_TOP60}, g as (select {S3}, count(*) as n, quantile_disc(delay, {level_list(LEVELS)}) as qs
 from bu join top using ({S3}) group by {S3})
 select {S3}, n, round(unnest({level_list(LEVELS)}), 12) as q, unnest(qs) as y_q from g"""
)
def state_quantiles_join(spark, sf):
    data = derived.dataset(spark, sf, "bu")
    top = states.top_states(data, BU_KEYS, 60)
    result = quantiles.restricted_quantiles(data, top, BU_KEYS, "delay", LEVELS)
    return result.withColumn("q", F.round("q", 12))


@query(
    f"""with {BC}, f as (select state1, state2, count(*) as count, round(count(*) / (select count(*) from bc), 9) as prob,
 quantile_disc(delay, [0.99, 0.999, 0.9999]) as qs from bc group by state1, state2)
 select state1, state2, count, prob, qs[1] as "0.99", qs[2] as "0.999", qs[3] as "0.9999" from f
 order by count desc, state1, state2 limit 30"""
)
def quantiles_wide(spark, sf):
    levels = [0.99, 0.999, 0.9999]
    data = derived.dataset(spark, sf, "bc")
    top = cut(states.top_states(data, BC_KEYS, 30))
    long = quantiles.restricted_quantiles(data, top, BC_KEYS, "delay", levels)
    wide = quantiles.wide_with_states(long, top, BC_KEYS, levels)
    return wide.withColumn("prob", F.round("prob", 9))


@query(
    f"""with {BD}, rq as (select distinct state1 from bd union select distinct state1 + 3 from bd),
 m as (select state1, count(*) as n, round(avg(delay), 6) as mean, quantile_cont(delay, [0.8, 0.9, 0.99]) as qs
 from bd group by state1)
 select state1, n, mean, round(qs[1], 6) as q0, round(qs[2], 6) as q1, round(qs[3], 6) as q2
 from rq left join m using (state1)"""
)
def measure_states(spark, sf):
    data = derived.dataset(spark, sf, "bd")
    present = states.distinct_states(data, BD_KEYS)
    requested = present.unionByName(present.select((F.col("state1") + 3).alias("state1")))
    measured = quantiles.measure_states(data, requested, BD_KEYS, "delay", MEASURE_LEVELS)
    return rounded(measured.select("state1", "n", "mean", "q0", "q1", "q2"))


@query(
    f"""with {CURVE}, c as (select x.run_id, x.slot, x.a, y.slot as j, abs(y.d - x.a) as gap,
 row_number() over (partition by x.run_id, x.slot order by abs(y.d - x.a), y.slot) as rn
 from curve x join curve y using (run_id))
 select run_id, slot, greatest(j - case when gap > a then 1 else 0 end, slot) - slot as delay from c where rn = 1"""
)
def virtual_delay(spark, sf):
    curve = matching.cumulative_curve(derived.curve_increments(spark, sf))
    return matching.virtual_delay(curve)


EPS = 0.4


@query(
    f"""with {KERN}, sc as (select avg(x) as m, stddev_pop(x) as s from kr),
 sp as (select x, count(*) as n from kr group by x),
 p as (select a.x as x, b.x as near_x, abs((a.x - m) / s - (b.x - m) / s) as dist, b.n as n from sp a, sp b, sc
 where abs((a.x - m) / s - (b.x - m) / s) <= {EPS})
 select x, near_x, round(dist, 6) as dist, n, round(1.0 / sum(n) over (partition by x), 9) as weight from p"""
)
def eps_neighbors(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    points = matching.support(rows, ["x"])
    means, stds = matching.scales_of(rows, ["x"])
    pairs = matching.eps_neighbors(points, points, ["x"], means, stds, EPS)
    weighted = matching.neighbor_weights(pairs, ["x"])
    return weighted.select("x", "near_x", F.round("dist", 6).alias("dist"), "n", F.round("weight", 9).alias("weight"))


#: Reference points of the distance query.
CENTRES = [(10.0, 20.0), (50.0, 50.0), (90.0, 120.0)]


@query(
    f"""with {KERN} select id, unnest([0, 1, 2]) as centre,
 round(unnest([{', '.join(f'sqrt((x - {a})*(x - {a}) + (y - {b})*(y - {b})) / sqrt(2.0)' for a, b in CENTRES)}]), 6)
 as dist from kr"""
)
def pairwise_distance(spark, sf):
    rows = derived.kernel_rows(spark, sf)
    measured = matching.distances_to(rows, ["x", "y"], CENTRES, norm_dim=True)
    each = measured.select("id", F.posexplode("dist").alias("centre", "dist"))
    return rounded(each)


# --- aggregations ---


def _frequency_sql(cte: str, name: str, keys: list[str]) -> str:
    listed = ", ".join(keys)
    return (
        f"with {cte} select {listed}, count(*) as count, "
        f"round(count(*) / (select count(*) from {name}), 9) as prob from {name} group by {listed}"
    )


@query(_frequency_sql(BU, "bu", BU_KEYS))
def state_freq_bu(spark, sf):
    return rounded(states.state_frequency(derived.dataset(spark, sf, "bu"), BU_KEYS), 9)


@query(_frequency_sql(BC, "bc", BC_KEYS))
def state_freq_bc(spark, sf):
    return rounded(states.state_frequency(derived.dataset(spark, sf, "bc"), BC_KEYS), 9)


@query(_frequency_sql(BD, "bd", BD_KEYS))
def state_freq_bd(spark, sf):
    return rounded(states.state_frequency(derived.dataset(spark, sf, "bd"), BD_KEYS), 9)


@query(
    f"""with {BU}, f as (select {S3}, count(*) as count, count(*) / (select count(*) from bu) as prob from bu group by all
 order by count desc, {S3} limit 20)
 select count(*) as n_states, sum(count)::bigint as sum_count, round(sum(prob), 9) as sum_prob from f"""
)
def top_states(spark, sf):
    return rounded(states.top_states_total(derived.dataset(spark, sf, "bu"), BU_KEYS, 20), 9)


@query(
    f"""with {BU}, g as (select {S3}, count(*) as n, quantile_disc(delay, {level_list(LEVELS)}) as qs
 from bu group by {S3}) select {S3}, n, round(unnest({level_list(LEVELS)}), 12) as q, unnest(qs) as y_q from g"""
)
def cond_quantile_disc(spark, sf):
    result = quantiles.conditional_quantiles(derived.dataset(spark, sf, "bu"), BU_KEYS, "delay", LEVELS)
    return result.withColumn("q", F.round("q", 12))


@query(
    f"""with {BU}, g as (select {S3}, count(*) as n, avg(delay) as mean, quantile_cont(delay, [0.8, 0.9, 0.99]) as qs
 from bu group by {S3}) select {S3}, n, round(mean, 6) as mean, round(qs[1], 6) as q0, round(qs[2], 6) as q1,
 round(qs[3], 6) as q2 from g"""
)
def cond_quantile_cont(spark, sf):
    measured = quantiles.measure(derived.dataset(spark, sf, "bu"), BU_KEYS, "delay", MEASURE_LEVELS)
    return rounded(measured.select(*BU_KEYS, "n", "mean", "q0", "q1", "q2"))


@query(
    f"""with {BU} select count(*) as n, round(quantile_cont(delay, 0.8), 6) as q0, round(quantile_cont(delay, 0.9), 6) as q1,
 round(quantile_cont(delay, 0.99), 6) as q2 from bu"""
)
def global_quantile(spark, sf):
    data = derived.dataset(spark, sf, "bu")
    return rounded(quantiles.quantiles_wide(data, [], "delay", MEASURE_LEVELS, "cont"))


TAIL_POINTS = [20000.0, 50000.0, 80000.0, 90000.0]


@query(
    f"""with {BU}, t as (select unnest({level_list(TAIL_POINTS)}) as t)
 select {S3}, t, round(avg(case when delay > t then 1.0 else 0.0 end), 9) as tail from bu, t group by {S3}, t"""
)
def tail_prob_gt(spark, sf):
    return rounded(tails.tail_probability(derived.dataset(spark, sf, "bu"), BU_KEYS, "delay", TAIL_POINTS), 9)


@query(
    f"""with {BU}, t as (select unnest({level_list(TAIL_POINTS)}) as t)
 select t, round(avg(case when delay > t then 1.0 else 0.0 end), 9) as tail from bu, t group by t"""
)
def tail_prob_overall(spark, sf):
    return rounded(tails.tail_probability(derived.dataset(spark, sf, "bu"), [], "delay", TAIL_POINTS), 9)


_GRID = f"""{TAIL}, e as (select state, count(*) as n, ceil(quantile_cont(y, 0.8)) as lo, ceil(quantile_cont(y, 0.99999)) as hi
 from tl group by state),
 gr as (select state, n, lo, hi, j::int as j, case j when 0 then lo when 59 then hi
 else round(pow(10.0, log10(lo) + j * ((log10(hi) - log10(lo)) / 59)), 9) end as t
 from e, (select unnest(range(0, 60)) as j))"""


@query(
    f"""with {_GRID} select state, j, round(t, 6) as t, round(count(*) filter (where y >= t) / count(*), 9) as tail
 from gr join tl using (state) group by state, j, t"""
)
def tail_curve_ge(spark, sf):
    rows = derived.tail_rows(spark, sf)
    grids = tails.tail_grid(rows, ["state"], "y")
    curve = tails.tail_curve(rows, grids, ["state"], "y")
    return curve.select("state", "j", F.round("t", 6).alias("t"), F.round("tail", 9).alias("tail"))


@query(f"with {_GRID} select state, n, lo, hi, j, round(t, 6) as t from gr")
def tail_grid(spark, sf):
    grids = tails.tail_grid(derived.tail_rows(spark, sf), ["state"], "y")
    return rounded(grids.select("state", "n", "lo", "hi", F.posexplode("grid").alias("j", "t")))


_HIST = f"""{TAIL}, b as (select state, least(floor(y / 2.5), 79)::int as bin from tl where y >= 0 and y <= 200),
 h as (select state, bin, (bin + 0.5) * 2.5 as x, count(*) as count from b group by all),
 hd as (select *, count / (sum(count) over (partition by state) * 2.5) as density from h)"""


@query(f"with {_HIST} select state, bin, round(x, 6) as x, count, round(density, 9) as density from hd")
def cond_histogram(spark, sf):
    return rounded(tails.conditional_histogram(derived.tail_rows(spark, sf), ["state"], "y", 0.0, 200.0, 80), 9)


@query(f"with {_HIST} select state, round(sum(x * density * 2.5), 6) as hist_mean from hd group by state")
def hist_mean(spark, sf):
    histogram = tails.conditional_histogram(derived.tail_rows(spark, sf), ["state"], "y", 0.0, 200.0, 80)
    return rounded(tails.histogram_mean(histogram, ["state"], 2.5))


@query(
    f"""with {TAIL}, q as (select state, count(*) as n, unnest([0.8::double, 0.99, 0.999]) as q,
 unnest(quantile_cont(y, [0.8, 0.99, 0.999])) as y_q from tl group by state)
 select state, n, q, round(y_q, 6) as y_q, count(*) filter (where y >= y_q) as n_exceed
 from tl join q using (state) group by state, n, q, y_q"""
)
def exceed_count(spark, sf):
    return rounded(quantiles.exceed_counts(derived.tail_rows(spark, sf), ["state"], "y", [0.8, 0.99, 0.999]))


_HILL = f"""{TAIL}, r as (select state, y, row_number() over (partition by state order by y desc) as rn,
 count(*) over (partition by state) as n from tl),
 kk as (select *, floor(0.05 * n)::bigint as k from r),
 hx as (select state, y as xk from kk where rn = k + 1),
 hill as (select state, 1.0 / (sum(ln(y) - ln(xk)) / any_value(k)) as alpha, any_value(xk) as xk, any_value(k) as k,
 any_value(n) as n from kk join hx using (state) where rn <= k group by state)"""


@query(f"with {_HILL} select state, round(alpha, 6) as alpha, xk, k, n from hill")
def hill_index(spark, sf):
    return rounded(tails.hill_index(derived.tail_rows(spark, sf), ["state"], "y", 0.05))


@query(
    f"""with {_HILL}, t as (select unnest([200.0::double, 300.0, 400.0]) as x)
 select state, x, round((k / n) * pow(x / xk, -alpha), 9) as tail from hill, t"""
)
def hill_tail(spark, sf):
    index = tails.hill_index(derived.tail_rows(spark, sf), ["state"], "y", 0.05)
    return rounded(tails.hill_tail(index, ["state"], [200.0, 300.0, 400.0]), 9)


@query(
    f"""with {TAIL}, m as (select state, count(*) as n, avg(y) as mean, stddev_pop(y) as std, var_samp(y) as cov from tl
 group by state), c as (select state, any_value(n) as n, any_value(mean) as mean, any_value(std) as std,
 any_value(cov) as cov, avg(pow((y - mean) / std, 3)) as skewness, avg(pow((y - mean) / std, 4)) - 3 as kurtosis
 from tl join m using (state) group by state)
 select state, n, round(mean, 6) as mean, round(std, 6) as std, round(cov, 4) as cov, round(skewness, 6) as skewness,
 round(kurtosis, 6) as kurtosis from c"""
)
def cond_moments(spark, sf):
    moments = tails.conditional_moments(derived.tail_rows(spark, sf), ["state"], "y")
    return rounded(moments).withColumn("cov", F.round("cov", 4))


@query(f"with {TAIL} select state, round(quantile_cont(y, 0.01), 6) as var from tl group by state")
def cond_var(spark, sf):
    found = quantiles.quantiles_wide(derived.tail_rows(spark, sf), ["state"], "y", [0.01], "cont")
    return rounded(found.select("state", F.col("q0").alias("var")))


@query(
    f"""with {TAIL}, v as (select state, count(*) as n, quantile_cont(y, 0.05) as var from tl group by state)
 select state, n, round(var, 6) as var, round(avg(y) filter (where y <= var), 6) as cvar
 from tl join v using (state) group by state, n, var"""
)
def cond_cvar(spark, sf):
    return rounded(quantiles.lower_tail_mean(derived.tail_rows(spark, sf), ["state"], "y", 0.05))


EXCESS = f"""{TAIL}, th as (select state, count(*) as n, quantile_disc(y, 0.95) as u from tl group by state),
 z as (select state, n, u, y - u as z from tl join th using (state) where y > u)"""
GPD = (
    EXCESS
    + """, zm as (select state, n, u, count(*) as n_tail, avg(z) as m, var_samp(z) as s2 from z group by all),
 gpd as (select state, n, u, n_tail, 0.5 * (1 - m * m / s2) as xi, 0.5 * m * (m * m / s2 + 1) as beta from zm)"""
)


@query(
    f"""with {GPD} select state, n, u, n_tail, case when n_tail >= 30 then round(xi, 6) end as xi,
 case when n_tail >= 30 then round(beta, 6) end as beta,
 case when n_tail >= 30 then 'ok' else 'few_excesses' end as status from gpd"""
)
def gpd_fit_mom(spark, sf):
    return rounded(tails.gpd_fit_moments(derived.tail_rows(spark, sf), ["state"], "y"))


@query(
    f"""with {EXCESS}, zs as (select state, n, u, count(*) as n_tail, avg(z) as m, max(z) as mx from z group by all),
 t as (select state, unnest([{', '.join(f'-{s} / mx' for s in tails.NEGATIVE_SHARES)},
 {', '.join(f'{p} / m' for p in tails.POSITIVE_MULTIPLES)}]) as theta from zs),
 x as (select state, theta, avg(ln(1 + theta * z)) as xi from z join t using (state) group by all),
 l as (select state, -(ln(xi / theta) + xi + 1) as ll, xi, xi / theta as beta from x
 union all select state, -(ln(m) + 1), 0.0, m from zs),
 b as (select *, row_number() over (partition by state order by ll desc, xi desc) as rn from l)
 select state, n, u, n_tail, case when n_tail >= 30 then round(xi, 6) end as xi,
 case when n_tail >= 30 then round(beta, 6) end as beta, case when n_tail >= 30 then round(ll * n_tail, 4) end as loglik
 from b join zs using (state) where rn = 1"""
)
def gpd_fit_profile(spark, sf):
    fitted = tails.gpd_fit_profile(derived.tail_rows(spark, sf), ["state"], "y")
    return rounded(fitted).withColumn("loglik", F.round("loglik", 4))


# --- windows, order, distinct ---


@query(
    f"""with {BU}, f as (select {S3}, count(*) as count, count(*) / (select count(*) from bu) as prob from bu group by all)
 select {S3}, count, round(prob, 9) as prob,
 round(sum(prob) over (order by count desc, {S3} rows unbounded preceding), 9) as cumprob from f"""
)
def state_cumprob(spark, sf):
    frequency = states.state_frequency(derived.dataset(spark, sf, "bu"), BU_KEYS)
    return rounded(states.cumulative_share(frequency, BU_KEYS), 9)


@query(
    f"""with {LOGS} select run_id, id, round(starttime - lag(starttime) over (partition by run_id order by id), 6)
 as interarrival from logs"""
)
def interarrival(spark, sf):
    return rounded(records.interarrival(derived.logs(spark, sf)))


@query(f"with {CURVE} select run_id, slot, a, d from curve")
def cumulative_curve(spark, sf):
    return matching.cumulative_curve(derived.curve_increments(spark, sf))


@query(
    f"""with {SNAPS} select run_id, id, h1_uplink, h1_compute, h1_downlink, h2_compute, h2_downlink, h3_downlink
 from snaps"""
)
def occupancy_snapshots(spark, sf):
    return records.occupancy_snapshots(derived.logs(spark, sf))


@query(f"with {LOGS} select run_id, id, round(starttime, 6) as starttime from logs order by run_id, id")
def sort_records(spark, sf):
    return records.sort_records(rounded(derived.logs(spark, sf).select("run_id", "id", "starttime")))


@query(f"with {BU} select distinct {S3} from bu")
def distinct_states(spark, sf):
    return states.distinct_states(derived.dataset(spark, sf, "bu"), BU_KEYS)
