"""Logs, occupancies, running sums, virtual delay and sampling against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwelltail.operators import matching, records, sampling, states
from dwelltail.operators.ordered import scan_ordered
from dwelltail.session import attach, incomplete_count
from dwelltail.sources import derived, io

BLOCKS = {"blocks": 25}


def make_logs(seed, n=120):
    """Two runs with many equal times (whole numbers)."""
    rng = np.random.default_rng(seed)
    rows = []
    for run in (0, 1):
        start = np.sort(rng.integers(0, 60, n))
        for i in range(n):
            t = [float(start[i])]
            for _ in range(6):
                t.append(t[-1] + float(rng.integers(0, 4)))
            rows.append((run, i, t[0], t[6], t[1], t[2], t[3], t[4], t[5], t[6]))
    return rows


SCHEMA = (
    "run_id int, id long, starttime double, endtime double, queuetime_uplink double, servicetime_uplink double, "
    "queuetime_compute double, servicetime_compute double, queuetime_downlink double, servicetime_downlink double"
)


def brute_occupancy(rows):
    result = {}
    for r in rows:
        same = [x for x in rows if x[0] == r[0]]
        start, up, comp = r[2], r[5], r[7]

        def inside(at, enter, leave, strict):
            return sum((x[enter] < at if strict else x[enter] <= at) and x[leave] > at for x in same)

        result[r[0], r[1]] = (
            inside(start, 2, 5, True), inside(start, 5, 7, False), inside(start, 7, 3, False),
            inside(up, 5, 7, True), inside(up, 7, 3, False), inside(comp, 7, 3, True),
        )
    return result


@pytest.mark.parametrize("options", [{}, BLOCKS])
def test_occupancy_equals_counting(spark, options):
    rows = make_logs(5)
    logs = spark.createDataFrame(rows, SCHEMA)
    found = records.occupancy_snapshots(logs, **options)
    got = {(r[0], r[1]): tuple(r)[2:] for r in found.collect()}
    assert got == brute_occupancy(rows)


def test_record_identities(spark, small):
    made = records.logs_to_records(records.with_occupancies(derived.logs(spark, small)))
    off = made.filter(
        (F.abs(F.col("totaldelay_uplink") + F.col("totaldelay_compute") + F.col("totaldelay_downlink") - F.col("end2enddelay")) > 1e-6)
        | (F.abs(F.col("queuedelay_uplink") + F.col("servicedelay_uplink") - F.col("totaldelay_uplink")) > 1e-6)
        | (F.abs(F.col("queuedelay_compute") + F.col("servicedelay_compute") - F.col("totaldelay_compute")) > 1e-6)
    )
    assert off.count() == 0


@pytest.mark.parametrize("options", [{}, {"blocks": 1}, {"blocks": 17}])
def test_scan_in_blocks_equals_loop(spark, options):
    rng = np.random.default_rng(8)
    rows = [(int(k), i, float(rng.integers(0, 9)), None if rng.random() < 0.6 else float(i)) for k in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, v double, s double")
    found = scan_ordered(
        df, ["k"], ["i"], sums={"run": "v"}, last={"lo": "s"}, following={"hi": "s"}, previous={"pre": "v"}, **options
    )
    got = {(r["k"], r["i"]): (r["run"], r["lo"], r["hi"], r["pre"]) for r in found.collect()}
    for k, i, _, _ in rows:
        own = [r for r in rows if r[0] == k]
        seen = [r[3] for r in own if r[1] <= i and r[3] is not None]
        ahead = [r[3] for r in own if r[1] >= i and r[3] is not None]
        want = (
            sum(r[2] for r in own if r[1] <= i), seen[-1] if seen else None, ahead[0] if ahead else None,
            own[i - 1][2] if i else None,
        )
        assert got[k, i] == want


def brute_virtual(a, d, strict=False):
    out = []
    for i, x in enumerate(a):
        gaps = [abs(y - x) for y in d]
        j = int(np.argmin(gaps))
        if (d[j] > x) if strict else (gaps[j] > x):
            j -= 1
        out.append(max(i, j) - i)
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("options", [{}, {"blocks": 6}])
def test_virtual_delay_equals_loop(spark, options, strict):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for run in (0, 1):
        a = np.cumsum(rng.integers(0, 5, 80)).astype(float)
        d = np.cumsum(rng.integers(0, 4, 80)).astype(float)  # flat stretches: the first slot wins
        rows += [(run, i, float(a[i]), float(d[i])) for i in range(80)]
        want |= {(run, i): w for i, w in enumerate(brute_virtual(a, d, strict))}
    curve = spark.createDataFrame(rows, "run_id int, slot int, a double, d double")
    found = matching.virtual_delay(curve, strict, **options)
    assert {(r["run_id"], r["slot"]): r["delay"] for r in found.collect()} == want


def test_neighbours_equal_all_pairs(spark):
    """Two dimensions, an isolated state that needs the five nearest rows."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in rng.integers(0, 8, (300, 2))] + [(40.0, 40.0)] * 2
    df = spark.createDataFrame(rows, "a double, b double")
    points = matching.support(df, ["a", "b"])
    means, stds = matching.scales_of(df, ["a", "b"])
    eps = 0.3
    found = matching.eps_neighbors(points, points, ["a", "b"], means, stds, eps).collect()
    assert "CartesianProduct" not in str(matching._pairs_within(points, points, ["a", "b"], means, stds, eps)._jdf.queryExecution())
    z = (np.array(rows) - means) / stds
    for state in set(rows):
        q = (np.array(state) - means) / stds
        dist = np.sqrt(((z - q) ** 2).sum(axis=1) / 2)
        within = int((dist <= eps + 1e-12).sum())
        got = [r for r in found if (r["a"], r["b"]) == state]
        assert sum(r["take"] for r in got) == (within if within > 5 else 5)
        if within <= 5:
            assert max(r["dist"] for r in got) == pytest.approx(np.sort(dist)[4])


@pytest.mark.parametrize("rows_per_block", [7, 10_000, None])
def test_dense_index_counts_along_the_order(spark, rows_per_block):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g")).repartition(4)
    for keys in ([], ["g"]):
        rows = sampling.dense_index(df, "id", keys, rows_per_block).collect()
        for g in {r["g"] for r in rows} if keys else {None}:
            own = sorted((r["id"], r["idx"]) for r in rows if g is None or r["g"] == g)
            assert [i for _, i in own] == list(range(len(own)))


@pytest.mark.parametrize("n", [0, 1, 40, 99, 100, 101])
def test_first_rows(spark, n):
    df = spark.range(100).select((F.col("id") % 3).alias("run_id"), F.col("id")).repartition(4)
    ordered = sorted((i % 3, i) for i in range(100))
    assert sorted(map(tuple, records.first_rows(df, n).collect())) == ordered[:n]
    assert sorted(r["id"] for r in sampling.first_along(df, ["id"], n).collect()) == list(range(min(n, 100)))


def test_constant_column_has_no_score(spark):
    assert [r["v"] for r in sampling.zscore(spark.createDataFrame([(1.0,), (1.0,)], "v double"), ["v"]).collect()] == [None, None]


def test_bootstrap_is_reproducible_and_whole(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    first = sampling.bootstrap(df, "id", 400, 3, seed=4, rows_per_block=50)
    assert first.count() == 1200
    again = sampling.bootstrap(df.repartition(7), "id", 400, 3, seed=4)
    assert first.exceptAll(again).count() == 0
    assert sampling.bootstrap(df.limit(0), "id", 4, 2).count() == 0


@pytest.mark.parametrize("rows_per_block", [1, 7, 60])
def test_draws_do_not_depend_on_the_blocks(spark, rows_per_block):
    """Registered draws against their SQL positions: row number along the id, whatever the block size."""
    df = spark.range(0, 120, 2).withColumn("g", (F.col("id") % 3).cast("int"))
    ids = [r["id"] for r in df.collect()]
    drawn = sampling.bootstrap(df, "id", 30, 2, seed=5, rows_per_block=rows_per_block).collect()
    hashes = {
        (r["r"], r["d"]): r["h"] for r in spark.range(60).select(
            F.floor(F.col("id") / 30).alias("r"), (F.col("id") % 30).alias("d"),
            sampling.hashed(5, F.floor(F.col("id") / 30).cast("int"), F.col("id") % 30).alias("h"),
        ).collect()
    }
    assert {(r["replica"], r["draw"]): r["id"] for r in drawn} == {k: ids[h % 60] for k, h in hashes.items()}
    per_state = sampling.bootstrap_state(df, "id", ["g"], seed=3, rows_per_block=rows_per_block).select("g", "draw", "id")
    plain = sampling.bootstrap_state(df, "id", ["g"], seed=3).select("g", "draw", "id")
    assert sorted(map(tuple, per_state.collect())) == sorted(map(tuple, plain.collect()))


def test_bootstrap_draws_the_hashed_positions(spark):
    """Many small blocks: every draw is the row at its position along the id."""
    df = spark.range(300).withColumn("v", F.col("id") * 2)
    along = list(range(300))
    drawn = sampling.bootstrap(df, "id", 50, 2, seed=9, rows_per_block=10)
    positions = {
        (r["replica"], r["draw"]): r["p"]
        for r in drawn.select("replica", "draw", (sampling.hashed(9, F.col("replica"), F.col("draw")) % 300).alias("p")).collect()
    }
    rows = drawn.collect()
    assert len(rows) == 100
    for r in rows:
        assert r["id"] == along[positions[r["replica"], r["draw"]]]


def test_caps_and_folds(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 700, 1).otherwise(2))
    capped = sampling.cap_per_value(df, "s", [1, 2], 50, "id")
    assert {r["s"]: r["count"] for r in capped.groupBy("s").count().collect()} == {1: 50, 2: 50}
    whole = sampling.cap_per_value(df, "s", [2], 5000, "id")
    assert whole.count() == 300
    sizes = [r["count"] for r in sampling.kfold(df, "id", 7).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [143] * 6 + [142]


def test_transient_and_range(spark):
    df = spark.createDataFrame([(r, i * 3) for r, n in ((0, 25), (1, 7)) for i in range(n)], "run_id int, id long")
    left = {r["run_id"]: r["count"] for r in records.drop_transient(df, 0.1).groupBy("run_id").count().collect()}
    assert left == {0: 23, 1: 7}
    part = records.row_range(df.filter("run_id = 0"), 5, 9).orderBy("id").collect()
    assert [r["id"] for r in part] == [15, 18, 21, 24]
    assert records.row_range(df.filter("run_id = 0"), 20, 900).count() == 5


def test_salted_join_equals_broadcast(spark):
    rows = spark.range(600).select((F.col("id") % 3).alias("k"), "id")
    small = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        salted = attach(rows, small, ["k"], how, max_broadcast_bytes=0).select("k", "id", "w")
        plain = rows.join(small, ["k"], how).select("k", "id", "w")
        assert salted.exceptAll(plain).count() == 0 and salted.count() == 600


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 1.0), (1, None), (1, float("nan"))], "g int, v double")
    assert incomplete_count(df, "v", ["g"]).first()["dropped"] == 3


def test_top_states_break_ties_by_state(spark):
    df = spark.createDataFrame([(2,), (1,), (3,), (3,)], "state1 int")
    assert [r["state1"] for r in states.top_states(df, ["state1"], 2).collect()] == [3, 1]


def test_scan_reads_only_needed_columns(spark, small):
    plan = states.state_frequency(derived.dataset(spark, small, "bc"), ["state1", "state2"])._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan ==") :]
    assert "l_extendedprice" not in scan.split("ReadSchema")[1]


def test_time_formats_never_mix(spark):
    df = spark.createDataFrame([("2024-01-05 10:00:00",), ("2024-02-01 00:00:01",)], "t string")
    assert io.parse_times(df, "t").filter("t is null").count() == 0
    mixed = spark.createDataFrame([("2024-01-05 10:00:00",), ("20240201",)], "t string")
    with pytest.raises(ValueError):
        io.parse_times(mixed, "t")
    assert io.find_time_column(["a", "Start_Date", "time"]) == "Start_Date"
