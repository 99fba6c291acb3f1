"""Joins that are not plain equi-joins: nearest match, epsilon neighbours, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwelltail.operators.ordered import scan_ordered
from dwelltail.session import cut

#: Points taken when at most this many lie within epsilon.
NEAREST = 5


def cumulative_curve(increments: DataFrame, **scan_options) -> DataFrame:
    """run_id, slot, a, d: cumulative arrivals and departures, rounded to cents."""
    scanned = scan_ordered(
        increments, ["run_id"], ["slot"], sums={"a": "arrived", "d": "departed"}, **scan_options
    )
    return scanned.select("run_id", "slot", F.round("a", 2).alias("a"), F.round("d", 2).alias("d"))


def virtual_delay(curve: DataFrame, strict_past: bool = False, **scan_options) -> DataFrame:
    """Slots until the departures reach what had arrived: nearest as-of match of A in D.

    For a slot i the slot j of the cumulative departure nearest to A(i) is taken, the
    first on ties; one slot less when the distance exceeds A(i); never before i. With
    ``strict_past`` the slot is instead moved back when the match lies above A(i).
    """
    departures = curve.select("run_id", F.col("d").alias("v"), F.col("slot").alias("_slot"))
    arrivals = curve.select("run_id", F.col("a").alias("v"), F.lit(None).cast("int").alias("_slot"))
    merged = (
        departures.unionByName(arrivals)
        .groupBy("run_id", "v")
        .agg(F.min("_slot").alias("_slot"))
        .withColumn("_d", F.when(F.col("_slot").isNotNull(), F.struct("v", "_slot")))
    )
    scanned = scan_ordered(
        merged, ["run_id"], ["v"], last={"_lower": "_d"}, following={"_upper": "_d"}, **scan_options
    ).select("run_id", F.col("v").alias("a"), "_lower", "_upper")
    down, up = F.col("a") - F.col("_lower.v"), F.col("_upper.v") - F.col("a")
    lower = F.col("_lower").isNotNull() & (F.col("_upper").isNull() | (down <= up))
    match = F.when(lower, F.col("_lower")).otherwise(F.col("_upper"))
    joined = curve.select("run_id", "slot", "a").join(scanned.withColumn("_m", match), ["run_id", "a"])
    if strict_past:
        back = F.col("_m.v") > F.col("a")
    else:
        back = F.abs(F.col("_m.v") - F.col("a")) > F.col("a")
    slot = F.col("_m._slot") - back.cast("int")
    return joined.select("run_id", "slot", (F.greatest(slot, F.col("slot")) - F.col("slot")).alias("delay"))


def distance(left: list[Column], right: list[Column], squared: bool = False, norm_dim: bool = False) -> Column:
    """Euclidean distance of two points given as columns."""
    total = reduce(lambda a, b: a + b, [(x - y) * (x - y) for x, y in zip(left, right)])
    value = total if squared else F.sqrt(total)
    return value / F.sqrt(F.lit(float(len(left)))) if norm_dim else value


def distances_to(
    df: DataFrame, columns: list[str], centres: list[tuple], squared: bool = False, norm_dim: bool = False
) -> DataFrame:
    """``dist``: array of the distances of each row to the given centres (a short fixed list)."""
    point = [F.col(c) for c in columns]
    each = [distance(point, [F.lit(float(v)) for v in centre], squared, norm_dim) for centre in centres]
    return df.withColumn("dist", F.array(*each))


def support(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct x with their number of rows; kernel work on x happens on this table."""
    return known(df, columns).groupBy(*columns).agg(F.count("*").alias("n"))


def scales_of(df: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    """Mean and population std of each column over all rows (one row of results)."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    d = len(columns)
    return [row[i] for i in range(d)], [row[d + i] for i in range(d)]


def _scaled(column: str, mean: float | None, deviation: float | None) -> Column:
    """The column in deviations from its mean; 0 where it is constant."""
    return (F.col(column) - F.lit(mean)) / F.lit(deviation) if deviation else F.lit(0.0)


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose coordinates are all numbers; no others have neighbours."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def _pairs_within(queries: DataFrame, points: DataFrame, columns: list[str], means, stds, radius: float) -> DataFrame:
    """Pairs of distinct states at normalised distance <= radius, by grid cell and its neighbours."""
    d = len(columns)
    width = radius * d**0.5
    scaled = [_scaled(c, m, s) for c, m, s in zip(columns, means, stds)]
    left = queries.select(*columns, *[z.alias(f"_zq{i}") for i, z in enumerate(scaled)])
    for i in range(d):
        near = F.sequence(F.floor(F.col(f"_zq{i}") / width) - 1, F.floor(F.col(f"_zq{i}") / width) + 1)
        left = left.withColumn(f"_cell{i}", F.explode(near))
    right = points.select(
        *[F.col(c).alias(f"near_{c}") for c in columns],
        "n",
        *[z.alias(f"_zp{i}") for i, z in enumerate(scaled)],
        *[F.floor(z / width).alias(f"_cell{i}") for i, z in enumerate(scaled)],
    )
    gap = distance(
        [F.col(f"_zq{i}") for i in range(d)], [F.col(f"_zp{i}") for i in range(d)], norm_dim=True
    )
    return (
        left.join(right, [f"_cell{i}" for i in range(d)])
        .withColumn("dist", gap)
        .filter(F.col("dist") <= radius)
        .select(*columns, *[f"near_{c}" for c in columns], "dist", "n")
    )


def eps_neighbors(
    queries: DataFrame, points: DataFrame, columns: list[str], means, stds, epsilon: float, nearest: int = NEAREST
) -> DataFrame:
    """Neighbour states of each query state: near_*, dist, n, take (rows of it that count).

    ``points`` is a support table. A query with at most ``nearest`` rows in range takes its
    ``nearest`` closest rows instead; the search radius doubles until they are found, at the latest when it
    covers all points. Rows with a missing coordinate are no queries and no points.
    """
    queries, points = known(queries, columns), cut(known(points, columns))
    total = points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    pairs = _pairs_within(queries, points, columns, means, stds, epsilon)
    counted = queries.select(*columns).distinct().join(
        pairs.groupBy(*columns).agg(F.sum("n").alias("_rows")), columns, "left"
    )
    enough = F.coalesce(F.col("_rows"), F.lit(0)) > nearest
    sparse = cut(counted.filter(~enough).select(*columns))
    dense = pairs.join(counted.filter(enough).select(*columns), columns, "left_semi")
    result = dense.withColumn("take", F.col("n"))

    wanted = min(nearest, total)
    radius = epsilon
    while wanted and not sparse.isEmpty():
        around = _pairs_within(sparse, points, columns, means, stds, radius)
        full = around.groupBy(*columns).agg(F.sum("n").alias("_rows")).filter(F.col("_rows") >= wanted)
        along = Window.partitionBy(*columns).orderBy("dist", *[f"near_{c}" for c in columns])
        ranked = around.join(full.select(*columns), columns, "left_semi").withColumn(
            "_before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        closest = ranked.filter(F.col("_before") < wanted).withColumn(
            "take", F.least(F.col("n"), F.lit(wanted) - F.col("_before"))
        )
        result = result.unionByName(cut(closest.drop("_before")))
        sparse = cut(sparse.join(full, columns, "left_anti"))
        radius *= 2
    return result


def neighbor_weights(pairs: DataFrame, columns: list[str], weighting: str = "uniform") -> DataFrame:
    """Weight of one row of each neighbour state; per query the weights of all rows sum to 1.

    ``uniform``: equal. ``distance``: proportional to the distance.
    """
    share = F.lit(1.0) if weighting == "uniform" else F.col("dist")
    totals = pairs.groupBy(*columns).agg(F.sum(share * F.col("take")).alias("_total"))
    joined = pairs.join(totals, columns)
    weight = F.when(F.col("_total") > 0, share / F.col("_total")).otherwise(0.0)
    return joined.withColumn("weight", weight).drop("_total")
