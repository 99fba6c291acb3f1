"""Kernel estimators of p(y | x) as aggregates over distinct x.

x is a small tuple of whole numbers, so every estimator works on the table of
distinct x: rows are summed once per (x, evaluation point) and the kernels in x act
on those sums. No pair of rows is ever formed. Where every row is its own evaluation
point (leave-one-out, held-out folds) the sum over the other rows comes from moments
of small y-cells, an expansion that is exact to rounding.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwelltail.functions.special import SQRT_2PI, normal_cdf, normal_pdf
from dwelltail.operators.matching import NEAREST, _pairs_within, eps_neighbors, known, neighbor_weights, scales_of, support
from dwelltail.operators.sampling import normal, uniform
from dwelltail.session import attach, complete_rows, cut

#: exp(-z^2 / 2) is zero in double precision beyond this many bandwidths.
REACH = 38.7
#: Cells within this many bandwidths decide the sum unless a row is isolated.
NEAR_REACH = 10.0
#: Cells per bandwidth for the near sum.
COARSE = 3
ORDER = 12
#: Terms smaller by exp(-NEGLIGIBLE) than the largest of an isolated row are left out.
NEGLIGIBLE = 40.0
#: Below this sum of kernels a row counts as isolated.
LONELY = 1e-6
#: Places of a cell of ``COARSE`` between which sums are interpolated where the cell holds more rows.
NODES = 12
#: A row's far sources are interpolated where those that matter lie within so many bandwidths of each other.
NARROW = 3.0
#: Cells beyond this number are too fine for places between their ends.
_FAR_CELL = 1 << 30


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _log_sum(terms: list[Column]) -> Column:
    """Logarithm of a sum of exponentials, finite where they underflow."""
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return top + F.log(_sum([F.exp(t - top) for t in terms]))


def _sums_at(df: DataFrame, columns: list[str], value: str, points: list[float], term) -> DataFrame:
    """Per distinct x: n and s0, s1, ... = sum of term(point, y) over its rows."""
    return df.groupBy(*columns).agg(
        F.count("*").alias("n"),
        *[F.sum(term(F.lit(float(p)), F.col(value))).alias(f"s{g}") for g, p in enumerate(points)],
    )


def _at_points(wide: DataFrame, columns: list[str], points: list[float], name: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(float(p)).alias("y"), F.col(f"p{g}").alias(name)) for g, p in enumerate(points)]
    )
    return wide.select(*columns, F.inline(pairs))


def normal_reference(n: int, deviations: list[float]) -> list[float]:
    """1.06 sigma n^(-1/(4+d)) for each of d variables."""
    return [1.06 * s * n ** (-1.0 / (4 + len(deviations))) for s in deviations]


def ckde(
    df: DataFrame,
    columns: list[str],
    value: str,
    points: list[float],
    kind: str = "pdf",
    bandwidths: list[float] | None = None,
) -> DataFrame:
    """Conditional kernel density (or distribution) at every distinct x and each point.

    Joint over marginal with Gaussian kernels; the last bandwidth is that of y.
    """
    df = complete_rows(known(df, columns), value, [])
    if bandwidths is None:
        row = df.agg(F.count("*"), *[F.stddev_pop(c) for c in [*columns, value]]).first()
        bandwidths = normal_reference(row[0], list(row[1:]))
    *hx, hy = bandwidths
    if kind == "pdf":
        term = lambda p, y: normal_pdf(p, y, F.lit(hy))
    else:
        term = lambda p, y: normal_cdf(p, y, F.lit(hy))
    sums = cut(_sums_at(df, columns, value, points, term))
    d = len(columns)
    pairs = _pairs_within(sums, sums, columns, [0.0] * d, hx, REACH / math.sqrt(d))
    kernel = F.exp(F.lit(-0.5 * d) * F.col("dist") * F.col("dist"))
    near = sums.select(*[F.col(c).alias(f"near_{c}") for c in columns], *[f"s{g}" for g in range(len(points))])
    joined = pairs.withColumn("_k", kernel).join(near, [f"near_{c}" for c in columns])
    mixed = joined.groupBy(*columns).agg(
        *[
            (F.sum(F.col("_k") * F.col(f"s{g}")) / F.sum(F.col("_k") * F.col("n"))).alias(f"p{g}")
            for g in range(len(points))
        ]
    )
    return _at_points(mixed, columns, points, kind)


def nkde_bandwidth(pairs: DataFrame, deviation: float, points: DataFrame) -> float:
    """1.06 sigma (mean neighbours)^(-1/5); a row has the neighbours of its state, less itself.

    ``pairs`` must hold the states within epsilon of each other (no nearest-point fallback).
    """
    columns = [c for c in points.columns if c != "n"]
    own = points.select(*columns, F.col("n").alias("_own"))
    row = pairs.join(own, columns).agg(F.sum(F.col("n") * F.col("_own"))).first()
    total = points.agg(F.sum("n")).first()[0]
    neighbours = row[0] / total - 1 if total else 0
    if neighbours <= 0:
        raise ValueError("no row has a neighbour within epsilon: give a bandwidth")
    return 1.06 * deviation * neighbours ** (-1.0 / 5)


def nkde(
    df: DataFrame,
    columns: list[str],
    value: str,
    points: list[float],
    epsilon: float = 0.4,
    bandwidth: float | None = None,
    weighting: str = "uniform",
    order: str | None = None,
) -> DataFrame:
    """Neighbour kernel density at every distinct x and each point: x, y, log_pdf.

    ``order`` (unique per row) names which rows of a state come first when a sparse query
    takes only its five nearest rows.
    """
    df = complete_rows(known(df, columns), value, [])
    means, stds = scales_of(df, columns)
    found = cut(support(df, columns))
    if bandwidth is None:
        deviation = df.agg(F.stddev_pop(value)).first()[0]
        within = _pairs_within(found, found, columns, means, stds, epsilon)
        bandwidth = nkde_bandwidth(within, deviation, found)
    pairs = cut(neighbor_weights(eps_neighbors(found, found, columns, means, stds, epsilon), columns, weighting))
    near = [f"near_{c}" for c in columns]
    names = [f"s{g}" for g in range(len(points))]

    def term(p: float, y: Column) -> Column:
        return F.pow((F.lit(float(p)) - y) / F.lit(bandwidth), 2.0) * F.lit(-0.5)

    # per state and point the logarithm of its kernel sum, relative to its nearest row, so that nothing underflows
    tops = df.groupBy(*columns).agg(*[F.max(term(p, F.col(value))).alias(f"t{g}") for g, p in enumerate(points)])
    beside = attach(df.select(*columns, value), tops, columns)
    sums = beside.groupBy(*columns).agg(*[
        (F.first(f"t{g}") + F.log(F.sum(F.exp(term(p, F.col(value)) - F.col(f"t{g}"))))).alias(names[g]) for g, p in enumerate(points)
    ])
    whole = pairs.filter("take = n").join(sums.withColumnsRenamed(dict(zip(columns, near))), near)
    parts = whole.select(*columns, "weight", *names)
    partial = pairs.filter("take < n")
    if not partial.isEmpty():
        if order is None:
            raise ValueError("a query takes only some rows of a state: name their order")
        wanted = partial.select(*[F.col(a).alias(c) for a, c in zip(near, columns)]).distinct()
        ranked = df.join(wanted, columns, "left_semi").withColumn(
            "_rn", F.row_number().over(Window.partitionBy(*columns).orderBy(order))
        )
        # a fallback takes at most ``NEAREST`` rows, so no more are kept per state
        first = ranked.filter(F.col("_rn") <= NEAREST).select(*[F.col(c).alias(a) for a, c in zip(near, columns)], "_rn", value)
        some = partial.join(first, near).filter(F.col("_rn") <= F.col("take"))
        parts = parts.unionByName(
            some.select(
                *columns,
                "weight",
                *[term(p, F.col(value)).alias(names[g]) for g, p in enumerate(points)],
            )
        )
    logs = parts.filter("weight > 0").select(*columns, *[(F.log("weight") + F.col(n)).alias(n) for n in names])
    highest = logs.groupBy(*columns).agg(*[F.max(n).alias(f"h{g}") for g, n in enumerate(names)])
    scale = math.log(bandwidth * SQRT_2PI)
    mixed = attach(logs, highest, columns).groupBy(*columns).agg(*[
        (F.first(f"h{g}") + F.log(F.sum(F.exp(F.col(n) - F.col(f"h{g}")))) - F.lit(scale)).alias(f"p{g}") for g, n in enumerate(names)
    ])
    return _at_points(mixed, columns, points, "log_pdf")


# --- sums of kernels at every row, by moments of cells in y ---


def _cell(value: Column, bandwidth: float, per: int) -> Column:
    return F.floor(value * F.lit(per / bandwidth))


def _offset(value: Column, cell: Column, bandwidth: float, per: int) -> Column:
    """Distance from the middle of a cell in bandwidths."""
    return value / F.lit(bandwidth) - (cell + 0.5) / F.lit(float(per))


def cell_moments(df: DataFrame, keys: list[str], value: str, bandwidth: float, per: int = COARSE) -> DataFrame:
    """keys, _cell, m0 .. m12: sums of exp(-d^2/2) d^p / p! with d the offset in the cell."""
    placed = df.select(*keys, F.col(value).alias("_y"), _cell(F.col(value), bandwidth, per).alias("_cell"))
    placed = placed.withColumn("_d", _offset(F.col("_y"), F.col("_cell"), bandwidth, per))
    placed = placed.withColumn("_e", F.exp(F.lit(-0.5) * F.col("_d") * F.col("_d")))
    terms = [
        F.sum(F.col("_e") * F.pow("_d", F.lit(float(p))) * F.lit(1.0 / math.factorial(p))).alias(f"m{p}")
        for p in range(ORDER + 1)
    ]
    return placed.groupBy(*keys, "_cell").agg(*terms)


def combine_moments(
    moments: DataFrame, pairs: DataFrame, keys: list[str], source: list[str], weight: Column
) -> DataFrame:
    """Weighted moments per ``keys``: ``pairs`` links x to the moments' ``source`` columns."""
    return (
        pairs.withColumn("_w", weight)
        .join(moments, source)
        .groupBy(*keys, "_cell")
        .agg(*[F.sum(F.col("_w") * F.col(f"m{p}")).alias(f"m{p}") for p in range(ORDER + 1)])
    )


def _series() -> Column:
    total = F.col(f"m{ORDER}")
    for p in range(ORDER - 1, -1, -1):
        total = total * F.col("_d") + F.col(f"m{p}")
    return total


def rows_of_cells(df: DataFrame, columns: list[str], near: list[str], value: str, bandwidth: float, linked: DataFrame) -> DataFrame:
    """Rows of ``df`` in the coarse cells ``_in`` that ``linked`` names by near x."""
    wanted = linked.select(*[F.col(a).alias(c) for a, c in zip(near, columns)], "_in").distinct()
    return attach(df.withColumn("_in", _cell(F.col(value), bandwidth, COARSE)), wanted, [*columns, "_in"])


def _around(df: DataFrame, columns: list[str], near: list[str], value: str, bandwidth: float, links: DataFrame):
    """``moments(per, only)`` of ``kernel_log_sums``: of the rows of ``df`` around each x, weighted by ``_k`` of ``links`` (columns, near, _k)."""

    def moments(per: int, only: DataFrame | None) -> DataFrame:
        if only is None:
            found = cell_moments(df, columns, value, bandwidth, per).withColumnsRenamed(dict(zip(columns, near)))
            return combine_moments(found, links, columns, near, F.col("_k"))
        linked = cut(links.join(only, columns))
        inside = rows_of_cells(df.select(*columns, value), columns, near, value, bandwidth, linked)
        found = cell_moments(inside, [*columns, "_in"], value, bandwidth, per).withColumnsRenamed(dict(zip(columns, near)))
        return combine_moments(found, linked, [*columns, "_in"], [*near, "_in"], F.col("_k"))

    return moments


def _nodes(cells: DataFrame, keys: list[str], bandwidth: float) -> DataFrame:
    """keys, _at, _angle, _y: the Chebyshev nodes of the given cells."""
    angles = F.array(*[F.lit((k + 0.5) * math.pi / NODES) for k in range(NODES)])
    placed = cells.select(*keys, "_at", F.explode(angles).alias("_angle"))
    return placed.withColumn("_y", ((F.col("_at") + 0.5 + 0.5 * F.cos("_angle")) / F.lit(float(COARSE))) * F.lit(bandwidth))


def _interpolated(rows: DataFrame, nodes: DataFrame, keys: list[str], value: str, bandwidth: float, how: str = "inner") -> DataFrame:
    """``rows`` with ``value`` of the nodes of their cells, interpolated at ``_y``; NULL (``how``: left) where a cell has no nodes."""
    sums = [F.sum(F.col(value) * F.cos(F.lit(float(m)) * F.col("_angle"))) * F.lit((2.0 if m else 1.0) / NODES) for m in range(NODES)]
    series = nodes.groupBy(*keys, "_at").agg(*[c.alias(f"_c{m}") for m, c in enumerate(sums)])
    inside = _offset(F.col("_y"), F.col("_at"), bandwidth, COARSE) * F.lit(2.0 * COARSE)
    placed = attach(rows, series, [*keys, "_at"], how)
    placed = placed.withColumn("_angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inside))))
    total = _sum([F.col(f"_c{m}") * F.cos(F.lit(float(m)) * F.col("_angle")) for m in range(NODES)])
    return placed.select(*rows.columns, total.alias(value))


def kernel_log_sums(
    targets: DataFrame, row_id: str, keys: list[str], value: str, moments, bandwidth: float, own: bool
) -> DataFrame:
    """row_id, keys and ``log_sum``: ln of the sum of exp(-((y - y_j)/h)^2 / 2) over the group's sources.

    ``moments(per, only)`` gives the cell moments at a resolution, of all groups or of the listed ones' coarse cells
    (keys, _in); ``own`` says that the row is itself a source, to be left out. A row meets the cells within ten bandwidths;
    rows of a cell that holds many are interpolated between sums at its Chebyshev nodes, exactly to rounding. Where that
    sum is next to nothing the row is isolated (see ``_isolated_sums``).
    """
    rows = targets.select(row_id, *keys, F.col(value).cast("double").alias("_y"))
    rows = rows.withColumn("_at", _cell(F.col("_y"), bandwidth, COARSE))
    cells = cut(moments(COARSE, None))
    wide = int(math.ceil(NEAR_REACH * COARSE))

    def near_sums(places: DataFrame, ids: list[str]) -> DataFrame:
        met = places.withColumn("_cell", F.explode(F.sequence(F.col("_at") - wide, F.col("_at") + wide)))
        met = attach(met, cells, [*keys, "_cell"])
        met = met.withColumn("_d", _offset(F.col("_y"), F.col("_cell"), bandwidth, COARSE))
        term = F.exp(F.lit(-0.5) * F.col("_d") * F.col("_d")) * _series()
        return met.withColumn("_t", term).groupBy(*ids).agg(F.sum("_t").alias("_t"))

    crowded = rows.groupBy(*keys, "_at").agg(F.count("*").alias("_rows")).filter((F.col("_rows") > NODES) & (F.abs("_at") < _FAR_CELL))
    nodes = _nodes(cut(crowded), keys, bandwidth)
    at_node = [*keys, "_at", "_angle"]
    nodes = nodes.join(near_sums(nodes, at_node), at_node, "left").withColumn("_t", F.coalesce("_t", F.lit(0.0)))
    placed = cut(_interpolated(rows, nodes, keys, "_t", bandwidth, "left"), measure=F.count(F.when(F.col("_t").isNull(), 1)))
    each = placed.filter("_t is not null").select(row_id, "_t")
    if placed._measured:
        each = each.unionByName(near_sums(placed.filter("_t is null").drop("_t"), [row_id]))
    # the rows of a repeated id share one sum
    summed = each.groupBy(row_id).agg(F.sum("_t").alias("_t"))
    near = rows.join(summed, row_id, "left")
    lonely = F.col("_t") < LONELY
    near = near.withColumn("_t", F.coalesce("_t", F.lit(0.0)) - F.lit(1.0 if own else 0.0))
    near = cut(near, measure=F.count(F.when(lonely, 1)))
    result = near.filter(~lonely).select(row_id, *keys, F.log("_t").alias("log_sum"))
    if not near._measured:
        return result
    rest = near.filter(lonely & F.col(row_id).isNotNull()).drop("_t")
    return result.unionByName(_isolated_sums(rest, row_id, keys, cells, moments, bandwidth, own))


def _isolated_sums(rest: DataFrame, row_id: str, keys: list[str], cells: DataFrame, moments, bandwidth: float, own: bool) -> DataFrame:
    """``kernel_log_sums`` of isolated rows, at any distance from the sources.

    Each cell that holds isolated rows is compared once with the coarse cells of its group: those stay that may reach the largest term of
    one of its rows but for a factor of exp(-40); its own cell holds no other source. Logarithms of sums over sources that lie close
    together are smooth, so where a cell holds many rows and its sources are narrow the sums are taken at its nodes, else at its rows.
    """
    half = 0.5 / COARSE
    at = [*keys, "_at"]
    places = cut(rest.groupBy(*at).agg(F.count("*").alias("_rows")))
    coarse = cut(cells.select(*keys, "_cell", F.log("m0").alias("_mass")))
    met = attach(places, coarse, keys).withColumn("_gap", (F.col("_at") - F.col("_cell")) / F.lit(float(COARSE)))
    if own:
        met = met.filter("_gap != 0")

    def least(mass: Column, far: Column) -> Column:
        return mass - 0.5 * (far + half) * (far + half)

    def most(mass: Column, far: Column) -> Column:
        nearest = F.greatest(far - half, F.lit(0.0))
        return mass + 0.5 * half * half - 0.5 * nearest * nearest

    # but for u^2/2 both bounds are linear in a row's offset u on either side of the middle, or convex: ends and middle decide
    tops = met.groupBy(*at).agg(F.max(F.struct(least(F.col("_mass"), F.abs("_gap")).alias("least"), F.col("_mass").alias("mass"), F.col("_gap").alias("gap"))).alias("_top"))
    may = [
        most(F.col("_mass"), F.abs(F.col("_gap") + u)) >= least(F.col("_top.mass"), F.abs(F.col("_top.gap") + u)) - NEGLIGIBLE
        for u in (-half, 0.0, half)
    ]
    found = cut(attach(met, tops, at).filter(may[0] | may[1] | may[2]).select(*at, F.col("_cell").alias("_in"), "_mass", "_gap", "_rows"))
    narrow = (F.max("_gap") - F.min("_gap") <= NARROW) & (F.first("_rows") > NODES)
    smooth = found.groupBy(*at).agg(narrow.alias("_narrow")).filter(F.col("_narrow") & (F.abs("_at") < _FAR_CELL)).select(*at)
    smooth = cut(smooth.withColumn("_smooth", F.lit(True)))
    found = found.drop("_gap", "_rows")

    def far_sums(rows: DataFrame, ids: list[str]) -> DataFrame:
        near = attach(rows, found, at).withColumn("_far", F.abs(_offset(F.col("_y"), F.col("_in"), bandwidth, COARSE)))
        own_tops = near.groupBy(*ids).agg(F.max(least(F.col("_mass"), F.col("_far"))).alias("_top"))
        kept = near.join(own_tops, ids).filter(most(F.col("_mass"), F.col("_far")) >= F.col("_top") - NEGLIGIBLE)
        # in a kept cell half a fine cell times the distance stays below 1; fine cells per coarse one, as a power of eight
        level = F.greatest(F.lit(1), F.ceil(F.log2((F.col("_far") + half) * half) / 3)).cast("int")
        more = [c for c in ids if c not in keys]
        kept = cut(kept.select(*keys, *more, "_y", "_in", level.alias("_level")))
        parts = []
        for number in sorted(r[0] for r in kept.select("_level").distinct().collect()):
            split = 8**number
            level_rows = kept.filter(F.col("_level") == number)
            finer = moments(COARSE * split, level_rows.select(*keys, "_in").distinct())
            fine = attach(level_rows, finer, [*keys, "_in"])
            fine = fine.withColumn("_d", _offset(F.col("_y"), F.col("_cell"), bandwidth, COARSE * split))
            log_term = F.lit(-0.5) * F.col("_d") * F.col("_d") + F.log(_series())
            parts.append(fine.select(*ids, log_term.alias("_term")))
        if not parts:
            return rows.select(*ids, F.lit(None).cast("double").alias("log_sum")).limit(0)
        terms = cut(reduce(lambda a, b: a.unionByName(b), parts))
        largest = attach(terms, terms.groupBy(*ids).agg(F.max("_term").alias("_most")), ids)
        return largest.groupBy(*ids).agg((F.first("_most") + F.log(F.sum(F.exp(F.col("_term") - F.col("_most"))))).alias("log_sum"))

    # without u^2/2, which all terms share, the logarithm is all but linear
    bend = 0.5 * F.pow(_offset(F.col("_y"), F.col("_at"), bandwidth, COARSE), F.lit(2.0))
    nodes = _nodes(smooth, keys, bandwidth)
    at_node = far_sums(nodes, [*at, "_angle"])
    at_node = nodes.join(at_node, [*at, "_angle"]).withColumn("log_sum", F.col("log_sum") + bend)
    among = _interpolated(rest, at_node, keys, "log_sum", bandwidth).select(row_id, *keys, (F.col("log_sum") - bend).alias("log_sum"))
    single = cut(attach(rest, smooth, at, "left").filter("_smooth is null").select(row_id, *keys, "_y", "_at"))
    if single._stored_rows:
        among = among.unionByName(far_sums(single, [row_id, *keys]))
    # the rows of a repeated id share one sum
    listed = among.groupBy(row_id, *keys).agg(F.collect_list("log_sum").alias("_ls"))
    shifted = F.aggregate("_ls", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("_ls")))
    return listed.select(row_id, *keys, (F.array_max("_ls") + F.log(shifted)).alias("log_sum"))


# --- scores of given rows ---


def _scored(queries: DataFrame, row_id: str, scores: DataFrame) -> DataFrame:
    return queries.select(row_id).join(scores, row_id, "left")


def _unscored(queries: DataFrame, row_id: str) -> DataFrame:
    return queries.select(row_id, F.lit(None).cast("double").alias("log_pdf"))


def ckde_score(
    df: DataFrame, queries: DataFrame, row_id: str, columns: list[str], value: str, bandwidths: list[float] | None = None
) -> DataFrame:
    """row_id and ``log_pdf``: ln p(y | x) of ``ckde`` over ``df`` at the rows of ``queries``, at any x and y.

    ``row_id`` is unique in ``queries``. Sums over the sources come from moments of cells in y per distinct x, also where they
    would underflow. NULL where a query lacks a coordinate or its value, lies beyond the reach of all x, or ``df`` has no complete row.
    """
    df = complete_rows(known(df, columns), value, [])
    asked = complete_rows(known(queries, columns), value, [])
    if bandwidths is None:
        row = df.agg(F.count("*"), *[F.stddev_pop(c) for c in [*columns, value]]).first()
        if not row[0]:
            return _unscored(queries, row_id)
        bandwidths = normal_reference(row[0], list(row[1:]))
    *hx, hy = bandwidths
    if not hy > 0:
        raise ValueError("the values do not vary: give bandwidths")
    d = len(columns)
    near = [f"near_{c}" for c in columns]
    states = cut(support(df, columns))
    pairs = cut(_pairs_within(asked.select(*columns).distinct(), states, columns, [0.0] * d, hx, REACH / math.sqrt(d)))
    # relative to the nearest x: the share of a far query does not underflow
    closest = pairs.groupBy(*columns).agg(F.min("dist").alias("_least"))
    gap = F.lit(-0.5 * d) * (F.col("dist") * F.col("dist") - F.col("_least") * F.col("_least"))
    pairs = cut(attach(pairs, closest, columns).select(*columns, *near, "n", F.exp(gap).alias("_k")))
    mass = pairs.groupBy(*columns).agg(F.sum(F.col("_k") * F.col("n")).alias("_all"))

    around = _around(df, columns, near, value, hy, pairs.drop("n"))
    sums = attach(kernel_log_sums(asked, row_id, columns, value, around, hy, own=False), mass, columns)
    density = F.col("log_sum") - F.log(F.col("_all") * F.lit(hy * SQRT_2PI))
    return _scored(queries, row_id, sums.select(row_id, density.alias("log_pdf")))


def nkde_score(
    df: DataFrame,
    queries: DataFrame,
    row_id: str,
    columns: list[str],
    value: str,
    epsilon: float = 0.4,
    bandwidth: float | None = None,
    weighting: str = "uniform",
    order: str | None = None,
) -> DataFrame:
    """row_id and ``log_pdf``: ln p(y | x) of ``nkde`` over ``df`` at the rows of ``queries``, at any x and y.

    ``row_id`` is unique in ``queries``, ``order`` (by default ``row_id``) in ``df``: it names which rows of a state come first where a
    query takes only its five nearest rows. NULL where a query lacks a coordinate or its value, or ``df`` has no complete row.
    """
    df = complete_rows(known(df, columns), value, [])
    asked = complete_rows(known(queries, columns), value, [])
    means, stds = scales_of(df, columns)
    found = cut(support(df, columns))
    if found.isEmpty():
        return _unscored(queries, row_id)
    if bandwidth is None:
        within = _pairs_within(found, found, columns, means, stds, epsilon)
        bandwidth = nkde_bandwidth(within, df.agg(F.stddev_pop(value)).first()[0], found)
    near = [f"near_{c}" for c in columns]
    places = cut(asked.select(*columns).distinct())
    pairs = cut(neighbor_weights(eps_neighbors(places, found, columns, means, stds, epsilon), columns, weighting))
    # weights of about one per row; their sum over a query's rows is ``_rows``
    sizes = cut(pairs.groupBy(*columns).agg(F.sum("take").alias("_rows")))
    pairs = cut(attach(pairs, sizes, columns).filter("weight > 0").withColumn("_k", F.col("weight") * F.col("_rows")))
    sparse = F.col("_rows") <= NEAREST
    dense = pairs.filter(~sparse).select(*columns, *near, "_k")
    around = _around(df, columns, near, value, bandwidth, dense)
    sized = cut(attach(asked.select(row_id, *columns, F.col(value).cast("double").alias(value)), sizes, columns))
    sums = kernel_log_sums(sized.filter(~sparse), row_id, columns, value, around, bandwidth, own=False)
    few = pairs.filter(sparse)
    wanted = few.select(*[F.col(a).alias(c) for a, c in zip(near, columns)]).distinct()
    ranked = df.join(wanted, columns, "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy(*columns).orderBy(order or row_id)))
    first = ranked.filter(F.col("_rn") <= NEAREST).select(*[F.col(c).alias(a) for a, c in zip(near, columns)], "_rn", F.col(value).alias("_source"))
    taken = few.join(first, near).filter(F.col("_rn") <= F.col("take")).groupBy(*columns).agg(F.collect_list(F.struct("_source", "_k")).alias("_taken"))
    # at most five terms a row
    each = F.transform("_taken", lambda t: F.log(t["_k"]) - 0.5 * F.pow((F.col(value) - t["_source"]) / F.lit(bandwidth), 2.0))
    listed = attach(sized.filter(sparse), taken, columns).withColumn("_ls", each)
    shifted = F.aggregate("_ls", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("_ls")))
    sums = sums.unionByName(listed.select(row_id, *columns, (F.array_max("_ls") + F.log(shifted)).alias("log_sum")))
    density = F.col("log_sum") - F.log(F.col("_rows") * F.lit(bandwidth * SQRT_2PI))
    return _scored(queries, row_id, attach(sums, sizes, columns).select(row_id, density.alias("log_pdf")))


def nkde_loo(
    df: DataFrame, row_id: str, columns: list[str], value: str, bandwidths: list[float], epsilons: list[float]
) -> DataFrame:
    """bandwidth, epsilon, loglik: mean leave-one-out log density of all rows per grid point.

    Rows of sparse states (five nearest rows instead of an epsilon ball) are evaluated from
    their selected rows directly.
    """
    df = complete_rows(known(df, columns), value, [])
    means, stds = scales_of(df, columns)
    found = cut(support(df, columns))
    near = [f"near_{c}" for c in columns]
    results = []
    for epsilon in epsilons:
        pairs = cut(eps_neighbors(found, found, columns, means, stds, epsilon))
        sizes = cut(pairs.groupBy(*columns).agg(F.sum("take").alias("_rows")))
        sparse = cut(sizes.filter(F.col("_rows") <= NEAREST).select(*columns))
        some = None
        if not sparse.isEmpty():
            some = cut(_selected_pairs(df, row_id, columns, value, pairs, sparse))
            df_dense = attach(df, sparse.withColumn("_sparse", F.lit(1)), columns, "left")
            df_dense = df_dense.filter("_sparse is null").drop("_sparse")
        else:
            df_dense = df
        for bandwidth in bandwidths:
            around = _around(df, columns, near, value, bandwidth, pairs.select(*columns, *near, F.lit(1.0).alias("_k")))
            sums = kernel_log_sums(df_dense, row_id, columns, value, around, bandwidth, own=True)
            if some is not None:
                gap = F.col("_gap") / F.lit(bandwidth)
                terms = some.groupBy(row_id, *columns).agg(F.collect_list(F.lit(-0.5) * gap * gap).alias("_ls"))
                shifted = F.aggregate("_ls", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("_ls")))
                sums = sums.unionByName(
                    terms.select(row_id, *columns, (F.array_max("_ls") + F.log(shifted)).alias("log_sum"))
                )
            density = F.col("log_sum") - F.log((F.col("_rows") - 1) * F.lit(bandwidth * SQRT_2PI))
            results.append(
                attach(sums, sizes, columns)
                .agg(F.avg(density).alias("loglik"))
                .select(F.lit(float(bandwidth)).alias("bandwidth"), F.lit(float(epsilon)).alias("epsilon"), "loglik")
            )
    return reduce(lambda a, b: a.unionByName(b), results)


def _selected_pairs(df, row_id, columns, value, pairs, sparse) -> DataFrame:
    """row_id, columns, _gap: rows of sparse states with each of their other selected rows.

    A sparse state has at most five rows of its own and five selected rows.
    """
    near = [f"near_{c}" for c in columns]
    chosen = pairs.join(sparse, columns, "left_semi")
    wanted = chosen.select(*[F.col(a).alias(c) for a, c in zip(near, columns)]).distinct()
    ranked = df.join(wanted, columns, "left_semi").withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*columns).orderBy(row_id))
    )
    first = ranked.filter(F.col("_rn") <= NEAREST).select(
        *[F.col(c).alias(a) for a, c in zip(near, columns)], "_rn", F.col(row_id).alias("_other"), F.col(value).alias("_y")
    )
    selected = chosen.join(first, near).filter(F.col("_rn") <= F.col("take")).select(*columns, "_other", "_y")
    own = df.join(sparse, columns, "left_semi")
    met = own.join(selected, columns).filter(F.col(row_id) != F.col("_other"))
    return met.select(row_id, *columns, (F.col(value) - F.col("_y")).alias("_gap"))


# --- least-squares conditional density ---


def lscde_fit(
    df: DataFrame, columns: list[str], value: str, centres: list[tuple], bandwidth: float = 0.5
) -> DataFrame:
    """centre, h (mean kernel of all rows) and a (mean x-distance of all rows), normalised data."""
    names = [*columns, value]
    means, stds = scales_of(df, names)
    z = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(names, means, stds)]
    rows = df.select(*[x.alias(f"z{i}") for i, x in enumerate(z)])
    d = len(columns)
    aggregates = []
    for j, centre in enumerate(centres):
        gaps = [(F.col(f"z{i}") - F.lit(float(c))) for i, c in enumerate(centre)]
        squares = _sum([g * g for g in gaps])
        aggregates.append(F.avg(F.exp(squares * F.lit(-0.5 / bandwidth**2))).alias(f"h{j}"))
        aggregates.append(F.avg(F.sqrt(_sum([g * g for g in gaps[:d]]))).alias(f"a{j}"))
    wide = rows.agg(*aggregates)
    listed = F.array(
        *[
            F.struct(F.lit(j).alias("centre"), F.col(f"h{j}").alias("h"), F.col(f"a{j}").alias("a"))
            for j in range(len(centres))
        ]
    )
    return wide.select(F.inline(listed))


def lscde_alpha(fit: DataFrame, centres: list[tuple], bandwidth: float = 0.5, regularization: float = 0.0) -> list[float]:
    """Kernel weights: a k x k system from the k-row summary, with k at most a few hundred."""
    rows = sorted(fit.collect(), key=lambda r: r["centre"])
    h = np.array([r["h"] for r in rows])
    a = np.array([r["a"] for r in rows])
    c = np.array([centre[-1] for centre in centres], dtype=float)
    eta = 2 * (a[:, None] + a[None, :]) + np.abs(c[:, None] - c[None, :])
    system = math.sqrt(math.pi) * bandwidth * np.exp(-eta / (5 * bandwidth**2))
    alpha = np.linalg.solve(system + regularization * np.eye(len(c)), h)
    return [float(v) if v > 0 else 1e-10 for v in alpha]


def lscde_pdf(
    queries: DataFrame,
    df: DataFrame,
    columns: list[str],
    value: str,
    centres: list[tuple],
    alpha: list[float],
    bandwidth: float = 0.5,
) -> DataFrame:
    """Adds log_pdf, pdf, mean and std of p(y | x) to rows with x and y columns."""
    means, stds = scales_of(df, [*columns, value])
    zx = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, means, stds)]
    zy = (F.col(value) - F.lit(means[-1])) / F.lit(stds[-1])
    rows = queries.withColumn("_zy", zy)
    for i, x in enumerate(zx):
        rows = rows.withColumn(f"_z{i}", x)
    factor = -0.5 / bandwidth**2
    marginal, joint, first, second, logs_x, logs_xy = [], [], [], [], [], []
    for weight, centre in zip(alpha, centres):
        sq_x = _sum([(F.col(f"_z{i}") - F.lit(float(c))) ** 2 for i, c in enumerate(centre[:-1])])
        kx = F.lit(weight) * F.exp(F.lit(factor) * sq_x)
        gap = F.col("_zy") - F.lit(float(centre[-1]))
        logs_x.append(F.lit(math.log(weight)) + F.lit(factor) * sq_x)
        logs_xy.append(logs_x[-1] + F.lit(factor) * gap * gap)
        marginal.append(kx)
        joint.append(kx * F.exp(F.lit(factor) * gap * gap))
        first.append(kx * F.lit(float(centre[-1])))
        second.append(kx * F.lit(float(centre[-1]) ** 2))
    rows = rows.withColumn("_px", _sum(marginal)).withColumn("_pxy", _sum(joint))
    mean = _sum(first) / F.col("_px")
    spread = F.lit(bandwidth**2) + _sum(second) / F.col("_px") - mean * mean
    pdf = F.col("_pxy") / (F.col("_px") * F.lit(SQRT_2PI * bandwidth * stds[-1]))
    return rows.select(
        *queries.columns,
        (_log_sum(logs_xy) - _log_sum(logs_x) - F.lit(math.log(SQRT_2PI * bandwidth * stds[-1]))).alias("log_pdf"),
        pdf.alias("pdf"),
        (mean * F.lit(stds[-1]) + F.lit(means[-1])).alias("mean"),
        (F.sqrt(spread) * F.lit(stds[-1])).alias("std"),
    )


def lscde_sample(
    queries: DataFrame,
    df: DataFrame,
    columns: list[str],
    value: str,
    centres: list[tuple],
    alpha: list[float],
    row_id: str,
    bandwidth: float = 0.5,
    seed: int = 1,
) -> DataFrame:
    """A draw of y for every query row: a centre by its weight at x, then normal noise around it."""
    means, stds = scales_of(df, [*columns, value])
    rows = queries.withColumns(
        {f"_z{i}": (F.col(c) - F.lit(m)) / F.lit(s) for i, (c, m, s) in enumerate(zip(columns, means, stds))}
    )
    weights = {}
    for j, (weight, centre) in enumerate(zip(alpha, centres)):
        sq_x = _sum([(F.col(f"_z{i}") - F.lit(float(c))) ** 2 for i, c in enumerate(centre[:-1])])
        weights[f"_k{j}"] = F.lit(weight) * F.exp(F.lit(-0.5 / bandwidth**2) * sq_x)
    rows = rows.withColumns(weights)
    total = _sum([F.col(name) for name in weights])
    rows = rows.withColumn("_c", uniform(seed, F.col(row_id), F.lit("c")) * total)
    reached, picked = F.lit(0.0), None
    for j, centre in enumerate(centres[:-1]):
        reached = reached + F.col(f"_k{j}")
        hit, at = F.col("_c") < reached, F.lit(float(centre[-1]))
        picked = F.when(hit, at) if picked is None else picked.when(hit, at)
    last = F.lit(float(centres[-1][-1]))
    middle = last if picked is None else picked.otherwise(last)
    drawn = middle + F.lit(bandwidth) * normal(seed, F.col(row_id))
    return rows.select(*queries.columns, (drawn * F.lit(stds[-1]) + F.lit(means[-1])).alias("sample"))
