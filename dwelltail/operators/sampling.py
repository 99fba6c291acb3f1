"""Reproducible sampling: draws come from md5 of a seed and a key, never from task order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwelltail.operators.ordered import block_count, scan_ordered
from dwelltail.operators.ranks import select_ranks
from dwelltail.session import attach, cut


def hashed(seed: int, *parts: Column) -> Column:
    """60-bit whole number from ``seed:part:part``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """Uniform number strictly between 0 and 1."""
    return (F.pmod(hashed(seed, *parts), F.lit(2**32)) + F.lit(0.5)) / F.lit(float(2**32))


def normal(seed: int, *parts: Column) -> Column:
    """Standard normal number by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, *parts, F.lit("r"))))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(seed, *parts, F.lit("a")))


def _blocked(df: DataFrame, order: str, keys: list[str], rows_per_block: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``_block``, and per (keys, block) the ``_start`` of its positions along ``order``.

    Blocks are ranges of (keys, order), so a large group is numbered by many tasks and the numbers do not
    depend on their size. They come from a sampled partitioning and are stored before they are used twice.
    """
    total = df.count()
    blocks = block_count(total) if rows_per_block is None else max(1, -(-total // rows_per_block))
    ranged = df.repartitionByRange(blocks, *keys, order) if blocks > 1 else df.coalesce(1)
    parted = cut(ranged.withColumn("_block", F.spark_partition_id()))
    sizes = parted.groupBy(*keys, "_block").agg(F.count("*").alias("_size")).withColumn("_all", F.lit(0))
    ends = scan_ordered(cut(sizes), [*keys, "_all"], ["_block"], sums={"_end": "_size"})
    return parted, ends.select(*keys, "_block", (F.col("_end") - F.col("_size")).alias("_start"))


def dense_index(
    df: DataFrame, order: str, keys: list[str] | None = None, rows_per_block: int | None = None
) -> DataFrame:
    """``idx`` = 0 .. n-1 within ``keys``, along ``order``, which is unique there."""
    by = [*(keys or []), "_block"]
    parted, starts = _blocked(df, order, keys or [], rows_per_block)
    numbered = parted.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    placed = attach(numbered, starts, by)
    return placed.select(*df.columns, (F.col("_start") + F.col("_rn") - 1).alias("idx"))


def bootstrap(
    df: DataFrame, order: str, n: int, replicas: int, seed: int = 1, rows_per_block: int | None = None
) -> DataFrame:
    """``replicas`` samples of n rows each, drawn with replacement from the whole table.

    Positions are along ``order``. The drawn ones are traced to their blocks first; only rows of
    blocks that were hit are numbered.
    """
    parted, starts = _blocked(df, order, [], rows_per_block)
    total = parted._stored_rows
    draws = df.sparkSession.range(n * replicas).select(
        F.floor(F.col("id") / n).cast("int").alias("replica"), (F.col("id") % n).alias("draw")
    )
    # with no row there is no position, and no draw is left below
    at = F.try_mod(hashed(seed, F.col("replica"), F.col("draw")), F.lit(total))
    draws = draws.select(F.lit(0).alias("_all"), at.alias("_at"), "replica", "draw").filter("_at is not null")
    marks = starts.select(
        F.lit(0).alias("_all"), F.col("_start").alias("_at"), F.lit(-1).alias("replica"),
        F.lit(-1).cast("long").alias("draw"), F.struct("_block", "_start").alias("_mark"),
    )
    merged = cut(marks.unionByName(draws, allowMissingColumns=True))
    traced = scan_ordered(merged, ["_all"], ["_at", "replica", "draw"], last={"_in": "_mark"}).filter("draw >= 0")
    located = cut(
        traced.select("replica", "draw", "_in._block", (F.col("_at") - F.col("_in._start") + 1).alias("_rn"))
    )
    hit = attach(parted, located.select("_block").distinct(), ["_block"])
    numbered = hit.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_block").orderBy(order)).cast("long")
    )
    return attach(numbered, located, ["_block", "_rn"]).select("replica", "draw", *df.columns)


def bootstrap_state(
    df: DataFrame, order: str, keys: list[str], seed: int = 1, rows_per_block: int | None = None
) -> DataFrame:
    """Every state's rows resampled with replacement to the same number of rows."""
    indexed = dense_index(df, order, keys, rows_per_block)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    draws = attach(indexed.select(*keys, F.col("idx").alias("draw")), sizes, keys).select(
        *keys, "draw", (hashed(seed, *[F.col(k) for k in keys], F.col("draw")) % F.col("_n")).alias("idx")
    )
    return draws.join(indexed, [*keys, "idx"]).select(
        *keys, "draw", *[c for c in df.columns if c not in keys]
    )


def bootstrap_first(df: DataFrame, order: str, n: int, seed: int = 1) -> DataFrame:
    """The first n rows, resampled with replacement to n rows."""
    return bootstrap(first_along(df, [order], n), order, n, 1, seed).drop("replica")


def first_along(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows along ``order`` (a unique column, or a group and a column unique in it), as a cut at the n-th."""
    *group, last = order
    if n <= 0:
        return df.limit(0)
    earlier = F.lit(False)
    inside = df
    if group:
        sizes = df.groupBy(*group).agg(F.count("*").alias("_size")).withColumn("_all", F.lit(0))
        ends = scan_ordered(cut(sizes), ["_all"], group, sums={"_end": "_size"})
        reached = ends.filter((F.col("_end") >= n) & (F.col("_end") - F.col("_size") < n)).first()
        if reached is None:
            return df
        n -= reached["_end"] - reached["_size"]
        earlier = F.col(group[0]) < F.lit(reached[group[0]])
        inside = df.filter(F.col(group[0]) == F.lit(reached[group[0]]))
    cuts = select_ranks(inside, [], last, {"_cut": lambda size: F.least(F.lit(n).cast("long"), size)}).first()
    if cuts is None or cuts["_cut"] is None:
        return df.limit(0)
    here = F.col(last) <= F.lit(cuts["_cut"])
    if group:
        here = (F.col(group[0]) == F.lit(reached[group[0]])) & here
    return df.filter(earlier | here)


def cap_per_value(
    df: DataFrame, column: str, values: list, limit: int, order: str, seed: int = 1
) -> DataFrame:
    """For listed values at most ``limit`` rows each, drawn without replacement.

    The cut in hash order is an exact order statistic per value; only rows up to it are ranked.
    """
    listed = df.filter(F.col(column).isin(values)).withColumn("_u", hashed(seed, F.col(order)))
    cuts = select_ranks(listed, [column], "_u", {"_cut": lambda n: F.least(F.lit(limit).cast("long"), n)})
    thinned = attach(listed, cuts.select(column, "_cut"), [column]).filter(F.col("_u") <= F.col("_cut"))
    ranked = thinned.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(column).orderBy("_u", order))
    )
    return ranked.filter(F.col("_rn") <= limit).select(*df.columns)


def kfold(df: DataFrame, order: str, folds: int) -> DataFrame:
    """``fold`` 0 .. folds-1 in contiguous blocks; the first n mod folds are one row longer."""

    def start(f: int):
        return lambda n: (F.floor(n / folds) * f + F.least(F.lit(f), n % folds) + 1).cast("long")

    cuts = select_ranks(
        df, [], order, {f"_f{f}": start(f) for f in range(1, folds)}, [f / folds for f in range(1, folds)]
    ).first()
    fold = F.lit(0)
    for f in range(1, folds):
        if cuts[f"_f{f}"] is not None:
            fold = fold + (F.col(order) >= F.lit(cuts[f"_f{f}"])).cast("int")
    return df.withColumn("fold", fold)


def jitter(df: DataFrame, column: str, key: str, scale: float, seed: int = 1) -> DataFrame:
    """Gaussian noise on a column (training views only)."""
    return df.withColumn(column, F.col(column) + F.lit(scale) * normal(seed, F.col(key)))


def jitter_scaled(df: DataFrame, columns: list[str], key: str, noise, seed: int = 1) -> DataFrame:
    """Noise on several columns with level ``noise(n, dims)`` as a function of the row count."""
    total = df.agg(F.count("*").cast("double").alias("n")).scalar()
    level = noise(total, len(columns))
    for i, name in enumerate(columns):
        df = df.withColumn(name, F.col(name) + level * normal(seed + i, F.col(key)))
    return df


def zscore(df: DataFrame, columns: list[str], epsilon: float = 0.0) -> DataFrame:
    """Columns minus mean over population standard deviation (plus ``epsilon``); NULL for a constant column."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[
            F.try_divide(F.col(c) - F.lit(stats[f"m_{c}"]), F.lit((stats[f"s_{c}"] or 0.0) + epsilon)).alias(c)
            for c in columns
        ],
    )
