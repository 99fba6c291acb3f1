"""Running sums and neighbour carries along an order, for runs of any length.

A window over a whole run would put that run into one task. Here the table is split by range
into blocks, each block is scanned on its own, and what earlier (or later) blocks contribute
is a small per-block table joined back. The number of blocks follows the row count, one included; rows and results
do not depend on it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwelltail.session import attach, cut, row_count

#: Rows of a block of a table with one block; blocks grow in number and in size with the square root of the table.
BLOCK_ROWS = 20_000


def block_count(total: int) -> int:
    return max(1, math.isqrt(total // BLOCK_ROWS))


def scan_ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str] | None = None,
    last: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``; (keys, order) must be unique.

    ``sums``       out -> column: running sum up to and including the row;
    ``last``       out -> column: last non-NULL value at or before the row;
    ``following``  out -> column: first non-NULL value at or after the row;
    ``previous``   out -> column: last non-NULL value strictly before the row.

    ``blocks`` sets their number; by default it follows from the rows of ``df``, which are counted unless
    the table was stored. Only a table of several blocks is stored here.
    """
    sums, last = sums or {}, last or {}
    following, previous = following or {}, previous or {}
    blocks = block_count(row_count(df)) if blocks is None else blocks
    if blocks == 1:  # no other block contributes
        return _scan(df, keys, order, sums, last, following, previous)

    # The block ids come from a sampled range partitioning, so they are stored before they
    # are used twice: a second evaluation could choose other bounds.
    ranged = cut(
        df.repartitionByRange(blocks, *keys, *order).withColumn("_block", F.spark_partition_id())
    )
    inner = _scan(ranged, [*keys, "_block"], order, sums, last, following, previous)

    position = F.struct(*order)
    per_block = ranged.groupBy(*keys, "_block").agg(
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_l_{o}")
            for o, c in {**last, **previous}.items()
        ],
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_f_{o}")
            for o, c in following.items()
        ],
    )
    along = Window.partitionBy(*keys).orderBy("_block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(1, Window.unboundedFollowing)
    carry = per_block.select(
        *keys,
        "_block",
        *[F.sum(f"_s_{o}").over(before).alias(f"_c_{o}") for o in sums],
        *[F.last(f"_l_{o}", True).over(before).alias(f"_c_{o}") for o in {**last, **previous}],
        *[F.first(f"_f_{o}", True).over(after).alias(f"_c_{o}") for o in following],
    )
    joined = attach(inner, carry, [*keys, "_block"], "left")
    result = {o: F.col(o) + F.coalesce(f"_c_{o}", F.lit(0)) for o in sums}
    result |= {o: F.coalesce(o, f"_c_{o}") for o in (*last, *following, *previous)}
    return joined.select(*df.columns, *[c.alias(o) for o, c in result.items()])


def _scan(df, keys, order, sums, last, following, previous) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    onward = along.rowsBetween(0, Window.unboundedFollowing)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        *[F.sum(c).over(upto).alias(o) for o, c in sums.items()],
        *[F.last(c, True).over(upto).alias(o) for o, c in last.items()],
        *[F.first(c, True).over(onward).alias(o) for o, c in following.items()],
        *[F.last(c, True).over(before).alias(o) for o, c in previous.items()],
    )
