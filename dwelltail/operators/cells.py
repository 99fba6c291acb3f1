"""Summaries of every state's values that merge by addition: cells with Chebyshev sums, read as weighted nodes.

A cell is a short stretch of values. Its row holds, for m = 0, 1, ..., the sum of the m-th Chebyshev polynomial over its records, so
rows of two tasks are added, and a part of the records (a fold, a stretch between thresholds) is a part of the rows. From the sums
follow weights for fixed nodes of the cell such that the sum of f over the records is the sum of weight * f(node), exactly for
polynomials below degree ``NODES`` and to rounding for functions that are smooth over a cell. Count, mean and variance are exact.

Cells are even around the centre of a state and grow with the distance beyond its unit (asinh), so their number is
bounded by the range of doubles, not by rows. States of few rows keep the rows themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.session import attach

#: Nodes of a cell, and cells per unit around the centre.
NODES = 12
PER_UNIT = 16
#: States of at most so many rows keep their rows.
SMALL = 2_048

_CHEBYSHEV = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
#: T_m at the nodes, doubled beyond m = 0 and divided by their number: sums of a cell to weights.
_TO_WEIGHTS = np.cos(np.outer(np.arange(NODES), np.arccos(_CHEBYSHEV))) * np.where(np.arange(NODES) > 0, 2.0, 1.0)[:, None] / NODES


def summarise(
    rows: DataFrame, places: DataFrame, keys: list[str], part: Column | None = None, small: int = SMALL, per_unit: int = PER_UNIT, only: Column | None = None
) -> DataFrame:
    """One row per state: keys and ``cells``, an array of (part, cell, y, sums).

    ``rows`` have keys and ``_y``; ``places`` has per state keys, ``n``, the centre ``_a`` and the unit ``_b`` of the cells.
    ``part`` (of rows joined with places) tells the parts of a state's records apart; ``only`` keeps some of them.
    """
    joined = attach(rows, places, keys)
    if only is not None:
        joined = joined.filter(only)
    apart = F.col("n") > small
    cell = F.floor(F.asinh((F.col("_y") - F.col("_a")) / F.col("_b")) * per_unit)
    placed = joined.select(*keys, (F.lit(0) if part is None else part).cast("int").alias("part"), "_y", "_a", "_b", F.when(apart, cell).alias("cell"))
    low, high = (F.col("_a") + F.col("_b") * F.sinh((F.col("cell") + i) / per_unit) for i in (0, 1))
    placed = placed.select("*", low.alias("_lo"), high.alias("_hi"))
    inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (2 * F.col("_y") - F.col("_lo") - F.col("_hi")) / (F.col("_hi") - F.col("_lo"))))
    angle = placed.select(*keys, "part", "cell", F.when(F.col("cell").isNull(), F.col("_y")).alias("y"), F.acos(inside).alias("_angle"))
    # a constant lies in one angle; rows kept as they are need no more than their number
    sums = [F.count(F.lit(1)).cast("double"), F.sum(F.cos("_angle")), *[F.sum(F.cos(F.lit(float(m)) * F.col("_angle"))) for m in range(2, NODES)]]
    summed = angle.groupBy(*keys, "part", "cell", "y").agg(*[s.alias(f"s{m}") for m, s in enumerate(sums)])
    packed = F.when(F.col("cell").isNull(), F.array("s0")).otherwise(F.array(*[F.col(f"s{m}") for m in range(NODES)]))
    return summed.groupBy(*keys).agg(F.collect_list(F.struct("part", "cell", "y", packed.alias("sums"))).alias("cells"))


def read_nodes(cells: pa.ListScalar, a: float, b: float, per_unit: int = PER_UNIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, node, weight) of one state's summary, in the order of the nodes."""
    fields = cells.values
    part, cell, y, sums = (fields.field(i) for i in range(4))
    part = part.to_numpy()
    raw = np.asarray(cell.is_null())
    count = sums.value_lengths().to_numpy(zero_copy_only=False)
    flat = sums.flatten().to_numpy()
    first = np.cumsum(count) - count
    found = [(part[raw], y.filter(pa.array(raw)).to_numpy(zero_copy_only=False).astype(float), flat[first[raw]])]
    if not raw.all():
        number = cell.filter(pa.array(~raw)).to_numpy(zero_copy_only=False).astype(float)
        low, high = a + b * np.sinh(number / per_unit), a + b * np.sinh((number + 1) / per_unit)
        weights = flat[first[~raw][:, None] + np.arange(NODES)] @ _TO_WEIGHTS
        nodes = ((high + low)[:, None] + (high - low)[:, None] * _CHEBYSHEV) / 2
        found.append((np.repeat(part[~raw], NODES), nodes.ravel(), weights.ravel()))
    part, y, weight = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((part, y))  # the same sums in any order of arrival
    return part[order], y[order], weight[order]
