"""Exact order statistics of every group, without gathering a group in one task.

``percentile`` and ``percentile_disc`` keep one entry per distinct value and group, which is one entry
per row for continuous delays. Here a mergeable sketch brackets each wanted rank, one more
pass counts exactly (rows outside the brackets collapse to counts before the shuffle),
and only rows inside the brackets are ordered. The sketch decides how much is
ordered, never the result: a rank it missed is selected again without brackets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.operators.ordered import scan_ordered
from dwelltail.session import attach, complete_rows, cut

ACCURACY = 10_000
#: Sketch levels for ranks that are known only per group.
_EVEN = [i / 100 for i in range(1, 100)] + [0.001, 0.005, 0.995, 0.999, 0.9999]

Ranks = dict[str, Callable[[Column], Column]]


def disc_rank(q: float) -> Callable[[Column], Column]:
    """Rank of the discrete quantile: the smallest value with at least a share q at or below it."""
    return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * n)).cast("long")


def select_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: Ranks,
    levels: list[float] | None = None,
    accuracy: int = ACCURACY,
    slack: float = 4.0,
    blocks: int | None = None,
    together: int = 1,
    stats: dict[str, str] | None = None,
) -> DataFrame:
    """One row per group: keys, ``n`` and, per name in ``ranks``, the value of that rank.

    ``ranks`` maps an output name to a function n -> 1-based rank; ranks outside
    1..n give NULL. ``levels`` names the shares near which the ranks lie and narrows the
    brackets. Each run of ``together`` ascending names shares one bracket. ``stats`` maps further
    output names to SQL aggregates of ``_v``, taken in the pass that makes the sketch.
    """
    stats = stats or {}
    rows = complete_rows(df.select(*keys, F.col(value).alias("_v")), "_v", keys)
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    names = list(ranks)
    groups = [list(range(i, min(i + together, len(names)))) for i in range(0, len(names), together)]
    margin = slack / accuracy

    grid = _grid(levels, margin)
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", grid, accuracy).alias("_g"),
        *[F.expr(text).alias(name) for name, text in stats.items()],
    )
    ranked = sketch.select(
        *by, "n", *stats, "_g", F.lit(grid).alias("_p"), *[ranks[name](F.col("n")).alias(f"_r{i}") for i, name in enumerate(names)]
    )
    wanted = [f"if(_r{i} between 1 and n, _r{i}, null) as _r{i}" for i in range(len(names))]
    ends = []
    for g, members in enumerate(groups):
        low, high = f"_r{members[0]} / n - {margin!r}", f"_r{members[-1]} / n + {margin!r}"
        ends.append(f"get(_g, size(filter(_p, p -> p <= {low})) - 1) as _lo{g}")
        ends.append(f"get(_g, size(filter(_p, p -> p < {high}))) as _hi{g}")
    brackets = cut(ranked.selectExpr(*by, "n", *stats, *wanted, *ends))
    missed = " or ".join(f"(_r{i} is not null and _a{i} is null)" for i in range(len(names)))
    found = _count_within(rows, brackets, by, len(names), len(groups), blocks, list(stats))
    found = cut(found, measure=F.count(F.expr(f"if({missed}, 1, null)")))
    if found._measured:
        opened = brackets.join(found.filter(missed).select(*by), by, "left_semi")
        opened = opened.withColumns({f"_{e}{g}": F.lit(None) for g in range(len(groups)) for e in ("lo", "hi")})
        second = _count_within(rows, cut(opened), by, len(names), len(groups), blocks, list(stats))
        found = found.filter(f"not ({missed})").unionByName(second)
    return found.select(*keys, "n", *stats, *[F.col(f"_a{i}").alias(name) for i, name in enumerate(names)])


def _count_within(
    rows: DataFrame,
    brackets: DataFrame,
    by: list[str],
    wanted: int,
    groups: int,
    blocks: int | None,
    carried: list[str] | None = None,
) -> DataFrame:
    """Exact values of the bracketed ranks; NULL where a bracket does not hold its rank."""
    from_lo = [f"(_lo{g} is null or _v >= _lo{g})" for g in range(groups)]
    inside = " or ".join(f"({from_lo[g]} and (_hi{g} is null or _v <= _hi{g}))" for g in range(groups))
    cell = " + ".join(f"cast({c} as int)" for c in from_lo)
    # Within a cell the bracketed values come first: all brackets open there end in one range.
    counted = (
        _placed(rows, brackets, by)
        .selectExpr(*by, f"{cell} as _cell", f"if({inside}, _v, null) as _v")
        .groupBy(*by, "_cell", "_v")
        .agg(F.count("*").alias("_c"))
        .selectExpr("*", "cast(_v is null as int) as _open")
    )
    running = scan_ordered(cut(counted), by, ["_cell", "_open", "_v"], sums={"_cum": "_c"}, blocks=blocks)
    ranks = [f"first(_r{i}) as _r{i}" for i in range(wanted)]
    kept = [f"first({name}) as {name}" for name in ("n", *(carried or []))]
    hits = [f"max(if(_cum >= _r{i} and _cum - _c < _r{i}, _v, null)) as _a{i}" for i in range(wanted)]
    reached = _placed(running, brackets, by).groupBy(*by)
    return reached.agg(*[F.expr(text) for text in (*kept, *ranks, *hits)])


def _placed(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the brackets of their group; without keys these are one row of constants."""
    if by != ["_all"]:
        return attach(rows, brackets, by)
    only = brackets.first()
    if only is None:
        return rows.join(brackets, by)
    types = {f.name: f.dataType for f in brackets.schema.fields}
    constants = [F.lit(only[c]).cast(types[c]).alias(c) for c in brackets.columns if c != "_all"]
    return rows.select("*", *constants)


def _grid(levels: list[float] | None, margin: float) -> list[float]:
    if levels is None:
        return sorted(_EVEN)
    around = {round(q + s * 2 * margin, 12) for q in levels for s in (-1, 1)}
    return sorted(p for p in around if 0 < p < 1) or [0.5]
