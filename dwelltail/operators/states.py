"""Which states occur, how often, and which are the most common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.operators.ordered import scan_ordered
from dwelltail.session import complete_rows


def state_frequency(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, count, prob. One pass; the total is the sum of the counted table."""
    counted = df.groupBy(*keys).count()
    total = counted.agg(F.sum("count").alias("total")).scalar()
    return counted.withColumn("prob", F.col("count") / total)


def top_states(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` most common states; ties go to the smaller state."""
    return state_frequency(df, keys).orderBy(F.desc("count"), *keys).limit(limit)


def top_states_total(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Rows and share that the ``limit`` most common states hold together."""
    return top_states(df, keys, limit).agg(
        F.count("*").alias("n_states"), F.sum("count").alias("sum_count"), F.sum("prob").alias("sum_prob")
    )


def cumulative_share(frequency: DataFrame, keys: list[str]) -> DataFrame:
    """Running share over the states in descending frequency."""
    ordered = frequency.withColumn("_rare", -F.col("count")).withColumn("_all", F.lit(0))
    scanned = scan_ordered(ordered, ["_all"], ["_rare", *keys], sums={"cumprob": "prob"})
    return scanned.drop("_rare", "_all")


def distinct_states(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def common_states(records: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    return top_states(complete_rows(records, value, keys), keys, limit)
