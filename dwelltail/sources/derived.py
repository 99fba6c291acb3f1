"""Logs, predictor datasets and curves derived from the supplied tables.

The tables hold no packet records. These are the fixed derivations under which
every query runs: ``lineitem`` gives delays with small integer states,
``events`` gives timed logs and arrival / departure curves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwelltail.session import cut

_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, predictor: str) -> DataFrame:
    """delay, state1[, state2[, state3]] of one predictor from ``lineitem``."""
    line = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    number = F.col("l_linenumber")
    if predictor == "bu":
        return line.select(
            F.col("l_extendedprice").alias("delay"),
            flag.alias("state1"),
            status.alias("state2"),
            number.alias("state3"),
        )
    if predictor == "bc":
        return line.select(
            (F.col("l_extendedprice") + F.col("l_quantity")).alias("delay"),
            status.alias("state1"),
            number.alias("state2"),
        )
    return line.select(F.col("l_quantity").alias("delay"), number.alias("state1"))


def event_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run_id, event_type, v (value), k (from the JSON), st (seconds)."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") % 2).cast("int").alias("run_id"),
        "event_type",
        "user_id",
        "ts",
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ts)") / 1e6).alias("st"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet timestamps of two runs, without occupancies."""
    st, v, k = F.col("st"), F.col("v"), F.col("k")
    leave = st + 7.5 * v + 0.7 * k
    return event_columns(spark, sf_dir).select(
        "run_id",
        F.col("event_id").alias("id"),
        st.alias("starttime"),
        leave.alias("endtime"),
        (st + 1.0 * v).alias("queuetime_uplink"),
        (st + 3.0 * v).alias("servicetime_uplink"),
        (st + 3.0 * v + 0.5 * k).alias("queuetime_compute"),
        (st + 6.0 * v + 0.5 * k).alias("servicetime_compute"),
        (st + 6.0 * v + 0.7 * k).alias("queuetime_downlink"),
        leave.alias("servicetime_downlink"),
    )


def curve_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, slot, arrived, departed: amounts per hour, hours without events included."""
    events = table(spark, sf_dir, "events")
    arriving = F.col("event_type").isin("click", "view")
    leaving = F.col("event_type").isin("purchase", "signup")
    hourly = (
        events.select(
            (F.col("user_id") % 2).cast("int").alias("run_id"),
            F.floor(F.expr(f"timestampdiff(SECOND, {_EPOCH}, ts)") / 3600).cast("int").alias("slot"),
            F.when(arriving, F.col("value")).otherwise(0.0).alias("arrived"),
            F.when(leaving, F.col("value")).otherwise(0.0).alias("departed"),
        )
        .groupBy("run_id", "slot")
        .agg(F.sum("arrived").alias("arrived"), F.sum("departed").alias("departed"))
    )
    hourly = cut(hourly)
    ends = hourly.agg(F.min("slot").alias("first"), F.max("slot").alias("last")).first()
    hours = F.sequence(F.lit(ends["first"] or 0), F.lit(ends["last"] or 0))
    slots = hourly.select("run_id").distinct().select("run_id", F.explode(hours).alias("slot"))
    return slots.join(hourly, ["run_id", "slot"], "left").na.fill(0.0, ["arrived", "departed"])


def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state (event type), y: the exponential-like values for tail and mixture fits."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("state"), F.col("value").alias("y")
    )


def kernel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (0..99), y for the kernel estimators."""
    return event_columns(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("k").alias("x"), F.col("v").alias("y")
    )
