"""Readers and writers: record files, state tables, results, models, time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltail.sources.schemas import EVALUATION, PARAMETERS, RECORDS, states_schema

#: The accepted time formats, tried in this order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd-MM-yy HH:mm:ss", "yyyyMMdd")


def read_records(spark: SparkSession, *paths: str, schema: T.StructType = RECORDS) -> DataFrame:
    """Many record files as one table; a later ``select`` prunes the scan."""
    return spark.read.schema(schema).parquet(*paths)


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per run, files in packet order.

    Rows are range-partitioned on (run, id) first, so that a long run is split over several
    files and a short one does not leave a file per task.
    """
    (
        records.repartitionByRange("run_id", "id")
        .sortWithinPartitions("run_id", "id")
        .write.mode(mode)
        .partitionBy("run_id")
        .parquet(path)
    )


def concat_runs(frames: list[DataFrame]) -> DataFrame:
    """All rows of all runs, each marked with its position in the list as ``run_id``."""
    marked = [frame.withColumn("run_id", F.lit(i)) for i, frame in enumerate(frames)]
    return reduce(lambda left, right: left.unionByName(right), marked)


def write_states_csv(states: DataFrame, path: str, limit: int) -> None:
    """The most common states as one CSV file with a header (a top-k report)."""
    keys = [name for name in states.columns if name.startswith("state")]
    top = states.orderBy(F.desc("count"), *keys).limit(limit)
    top.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_states_csv(spark: SparkSession, path: str, predictor: str) -> DataFrame:
    return spark.read.schema(states_schema(predictor)).option("header", True).csv(path)


def append_results_csv(results: DataFrame, path: str) -> None:
    """Append to a ``;``-separated result table; every part file carries the header."""
    results.write.mode("append").option("sep", ";").option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def find_time_column(columns: list[str]) -> str | None:
    """The first column named like a time or a date."""
    for name in columns:
        if "time" in name.lower() or "date" in name.lower():
            return name
    return None


def parse_times(df: DataFrame, column: str, formats: tuple[str, ...] = TIME_FORMATS) -> DataFrame:
    """Parse ``column`` with the first format that fits every row.

    One aggregate counts the failures of each format; a table in which no format fits all
    rows is an error rather than a mixture of formats.
    """
    failures = df.agg(
        *[
            F.coalesce(
                F.sum((F.col(column).isNotNull() & F.try_to_timestamp(column, F.lit(fmt)).isNull()).cast("long")),
                F.lit(0),
            ).alias(f"f{i}")
            for i, fmt in enumerate(formats)
        ]
    ).first()
    fitting = [fmt for i, fmt in enumerate(formats) if failures[i] == 0]
    if not fitting:
        raise ValueError(f"no time format fits every row of {column!r}")
    return df.withColumn(column, F.try_to_timestamp(column, F.lit(fitting[0])))


def load_time_series(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    delimiter: str = ",",
    time_column: str | None = None,
    formats: tuple[str, ...] = TIME_FORMATS,
) -> DataFrame:
    """A CSV time series in time order, or in order of its first column if it has no time."""
    reader = spark.read.option("header", True).option("sep", delimiter)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    column = time_column or find_time_column(df.columns)
    if column is None:
        return df.orderBy(df.columns[0])
    return parse_times(df, column, formats).orderBy(column)


def write_replicas(replicas: DataFrame, path: str) -> None:
    """Training replicas; predictor and replica are folders, the other meta data columns."""
    replicas.repartition("predictor", "replica").write.mode("overwrite").partitionBy(
        "predictor", "replica"
    ).parquet(path)


def write_parameters(params: DataFrame, path: str, mode: str = "append") -> None:
    """Fitted models as a table keyed by (model, predictor, n_train, replica, state)."""
    params.write.mode(mode).partitionBy("model", "predictor").parquet(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMETERS).parquet(path).select(*PARAMETERS.fieldNames())


def write_evaluation(results: DataFrame, path: str, mode: str = "append") -> None:
    results.write.mode(mode).partitionBy("model", "n_train").parquet(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION).parquet(path).select(*EVALUATION.fieldNames())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order; those ``df`` lacks become NULL."""

    def field(f: T.StructField) -> Column:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        return source.cast(f.dataType).alias(f.name)

    return df.select(*[field(f) for f in schema.fields])
