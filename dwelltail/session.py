"""Session settings and the helpers every operator shares.

Three rules live here so that the operators need not repeat them:

* lineage is cut by a reliable checkpoint in the folder the cluster names, never
  on an executor's own disk;
* a table is broadcast only after its rows were counted, and there is a
  salted shuffle join for the case that it is too large;
* rows with a missing delay or state are dropped once, and counted.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Estimated bytes up to which a counted side is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Elements an array column is taken to have in that estimate.
ARRAY_LENGTH = 64
#: Copies of the small side when it is too large to broadcast.
SALTS = 16


def get_session(cores: str = "*", partitions: int = 8, app: str = "dwelltail") -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` decides. Only a local session without that setting gets
    a temporary folder; on a cluster a missing setting is an error, because a folder
    of one machine would not survive the loss of an executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="dwelltail-")


def cut(df: DataFrame, measure: Column | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there.

    The rows are counted while they are written; ``row_count`` then costs no job, and neither
    does ``measured`` for the aggregate given as ``measure``. A table that was cut already is
    returned as it is.
    """
    if getattr(df, "_stored_rows", None) is not None and measure is None:
        return df
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    counted = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    if measure is not None:
        metrics.append(measure.alias("measure"))
    stored = df.observe(counted, *metrics).checkpoint(eager=True)
    stored._stored_rows = counted.get["rows"]
    stored._measured = counted.get.get("measure")
    return stored


def row_count(df: DataFrame) -> int:
    known = getattr(df, "_stored_rows", None)
    return df.count() if known is None else known


def salt_of(columns: list[str], salts: int = SALTS) -> Column:
    """Deterministic salt: a retried task gives a row the same salt again."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def row_bytes(data_type: T.DataType) -> int:
    """Rough size of one value."""
    if isinstance(data_type, T.StructType):
        return sum(row_bytes(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return ARRAY_LENGTH * row_bytes(data_type.elementType)
    return 64 if isinstance(data_type, T.StringType) else 8


def broadcast_fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return row_count(df) * row_bytes(df.schema) <= limit


def attach(
    rows: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a per-key table to record-sized ``rows``.

    ``small`` is materialised and counted first. Within the bound in bytes it is broadcast and
    the records are not shuffled; beyond it the records are spread over ``SALTS`` copies
    of every key, so that one hot key does not end in one task.
    """
    small = cut(small)
    if broadcast_fits(small, max_broadcast_bytes):
        return rows.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", salt_of(rows.columns))
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")


def attach_bounded(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table whose rows are bounded by construction (a LIMIT, a literal list)."""
    return rows.join(F.broadcast(small), keys, how)


def complete_rows(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows whose value is a number and whose keys are present."""
    keep = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for key in keys:
        keep = keep & F.col(key).isNotNull()
    return df.filter(keep)


def incomplete_count(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One row: how many rows ``complete_rows`` leaves out."""
    missing = F.col(value).isNull() | F.isnan(F.col(value).cast("double"))
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.agg(F.coalesce(F.sum(missing.cast("long")), F.lit(0)).alias("dropped"))
