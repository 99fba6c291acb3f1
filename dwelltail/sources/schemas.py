"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

HOPS = ("uplink", "compute", "downlink")

#: (snapshot point, hop) pairs at which a packet sees an occupancy.
SNAPSHOTS = (
    ("h1", "uplink"),
    ("h1", "compute"),
    ("h1", "downlink"),
    ("h2", "compute"),
    ("h2", "downlink"),
    ("h3", "downlink"),
)

TIME_COLUMNS = [
    "starttime",
    "endtime",
    "queuetime_uplink",
    "servicetime_uplink",
    "queuetime_compute",
    "servicetime_compute",
    "queuetime_downlink",
    "servicetime_downlink",
]

COUNT_COLUMNS = [f"{point}_{hop}_{part}" for point, hop in SNAPSHOTS for part in ("queuen", "servern")]

DELAY_COLUMNS = ["end2enddelay"] + [
    f"{kind}delay_{hop}" for hop in HOPS for kind in ("queue", "service", "total")
]

STATE_COLUMNS = [f"{point}_{hop}_netstate" for point, hop in SNAPSHOTS]


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.DoubleType()) for name in names]


_KEY = [T.StructField("run_id", T.IntegerType()), T.StructField("id", T.LongType())]

LOGS = T.StructType(_KEY + _doubles(TIME_COLUMNS + COUNT_COLUMNS))
RECORDS = T.StructType(_KEY + _doubles(DELAY_COLUMNS + STATE_COLUMNS))

#: Predictor name -> number of occupancies in its state.
PREDICTORS = {"bu": 3, "bc": 2, "bd": 1}


def state_columns(predictor: str) -> list[str]:
    return [f"state{i}" for i in range(1, PREDICTORS[predictor] + 1)]


def dataset_schema(predictor: str) -> T.StructType:
    states = [T.StructField(name, T.IntegerType()) for name in state_columns(predictor)]
    return T.StructType([T.StructField("delay", T.DoubleType()), *states])


def states_schema(predictor: str) -> T.StructType:
    states = [T.StructField(name, T.IntegerType()) for name in state_columns(predictor)]
    return T.StructType(
        [*states, T.StructField("count", T.LongType()), T.StructField("prob", T.DoubleType())]
    )


PARAMETERS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("predictor", T.StringType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("replica", T.IntegerType()),
        T.StructField("state1", T.IntegerType()),
        T.StructField("state2", T.IntegerType()),
        T.StructField("state3", T.IntegerType()),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("mu", T.ArrayType(T.DoubleType())),
        T.StructField("sigma", T.ArrayType(T.DoubleType())),
        T.StructField("u", T.DoubleType()),
        T.StructField("xi", T.DoubleType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)

EVALUATION = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("state1", T.IntegerType()),
        T.StructField("state2", T.IntegerType()),
        T.StructField("state3", T.IntegerType()),
        T.StructField("q", T.DoubleType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
