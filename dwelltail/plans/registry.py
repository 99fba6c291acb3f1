"""Every query with the SQL text that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltail.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL counterpart if SQL can express it."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns at the output: sums differ in their last bits by order of addition."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- SQL text of the derived tables (see sources/derived.py) ---

BU = """bu as (select l_extendedprice as delay,
  case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as state1,
  case l_linestatus when 'F' then 0 else 1 end as state2, l_linenumber as state3 from lineitem)"""
BC = """bc as (select l_extendedprice + l_quantity as delay,
  case l_linestatus when 'F' then 0 else 1 end as state1, l_linenumber as state2 from lineitem)"""
BD = "bd as (select l_quantity as delay, l_linenumber as state1 from lineitem)"
EV = """ev as (select event_id, (event_id % 2)::int as run_id, event_type, user_id, value as v,
  cast(json_extract_string(props, '$.k') as double) as k,
  date_diff('microsecond', timestamp '2024-01-01', ts) / 1e6 as st from events)"""
LOGS = (
    EV
    + """, logs as (select run_id, event_id as id, st as starttime, st + 7.5*v + 0.7*k as endtime,
  st + 1.0*v as queuetime_uplink, st + 3.0*v as servicetime_uplink,
  st + 3.0*v + 0.5*k as queuetime_compute, st + 6.0*v + 0.5*k as servicetime_compute,
  st + 6.0*v + 0.7*k as queuetime_downlink, st + 7.5*v + 0.7*k as servicetime_downlink from ev)"""
)


def _inside(entry: str, exit: str, at: str, strict: bool) -> str:
    sign = "<" if strict else "<="
    return (
        f"(select count(*) from logs j where j.run_id = i.run_id and j.{entry} {sign} i.{at} "
        f"and j.{exit} > i.{at})"
    )


_UP, _CO, _DO = (
    ("starttime", "servicetime_uplink"),
    ("servicetime_uplink", "servicetime_compute"),
    ("servicetime_compute", "endtime"),
)
SNAPS = (
    LOGS
    + f""", snaps as (select run_id, id,
  {_inside(*_UP, 'starttime', True)} as h1_uplink,
  {_inside(*_CO, 'starttime', False)} as h1_compute,
  {_inside(*_DO, 'starttime', False)} as h1_downlink,
  {_inside(*_CO, 'servicetime_uplink', True)} as h2_compute,
  {_inside(*_DO, 'servicetime_uplink', False)} as h2_downlink,
  {_inside(*_DO, 'servicetime_compute', True)} as h3_downlink
  from logs i)"""
)
RECORDS = (
    SNAPS
    + """, records as (select run_id, id, endtime - starttime as end2enddelay,
  queuetime_uplink - starttime as queuedelay_uplink,
  servicetime_uplink - queuetime_uplink as servicedelay_uplink,
  servicetime_uplink - starttime as totaldelay_uplink,
  queuetime_compute - servicetime_uplink as queuedelay_compute,
  servicetime_compute - queuetime_compute as servicedelay_compute,
  servicetime_compute - servicetime_uplink as totaldelay_compute,
  queuetime_downlink - servicetime_compute as queuedelay_downlink,
  servicetime_downlink - queuetime_downlink as servicedelay_downlink,
  endtime - servicetime_compute as totaldelay_downlink,
  h1_uplink::double as h1_uplink_netstate, h1_compute::double as h1_compute_netstate,
  h1_downlink::double as h1_downlink_netstate, h2_compute::double as h2_compute_netstate,
  h2_downlink::double as h2_downlink_netstate, h3_downlink::double as h3_downlink_netstate
  from logs join snaps using (run_id, id))"""
)
CURVE = """hours as (select floor(date_diff('second', timestamp '2024-01-01', ts) / 3600)::int as hour from events),
 slots as (select r.run_id, s.slot from (select distinct (user_id % 2)::int as run_id from events) r,
  (select unnest(range(min(hour), max(hour) + 1))::int as slot from hours) s),
 hourly as (select (user_id % 2)::int as run_id,
  floor(date_diff('second', timestamp '2024-01-01', ts) / 3600)::int as slot,
  sum(case when event_type in ('click','view') then value else 0 end) as arrived,
  sum(case when event_type in ('purchase','signup') then value else 0 end) as departed
  from events group by all),
 curve as (select run_id, slot,
  round(sum(coalesce(arrived, 0)) over (partition by run_id order by slot), 2) as a,
  round(sum(coalesce(departed, 0)) over (partition by run_id order by slot), 2) as d
  from slots left join hourly using (run_id, slot))"""
TAIL = "tl as (select event_id as id, event_type as state, value as y from events)"
KERN = EV + ", kr as (select event_id as id, k as x, v as y from ev)"


def hash_sql(seed: int, *parts: str) -> str:
    """SQL of ``sampling.hashed``."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({p})::varchar" for p in parts]])
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def uniform_sql(seed: int, *parts: str) -> str:
    return f"(({hash_sql(seed, *parts)} % 4294967296) + 0.5) / 4294967296.0::double"


def normal_sql(seed: int, *parts: str) -> str:
    r = uniform_sql(seed, *parts, "'r'")
    a = uniform_sql(seed, *parts, "'a'")
    return f"(sqrt(-2.0 * ln({r})) * cos(6.283185307179586 * ({a})))"


def level_list(levels) -> str:
    return "[" + ", ".join(f"{float(q)!r}::double" for q in levels) + "]"
