"""From timed logs to records, predictor datasets and occupancy snapshots."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.operators.ordered import scan_ordered
from dwelltail.operators.ranks import select_ranks
from dwelltail.operators.sampling import first_along
from dwelltail.session import attach
from dwelltail.sources.schemas import DELAY_COLUMNS, SNAPSHOTS, STATE_COLUMNS


def logs_to_records(logs: DataFrame) -> DataFrame:
    """Delays per hop and the occupancy at each snapshot point (queue plus server)."""
    entered = {"uplink": "starttime", "compute": "servicetime_uplink", "downlink": "servicetime_compute"}
    left = {"uplink": "servicetime_uplink", "compute": "servicetime_compute", "downlink": "endtime"}
    columns = [(F.col("endtime") - F.col("starttime")).alias("end2enddelay")]
    for hop in entered:
        queue, service = F.col(f"queuetime_{hop}"), F.col(f"servicetime_{hop}")
        columns += [
            (queue - F.col(entered[hop])).alias(f"queuedelay_{hop}"),
            (service - queue).alias(f"servicedelay_{hop}"),
            (F.col(left[hop]) - F.col(entered[hop])).alias(f"totaldelay_{hop}"),
        ]
    for point, hop in SNAPSHOTS:
        seen = F.col(f"{point}_{hop}_queuen") + F.col(f"{point}_{hop}_servern")
        columns.append(seen.cast("double").alias(f"{point}_{hop}_netstate"))
    return logs.select("run_id", "id", *columns)


def predictor_view(records: DataFrame, predictor: str) -> DataFrame:
    """delay and state columns of one prediction point; only these reach the scan."""
    if predictor == "bu":
        delay, point, hops = F.col("end2enddelay"), "h1", ("uplink", "compute", "downlink")
    elif predictor == "bc":
        delay = F.col("totaldelay_compute") + F.col("totaldelay_downlink")
        point, hops = "h2", ("compute", "downlink")
    elif predictor == "bd":
        delay, point, hops = F.col("totaldelay_downlink"), "h3", ("downlink",)
    else:
        raise ValueError(f"unknown predictor {predictor!r}")
    states = [
        F.col(f"{point}_{hop}_netstate").cast("int").alias(f"state{i}") for i, hop in enumerate(hops, 1)
    ]
    return records.select(delay.alias("delay"), *states)


def of_state(dataset: DataFrame, state: dict[str, int]) -> DataFrame:
    """Rows of exactly one state; the equalities are pushed to the scan."""
    for name, number in state.items():
        dataset = dataset.filter(F.col(name) == number)
    return dataset


def drop_transient(records: DataFrame, proportion: float) -> DataFrame:
    """Each run without its first floor(proportion * n) packets, in packet order.

    Ids are unique within a run, so the cut in rank is a cut in id.
    """
    share = F.lit(Decimal(str(proportion)))
    cuts = select_ranks(
        records, ["run_id"], "id", {"_cut": lambda n: (F.floor(share * n) + 1).cast("long")}, [proportion]
    )
    kept = attach(records, cuts.select("run_id", "_cut"), ["run_id"])
    return kept.filter(F.col("id") >= F.col("_cut")).select(*records.columns)


def interarrival(logs: DataFrame) -> DataFrame:
    """Time since the previous packet of the run; NULL for its first packet."""
    thin = logs.select("run_id", "id", "starttime")
    scanned = scan_ordered(thin, ["run_id"], ["id"], previous={"_prev": "starttime"})
    return scanned.select("run_id", "id", (F.col("starttime") - F.col("_prev")).alias("interarrival"))


def sort_records(records: DataFrame) -> DataFrame:
    """Packet order within runs, as a range partitioning sorted inside each partition."""
    order = ["run_id", "id"]
    return records.repartitionByRange(*order).sortWithinPartitions(*order)


def first_rows(records: DataFrame, n: int) -> DataFrame:
    """The first n rows in (run, packet) order."""
    return first_along(records, ["run_id", "id"], n)


def row_range(records: DataFrame, lo: int, hi: int, order: str = "id") -> DataFrame:
    """Rows lo <= i < hi by position along the unique column ``order``."""
    ends = {"_lo": lambda n: F.lit(lo + 1).cast("long"), "_hi": lambda n: F.least(F.lit(hi), n).cast("long")}
    cut = select_ranks(records, [], order, ends).first()
    if cut is None or cut["_lo"] is None or hi <= lo:
        return records.limit(0)
    return records.filter(F.col(order).between(cut["_lo"], cut["_hi"]))


#: Hop -> (time of entry, time of exit).
STAYS = {
    "uplink": ("starttime", "servicetime_uplink"),
    "compute": ("servicetime_uplink", "servicetime_compute"),
    "downlink": ("servicetime_compute", "endtime"),
}


def _change(time: str) -> Column:
    """What happens at one of a packet's times: net change per hop, and entries that stay."""
    fields = [F.col(time).alias("t")]
    for hop, (entry, leave) in STAYS.items():
        fields.append(F.lit(int(time == entry) - int(time == leave)).alias(f"net_{hop}"))
        stays = (F.col(leave) > F.col(entry)).cast("int") if time == entry else F.lit(0)
        fields.append(stays.alias(f"in_{hop}"))
    return F.struct(*fields)


def occupancy_snapshots(logs: DataFrame, **scan_options) -> DataFrame:
    """How many packets of the run are in each hop when a packet reaches a snapshot point.

    A packet is in a hop from entry up to, not including, exit. The hop being entered counts
    only packets that entered strictly earlier, so those that enter at the instant and stay are
    taken off again. Changes are summed per (run, time) before
    the shuffle, so many packets at one instant are one row of the running sum.
    """
    hops = ("uplink", "compute", "downlink")
    times = ("starttime", "servicetime_uplink", "servicetime_compute", "endtime")
    changes = logs.select("run_id", F.inline(F.array(*[_change(time) for time in times])))
    at_time = changes.groupBy("run_id", "t").agg(
        *[F.sum(f"{c}_{h}").alias(f"{c}_{h}") for h in hops for c in ("in", "net")]
    )
    curve = scan_ordered(
        at_time, ["run_id"], ["t"], sums={f"occ_{h}": f"net_{h}" for h in hops}, **scan_options
    ).select("run_id", "t", *[f"occ_{h}" for h in hops], *[f"in_{h}" for h in hops])

    probes = logs.select(
        "run_id",
        "id",
        F.inline(
            F.array(
                F.struct(F.lit("h1").alias("point"), F.col("starttime").alias("t")),
                F.struct(F.lit("h2").alias("point"), F.col("servicetime_uplink").alias("t")),
                F.struct(F.lit("h3").alias("point"), F.col("servicetime_compute").alias("t")),
            )
        ),
    )
    entering = {"h1": "uplink", "h2": "compute", "h3": "downlink"}
    seen = probes.join(curve, ["run_id", "t"])
    counts = []
    for point, hop in SNAPSHOTS:
        present = F.col(f"occ_{hop}") - (F.col(f"in_{hop}") if entering[point] == hop else F.lit(0))
        counts.append(F.max(F.when(F.col("point") == point, present)).alias(f"{point}_{hop}"))
    return seen.groupBy("run_id", "id").agg(*counts)


def with_occupancies(logs: DataFrame) -> DataFrame:
    """Logs with queue and server counts from the snapshots; one packet of a hop is served."""
    snapshots = occupancy_snapshots(logs)
    columns = []
    for point, hop in SNAPSHOTS:
        seen = F.col(f"{point}_{hop}")
        columns += [
            F.greatest(seen - 1, F.lit(0)).cast("double").alias(f"{point}_{hop}_queuen"),
            F.least(seen, F.lit(1)).cast("double").alias(f"{point}_{hop}_servern"),
        ]
    joined = logs.join(snapshots, ["run_id", "id"])
    return joined.select(*logs.columns, *columns)


def record_columns() -> list[str]:
    return [*DELAY_COLUMNS, *STATE_COLUMNS]
