"""Centroid clustering over zone maps: vectors in the order of a space-filling curve, cut into blocks with min/max boxes.

Every component x becomes the whole number floor(1024 x), and all arithmetic on them is exact.

1. A vector's place on the Hilbert curve of its ``BITS`` leading bits per component (of the span of all vectors) orders
   the table by range; neighbours are packed into blocks of ``BLOCK_ROWS``, stored once with the box of their components.
2. In a round, a box gives every centroid a least and a greatest distance to the block's vectors. Centroids whose least distance is above the
   smallest greatest distance cannot be nearest to any of them; the others are the block's candidates.
3. A block with one candidate adds its stored sums; otherwise the candidates' distances are compared for all vectors at once.
   A round sends per task one row of count and sums per cluster, added up by Spark; the driver sees one row per cluster.

Defined results: vectors that are NULL, have another number of components or NULL or non-finite ones are left out; equal distances go to the smaller
number; equal rows get equal results, each its own row; the start is drawn by hash of the id (a NULL id counts as empty text), equal hashes by
the components; fewer vectors than centroids give as many centroids as vectors; an empty table gives no rows; NULL ids pass
through; extra columns play no part. Components beyond 2^27 after scaling raise an error instead of losing exactness.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.session import cut

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Leading bits per component on the curve.
BITS = 4
BLOCK_ROWS = 128
#: Bytes of packed vectors in a partition of the ordered table.
PARTITION_BYTES = 16 << 20
LIMIT = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places on the Hilbert curve, as byte strings that sort like them, of rows of cells of ``bits`` bits.

    The cells' bits are untangled from the leading one down: where a dimension has the bit, the first dimension is mirrored below it, else
    both exchange what differs; a Gray code over the dimensions follows.
    """
    axes = cells.T.astype(np.uint32).copy()
    size = len(axes)
    mask = np.uint32(1 << (bits - 1))
    while mask > 1:
        below = np.uint32(mask - 1)
        for i in range(size):
            has = (axes[i] & mask) > 0
            swap = np.where(has, np.uint32(0), (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(has, below, swap)
            axes[i] ^= swap
        mask >>= np.uint32(1)
    for i in range(1, size):
        axes[i] ^= axes[i - 1]
    turned = np.zeros(axes.shape[1], np.uint32)
    mask = np.uint32(1 << (bits - 1))
    while mask > 1:
        turned ^= np.where((axes[-1] & mask) > 0, np.uint32(mask - 1), np.uint32(0))
        mask >>= np.uint32(1)
    axes ^= turned
    planes = [(axes >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]


def _usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return (F.size(vector) == size) & finite


def _whole(batch: pa.RecordBatch, size: int) -> np.ndarray:
    entries = batch.column("_vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    scaled = np.floor(entries * SCALE)
    if len(scaled) and np.abs(scaled).max() > LIMIT:
        raise ArithmeticError(f"a component beyond {LIMIT} after scaling")
    return scaled.astype(np.int64)


def start_centroids(rows: DataFrame, size: int, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("h"), F.transform("_vector", lambda c: c.cast("double")).alias("v")).orderBy("h", "v").limit(clusters).collect()
    return np.floor(np.array([r["v"] for r in first], float).reshape(-1, size) * SCALE).astype(np.int64)


def zone_map(rows: DataFrame, size: int, bits: int = BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of neighbours on the curve: ids, packed components, box and sums; stored in the shared folder."""
    span = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min(F.transform("_vector", lambda c: c.cast("double")))).alias("low"),
        F.max(F.array_max(F.transform("_vector", lambda c: c.cast("double")))).alias("high"),
    ).first()
    partitions = max(1, -(-span["n"] * size * 4 // PARTITION_BYTES), min(span["n"] // block_rows, rows.sparkSession.sparkContext.defaultParallelism))
    low, width = np.floor((span["low"] or 0) * SCALE), np.floor(((span["high"] or 0) - (span["low"] or 0)) * SCALE) + 1
    id_type = rows.schema["_id"].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            x = _whole(batch, size)
            cells = np.clip((x - low) / width * (1 << bits), 0, (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array(hilbert_keys(cells, bits), pa.binary()), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()),
            ], names=["_id", "key", "x"])

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.int32).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column("_id")), pa.array([x.tobytes()], pa.binary()),
                    pa.array([np.stack([x.min(0), x.max(0)]).tobytes()], pa.binary()), pa.array([x.sum(0, dtype=np.int64).tobytes()], pa.binary()),
                ], names=["ids", "x", "box", "sums"])

    ordered = rows.select("_id", "_vector").mapInArrow(placed, f"_id {id_type}, key binary, x binary")
    # the id tells equal vectors apart, so that very many of them spread over partitions
    dealt = ordered.repartitionByRange(int(partitions), "key", "_id").sortWithinPartitions("key", "_id")
    return cut(dealt.mapInArrow(packed, f"ids array<{id_type}>, x binary, box binary, sums binary"))


def candidates(box: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector inside the box (2, dimensions)."""
    low, high = box.astype(np.int64)
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    reach = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    least, most = (outside * outside).sum(1), (reach * reach).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of every row's nearest centroid of ``among``, exact."""
    chosen = centroids[among]
    wide = max(int(np.abs(x).max(initial=0)), int(np.abs(chosen).max(initial=0)))
    if 4 * wide * wide * x.shape[1] < 2**53:  # every partial sum is a whole number that a double holds
        a, b = x.astype(np.float64), chosen.astype(np.float64)
        distance = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    else:
        distance = np.stack([((x - c) ** 2).sum(1) for c in chosen], 1)
    best = distance.argmin(1)
    return among[best], distance[np.arange(len(x)), best]


def _blocks(batches, size: int):
    for batch in batches:
        for ids, x, box, sums in zip(*(batch.column(c) for c in ("ids", "x", "box", "sums"))):
            yield ids, x, np.frombuffer(box.as_buffer(), np.int32).reshape(2, size), np.frombuffer(sums.as_buffer(), np.int64)


def _components(x, size: int) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32).reshape(-1, size).astype(np.int64)


def cluster_sums(blocks: DataFrame, centroids: np.ndarray, with_distance: bool = False) -> list:
    """Per non-empty cluster its number, count, sums of components, and sum of distances if asked for."""
    size = centroids.shape[1]

    def summed(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
        inertia = [0] * len(centroids)
        for ids, packed, box, sums in _blocks(batches, size):
            among = candidates(box, centroids)
            if len(among) == 1 and not with_distance:
                count[among[0]] += len(ids)
                total[among[0]] += sums
                continue
            x = _components(packed, size)
            number, distance = nearest(x, centroids, among)
            for k in among:
                mine = number == k
                count[k] += mine.sum()
                total[k] += x[mine].sum(0)
                inertia[k] += int(distance[mine].sum())
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array([[Decimal(int(v)) for v in total[k]] for k in some], pa.list_(pa.decimal128(38, 0))),
            pa.array([Decimal(inertia[k]) for k in some], pa.decimal128(38, 0)),
        ], names=["cluster", "n", "s", "inertia"])

    parts = blocks.mapInArrow(summed, "cluster int, n long, s array<decimal(38,0)>, inertia decimal(38,0)")
    return parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s")
    ).collect()


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Every non-empty cluster's centroid at the floor of its mean."""
    result = centroids.copy()
    for row in sums:
        result[row["cluster"]] = [int(v) // row["n"] for v in row["s"]]
    return result


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """Per vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256. An inertia beyond a long is NULL."""
    rows = df.select(F.col(key).alias("_id"), F.col(vector).alias("_vector")).filter(_usable(F.col("_vector"), size))
    centroids = start_centroids(rows, size, clusters, seed)
    id_type = df.schema[key].dataType.simpleString()
    schema = f"_id {id_type}, cluster int, distance long"
    names = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    if not len(centroids):
        return df.select(key).limit(0).selectExpr(f"`{key}`", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    blocks = zone_map(rows, size)
    for _ in range(rounds):
        after = moved(centroids, cluster_sums(blocks, centroids))
        if (after == centroids).all():
            break  # a fixed point: every further round would repeat this one
        centroids = after
    inertia = {r["cluster"]: int(r["inertia"]) for r in cluster_sums(blocks, centroids, with_distance=True)}

    def assigned(batches):
        for ids, packed, box, _ in _blocks(batches, size):
            number, distance = nearest(_components(packed, size), centroids, candidates(box, centroids))
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(number.astype(np.int32)), pa.array(distance)], names=["_id", "cluster", "distance"])

    def literal(value: int) -> Column:
        return F.lit(value if value < 2**63 else None).cast("long")

    every = range(len(centroids))
    by_cluster = F.array(*[literal(inertia.get(k, 0)) for k in every])
    digests = F.array(*[F.lit(centroid_digest(centroids[k])) for k in every])
    out = blocks.mapInArrow(assigned, schema).select(
        F.col("_id").alias(key), "cluster", "distance", by_cluster[F.col("cluster")].alias("cluster_inertia"),
        literal(sum(inertia.values())).alias("inertia"), digests[F.col("cluster")].alias("centroid_sha256"),
    )
    return out.select(key, *names)
