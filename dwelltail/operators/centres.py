"""Choosing kernel centres from all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.operators.matching import distance, scales_of
from dwelltail.operators.sampling import hashed


def centres_all(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def centres_random(df: DataFrame, columns: list[str], k: int, row_id: str, seed: int = 1) -> DataFrame:
    """k rows without replacement: the smallest in hash order (a top-k, no full sort)."""
    return df.orderBy(hashed(seed, F.col(row_id)), row_id).limit(k).select(row_id, *columns)


def centres_farthest(df: DataFrame, columns: list[str], k: int, row_id: str) -> list[tuple]:
    """(row id, point) of k centres: the first row, then always the row farthest from all chosen.

    One aggregation per centre; ties go to the smaller id.
    """
    point = F.struct(*columns)
    start = df.agg(F.min_by(F.struct(row_id, *columns), row_id)).first()[0]
    chosen = [tuple(start)]
    while len(chosen) < k:
        gaps = [
            distance([F.col(c) for c in columns], [F.lit(float(v)) for v in centre[1:]], squared=True)
            for centre in chosen
        ]
        nearest = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        best = df.agg(F.max_by(F.struct(row_id, point.alias("p")), F.struct(nearest, -F.col(row_id)))).first()[0]
        chosen.append((best[0], *best["p"]))
    return chosen


def centres_kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """k-means centres as rows (centre, columns)."""
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(df.select(*columns))
    model = KMeans(k=k, seed=seed, featuresCol="_x").fit(rows.select("_x"))
    found = [(i, *[float(v) for v in centre]) for i, centre in enumerate(model.clusterCenters())]
    schema = "centre int, " + ", ".join(f"{c} double" for c in columns)
    return df.sparkSession.createDataFrame(found, schema)


def centres_edges(df: DataFrame, columns: list[str], k: int, row_id: str) -> list[tuple]:
    """Edge points: n_e = min(2 d, k / 2) of the 2 n_e rows farthest from the mean.

    The farthest rows are a top-k over all rows; among those few the picks spread out by
    cosine distance, beginning with the least far one.
    """
    d = len(columns)
    wanted = min(2 * d, k // 2)
    means, _ = scales_of(df, columns)
    away = distance([F.col(c) for c in columns], [F.lit(m) for m in means], squared=True)
    outer = df.select(row_id, *columns, away.alias("_far")).orderBy(F.desc("_far"), row_id).limit(2 * wanted)
    points = [tuple(r)[: d + 1] for r in sorted(outer.collect(), key=lambda r: (r["_far"], -r[row_id]))]

    def cosine(a: tuple, b: tuple) -> float:
        dot = sum(x * y for x, y in zip(a[1:], b[1:]))
        size = (sum(x * x for x in a[1:]) * sum(y * y for y in b[1:])) ** 0.5
        return 1.0 - dot / size if size else 0.0

    chosen = points[:1]
    while len(chosen) < wanted:
        rest = [p for p in points if p not in chosen]
        chosen.append(max(rest, key=lambda p: (round(min(cosine(p, c) for c in chosen), 12), -p[0])))
    return chosen


def without(df: DataFrame, row_id: str, chosen: list[tuple]) -> DataFrame:
    """Rows that are not yet centres."""
    return df.filter(~F.col(row_id).isin([c[0] for c in chosen]))


def as_rows(df: DataFrame, chosen: list[tuple], columns: list[str], row_id: str) -> DataFrame:
    """The chosen points as a table (centre, row id, columns)."""
    numbered = [(i, *c) for i, c in enumerate(chosen)]
    schema = f"centre int, {row_id} bigint, " + ", ".join(f"{c} double" for c in columns)
    return df.sparkSession.createDataFrame([tuple([n[0], n[1], *map(float, n[2:])]) for n in numbered], schema)


def union_centres(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
