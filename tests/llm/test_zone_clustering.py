import hashlib

import numpy as np
import pytest

from dwelltail.llm import zone_clustering as zc

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, size, clusters, rounds):
    """Plain k-means over whole numbers; rows (id, vector)."""
    kept = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assign():
        found = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            found.append((d.index(min(d)), min(d)))
        return found

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), f in zip(kept, found) if f[0] == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    inertia = [sum(d for k, d in found if k == j) for j in range(len(centroids))]
    text = [",".join(map(str, c)) for c in centroids]
    return sorted((str(i), k, d, inertia[k], sum(inertia), hashlib.sha256(text[k].encode()).hexdigest()) for (i, _), (k, d) in zip(kept, found))


def result(df, **options):
    return sorted((str(r[0]), *r[1:]) for r in zc.cluster(df, **options).collect())


@pytest.mark.parametrize("bits,size", [(1, 2), (3, 2), (2, 3), (4, 4)])
def test_curve_visits_every_cell_in_unit_steps(bits, size):
    cells = np.array(list(np.ndindex(*[1 << bits] * size)))
    keys = zc.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_equal_to_brute_force(spark):
    draw = np.random.default_rng(5)
    middles = draw.standard_normal((5, 6)) * 3
    rows = [(i, (middles[i % 5] + draw.standard_normal(6) / 3).tolist()) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 1000)]  # a third of all are equal
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1])]
    bad = [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 6), (2003, [None] * 6), (2004, [float("-inf")] * 6), (2005, [])]
    got = result(frame(spark, rows + bad), size=6, clusters=4, rounds=4)
    assert got == brute(rows, 6, 4, 4)


def test_boxes_leave_out_only_centroids_that_are_never_nearest():
    draw = np.random.default_rng(2)
    left_out = 0
    for _ in range(200):
        x = draw.integers(-50, 50, (20, 3)) // draw.integers(1, 20)
        centroids = draw.integers(-60, 60, (6, 3))
        among = zc.candidates(np.stack([x.min(0), x.max(0)]).astype(np.int32), centroids)
        left_out += 6 - len(among)
        assert all((a == b).all() for a, b in zip(zc.nearest(x, centroids, among), zc.nearest(x, centroids, np.arange(6))))
    assert left_out > 200


def test_ties_large_numbers_and_few_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0])]
    assert result(frame(spark, rows), size=2, clusters=2, rounds=3) == brute(rows, 2, 2, 3)
    assert result(frame(spark, rows[:2]), size=2) == brute(rows[:2], 2, 8, 10)
    wide = [(i, [2e4 * (i % 7), -1.2e5, float(i)]) for i in range(50)]
    assert result(frame(spark, wide), size=3, clusters=3, rounds=3) == brute(wide, 3, 3, 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_nothing_to_cluster(spark, rows):
    empty = zc.cluster(frame(spark, rows))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not empty.collect()
