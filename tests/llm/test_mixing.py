from collections import defaultdict

import edges
import pytest

from dwelltail.llm import mixing


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Weight shares, with the excess dealt again until nothing is above the cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


def checked(rows, block=mixing.BLOCK_WORDS):
    sizes, taken = defaultdict(int), defaultdict(int)
    for row in rows:
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["taken"]
        assert 0 <= row["taken"] <= 3 * row["size"]
    expected = targets(sizes)
    for row in rows:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(expected[row["source"]])
    for source, words in taken.items():
        assert abs(words - expected[source]) <= 4 * block, source
    return sizes


def test_edge_rows(spark):
    mixed = mixing.mix(edges.frame(spark))
    assert [c for c in mixed.columns if c in mixing.ADDED] == list(mixing.ADDED) and mixed.columns.count("size") == 1
    rows = mixed.collect()
    assert len(rows) == len(edges.rows())
    checked(rows)
    for row in rows:
        assert row["size"] == len((row["text"] or "").encode().split())


def test_many_sources_shards_and_reruns(spark):
    docs = spark.range(3_000).selectExpr(
        "id as doc_id", "repeat('w ', cast(id % 97 + 1 as int)) as text",
        "case when id % 3 = 0 then 'hot' when id % 501 = 1 then null else concat('s', id % 11) end as source",
    )
    runs = [mixing.mix(d, shard_words=3_000).select("doc_id", "source", "size", "source_size", "target", "taken") for d in (docs, docs.repartition(7))]
    first, second = (sorted(map(tuple, r.collect()), key=str) for r in runs)
    assert first == second
    sizes = checked(runs[0].collect(), 45 * mixing.BLOCK_WORDS)
    assert len(sizes) == 13


def test_seats_by_highest_quotients(spark):
    votes = {"a": 53_000.0, "b": 24_000.0, "c": 23_000.0, "d": 1.0, "e": 0.0}
    frame = spark.createDataFrame(list(votes.items()), "party string, votes double")
    from pyspark.sql import functions as F

    for seats in (0, 1, 7, 100):
        won = {r["party"]: r["_seats"] for r in mixing.sainte_lague(frame, [], "party", "votes", F.lit(seats)).collect()}
        expected = dict.fromkeys(votes, 0)
        for _ in range(seats):
            expected[max(votes, key=lambda p: (votes[p] / (2 * expected[p] + 1), [-ord(p)]))] += 1
        assert won == expected


def test_seats_of_many_parties(spark):
    """Equal votes, very small and very large parties, more parties than seats; one group each."""
    import random

    draw = random.Random(3)
    votes = {(g, p): float(draw.choice([1, 1, 5, 90, 4_000, draw.randint(1, 300)])) for g in range(6) for p in range(40)}
    seats = {g: (0, 3, 39, 100, 777, 5_000)[g] for g in range(6)}
    frame = spark.createDataFrame([(g, p, v, seats[g]) for (g, p), v in votes.items()], "g int, party int, votes double, s long")
    from pyspark.sql import functions as F

    won = {(r["g"], r["party"]): r["_seats"] for r in mixing.sainte_lague(frame, ["g"], "party", "votes", F.col("s")).collect()}
    for g, n in seats.items():
        mine = dict.fromkeys(range(40), 0)
        for _ in range(n):
            mine[max(mine, key=lambda p: (votes[g, p] / (2 * mine[p] + 1), -p))] += 1
        assert {p: won[g, p] for p in mine} == mine


def test_bins_follow_the_table(spark):
    """More shards than bins of a small table: no shard grows above its size."""
    docs = spark.range(2_000).selectExpr("id as doc_id", "repeat('w ', 40) as text", "'one' as source")
    rows = mixing.mix(docs, shard_words=100, block_words=8).collect()
    assert sum(r["taken"] for r in rows) == 80_000 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_repeated_documents(spark):
    docs = edges.frame(spark)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    taken = {(r["doc_id"], r["text"]): (r["taken"], r["size"]) for r in mixing.mix(docs).collect() if r["size"]}
    counts = defaultdict(int)
    for row in out.collect():
        counts[row["doc_id"], row["text"]] += 1
        assert row["size"] == "0" and row["text"].split()
    single = [k for k in taken if k[0] != 3]
    assert all(counts[k] == int(taken[k][0] / taken[k][1] + 0.5) for k in single)


def test_empty_table(spark):
    assert mixing.mix(edges.empty(spark)).count() == 0
    assert mixing.repeated(edges.empty(spark)).count() == 0
