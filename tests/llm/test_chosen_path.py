import random
from collections import Counter

import edges
import numpy as np

from dwelltail.llm import chosen_path


def brute(rows):
    sets = []
    for _, text in rows:
        found = (text or "").encode().split()
        sets.append({tuple(found[i : i + 5]) for i in range(len(found) - 4)} or ({tuple(found)} if found else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) > 0:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    smallest = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            smallest[root(i)] = min(number, smallest.get(root(i), number))
    return [(number, smallest.get(root(i)), links[i]) for i, (number, _) in enumerate(rows)]


def near_copies(draw, text, n):
    made = []
    for _ in range(n):
        found = text.split()
        for _ in range(draw.randint(0, 3)):
            found[draw.randrange(len(found))] = f"edit{draw.randrange(10**6)}"
        made.append(" ".join(found))
    return made


def corpus():
    draw = random.Random(4)
    texts = [edges.words(draw.randint(1, 120), i, 3_000) for i in range(60)]
    texts += near_copies(draw, edges.words(150, 500, 3_000), 80) + [texts[0]] * 40 + [None, "", " "]
    shared = edges.words(40, 501, 3_000)
    texts += [f"{edges.words(90, 600 + i, 3_000)} {shared}" for i in range(60)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_classes_and_links(spark):
    rows = corpus()
    assert sorted(map(tuple, chosen_path.join(frame(spark, rows)).collect())) == sorted(brute(rows))


def test_large_buckets_and_blocks(spark, monkeypatch):
    """Small limits: buckets go through the recursion and clusters through several blocks."""
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 2_000)
    rows = corpus()
    assert sorted(map(tuple, chosen_path.join(frame(spark, rows)).collect())) == sorted(brute(rows))


def test_one_of_each(spark):
    rows = corpus()
    kept = chosen_path.one_of_each(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_edge_rows(spark):
    rows = [r[:2] for r in edges.rows()]
    assert sorted(map(tuple, chosen_path.join(edges.frame(spark)).collect()), key=str) == sorted(brute(rows), key=str)
    kept = chosen_path.one_of_each(edges.frame(spark))
    assert kept.columns == edges.frame(spark).columns and Counter(r["doc_id"] for r in kept.collect())[3] == 0
    assert chosen_path.join(edges.empty(spark)).count() == 0
    assert chosen_path.one_of_each(edges.empty(spark)).count() == 0


def test_recall_of_one_run_after_another():
    """Pairs at the threshold meet in a bucket as often as the branching argument says at least."""
    draw = np.random.default_rng(5)
    runs, n = chosen_path.runs_for(), 400
    met = 0
    for _ in range(n):
        union = draw.integers(1, 2**63, 500, dtype=np.uint64)
        hashes = chosen_path.min_hashes([np.sort(union[:450]), np.sort(union[50:])])  # Jaccard 0.8
        seen = []
        for row in range(2):
            paths = set()
            for start in chosen_path.mixed(np.arange(1, runs + 1, dtype=np.uint64)):
                paths |= set(chosen_path.next_paths(np.array([start]), hashes[row : row + 1])[1].tolist())
            seen.append(paths)
        met += bool(seen[0] & seen[1])
    assert met == n


def test_common_counts():
    draw = np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 300, draw.integers(1, 90)).astype(np.uint64)) for _ in range(12)]
    counts = chosen_path.common_counts(sets[:5], sets[5:], width=16)
    assert counts.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]
