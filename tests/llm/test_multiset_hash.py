import hashlib

import edges
import numpy as np

from dwelltail.llm import multiset_hash as mh


def one(text):
    exact, like = mh.fingerprints([text])
    return mh.encode(exact[0], like[0])


def test_order_does_not_matter_and_editing_is_incremental():
    a, b, c = edges.words(30, 1), edges.words(4, 2), edges.words(50, 3)
    whole = one("\n".join([a, b, c]))
    assert whole == one("\n".join([c, a, b])) != one("\n".join([a, b]))
    assert mh.insert(one(f"{a}\n{c}"), b) == whole
    assert mh.delete(whole, b) == one(f"{c}\n{a}")
    assert mh.delete(one(a), a) == one("") == one(None) == one(" \n\t")
    assert one(f"{a}\n{a}") != one(a)


def test_block_and_single_agree():
    texts = [r[1] for r in edges.rows()]
    exact, like = mh.fingerprints(texts)
    assert [mh.encode(e, s) for e, s in zip(exact, like)] == [one(t) for t in texts]


def test_likeness_follows_shared_shingles():
    a, b = edges.words(2_000, 1, 5_000), edges.words(2_000, 2, 5_000)
    exact, like = mh.fingerprints([a, mh.edited_text(a, b), b, a])
    near = mh.likeness(exact[[0, 0, 0]], like[[0, 0, 0]], exact[1:], like[1:])
    assert abs(near[0] - 0.5) < 0.2 and near[1] < 0.2 and near[2] == 1.0


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    result = []
    for i, row in enumerate(ordered):
        text, following = row[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        result.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), one(text), one(edited)))
    return result


def test_edited_texts_over_runs(spark, monkeypatch):
    monkeypatch.setattr(mh, "RUN_ROWS", 7)
    rows = [(i * 3, edges.words(5 + i % 40, i)) for i in range(200)]
    got = mh.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, (r[:5] for r in got))) == sorted(expected(rows))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_edge_rows(spark):
    docs = edges.frame(spark)
    got = mh.compare_edited(docs).collect()
    assert len(got) == len(edges.rows())
    unique = {r[0] for r in edges.rows() if r[0] is not None and r[0] > 5}  # their next row is the same for any order of ties
    want = {r[0]: r for r in expected([r[:2] for r in edges.rows()]) if r[0] in unique}
    assert {r["doc_id"]: tuple(r[:5]) for r in got if r["doc_id"] in unique} == want
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 3}) == 1


def test_single_row_and_empty_table(spark):
    row = mh.compare_edited(spark.createDataFrame([(1, "abc d")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcab").hexdigest() and row["near_next"] == 1.0
    assert mh.compare_edited(edges.empty(spark)).count() == 0


def test_lanes_wrap_around():
    with np.errstate(over="ignore"):
        fingerprint = one("")
        for _ in range(3):
            fingerprint = mh.insert(fingerprint, "a b c d e f")
        for _ in range(3):
            fingerprint = mh.delete(fingerprint, "a b c d e f")
    assert fingerprint == one("")
