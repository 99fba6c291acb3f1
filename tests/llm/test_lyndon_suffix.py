import hashlib
import random

import edges
import numpy as np

from dwelltail.llm import lyndon_suffix


def brute(rows):
    first = {}
    for number, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            string = data[i : i + 50]
            if number is not None and first.get(string, number + 1) > number:
                first[string] = number
    result = []
    for number, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            least = first.get(data[i : i + 50])
            if least is not None and (number is None or least < number):
                gone[i : i + 50] = b"\1" * 50
        runs = sum(gone[i] > (gone[i - 1] if i else 0) for i in range(len(gone)))
        left = bytes(b for b, g in zip(data, gone) if not g)
        result.append((number, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(result, key=str)


def got(docs):
    return sorted(map(tuple, lyndon_suffix.dedup(docs).collect()), key=str)


def test_suffix_order():
    draw = random.Random(1)
    cases = [[draw.randint(1, draw.randint(1, 5)) for _ in range(draw.randint(0, 60))] for _ in range(800)]
    cases += [[1] * 70, [1, 2] * 40, [2, 1] * 40, [3, 1, 2] * 30, list(range(1, 90)), list(range(90, 0, -1))]
    for case in cases:
        text = [*case, 0]
        assert lyndon_suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def test_shared_stretches_of_every_length(spark, monkeypatch):
    """Two letters only, so that chance matches abound; small blocks, buckets and arrays."""
    monkeypatch.setattr(lyndon_suffix, "_BLOCK", 3_000)
    monkeypatch.setattr(lyndon_suffix, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(lyndon_suffix, "ARRAY_LETTERS", 300)
    draw = random.Random(2)
    base = "".join(draw.choice("ab") for _ in range(700))

    def noise():
        return "".join(draw.choice("abé") for _ in range(draw.randint(0, 70)))

    rows = []
    for number in range(150):
        parts = [noise()]
        for _ in range(draw.randint(0, 3)):
            start, size = draw.randint(0, 600), draw.choice([20, 48, 49, 50, 51, 70, 100])
            parts += [base[start : start + size], noise()]
        rows.append((number, "".join(parts)))
    rows += [(200 + i, "ab" * 90) for i in range(3)] + [(300, None), (301, "")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)


def test_edge_rows(spark):
    rows = [r[:2] for r in edges.rows()]
    assert got(edges.frame(spark)) == brute(rows)
    assert got(edges.empty(spark)) == []


def test_pieces_cover_every_string():
    text = np.frombuffer(edges.words(400, 9).encode() + b"z" * 300, np.uint8)
    offsets = np.array([0, 30, 1_000, len(text)])
    document, first, last, place = lyndon_suffix.minimised(text, offsets, lyndon_suffix.Rolling(text))
    strings = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert strings == [s for a, b in zip(offsets[:-1], offsets[1:]) for s in range(a, b - 49)]
    assert ((place >= last) | (place >= first)).all() and (place + 16 <= first + 50).all() and (place >= last).all()
