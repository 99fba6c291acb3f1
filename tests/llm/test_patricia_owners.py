import hashlib
import random
from collections import Counter, defaultdict

import edges
import pytest

from dwelltail.llm import patricia_owners as po


def strings(n, seed, alphabet=b"ab", most=12):
    draw = random.Random(seed)
    return [bytes(draw.choice(alphabet) for _ in range(draw.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("alphabet,most", [(b"a", 40), (b"ab", 12), (b"\x00\xffabcdef", 6), (b"ab", 300)])
def test_trie_holds_what_was_inserted(alphabet, most):
    texts = strings(800, 1, alphabet, most)
    trie = po.PatriciaTrie()
    for number, text in enumerate(texts):
        assert trie.insert(text, number)
    want = {t: (i, n) for i, (t, n) in enumerate((t, texts.count(t)) for t in texts)}
    assert {t: (e[0], e[1]) for t, e in trie.strings()} == want
    nodes, waiting = 0, list(trie.root.after.values())
    while waiting:
        node = waiting.pop()
        assert node.label and (node.entry or len(node.after) > 1)  # compressed: no node without need
        nodes += po.NODE_BYTES + len(node.label)
        waiting += node.after.values()
    assert trie.size == nodes


def test_owner_is_the_largest_id_and_counts_its_rows():
    trie = po.PatriciaTrie()
    for owner in (None, 3, 7, 7, 5, None, 7):
        trie.insert(b"x", owner)
    trie.insert(b"", None)
    trie.insert(b"", None)
    assert dict(trie.strings()) == {b"x": [7, 7, 3, 0], b"": [None, 2, 2, 0]}


def test_common_start():
    draw = random.Random(4)
    for _ in range(500):
        shared = bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 200)))
        a, b, at = shared + b"x" * draw.randrange(3), shared + b"y" * draw.randrange(3), draw.randrange(5)
        assert po._common(a, b"?" * at + b, at) == len(shared)


def test_spilled_subtrees_take_their_later_strings():
    texts = strings(400, 2)
    trie, out = po.PatriciaTrie(), Counter()
    for number, text in enumerate(texts):
        if not trie.insert(text, number):
            out[text] += 1
        while trie.size > 4_000:
            before = trie.size
            out.update({t: e[1] for t, e in trie.spill()})
            if trie.size == before:
                break
    kept = {t: e[1] for t, e in trie.strings()}
    assert kept and out and not set(kept) & set(out)  # a string is on one side only, with all its rows
    assert kept | dict(out) == dict(Counter(texts))


def expected(rows):
    groups = defaultdict(list)
    for number, text in rows:
        groups[text or ""].append(number)
    result = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for number in ids:
            result.append((str(number), str(keep), len(ids), number == keep and left > 0, digest))
            left -= number == keep
    return sorted(result)


def got(df, **limits):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in po.dedup(df, **limits).collect())


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edges.rows()]
    assert got(edges.frame(spark)) == expected(rows)
    assert po.dedup(edges.empty(spark)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got(edges.empty(spark)) == []


@pytest.mark.parametrize("limits", [{}, {"trie_bytes": 3_000, "local_bytes": 2_000, "partition_bytes": 20_000}, {"hot": 2}, {"hot": 50, "trie_bytes": 1, "local_bytes": 1}])
def test_equal_to_brute_force_with_a_hot_text_and_spills(spark, limits):
    draw = random.Random(7)
    texts = [edges.words(6, draw.randrange(60), 8) for _ in range(300)] + ["a third of all rows"] * 150 + ["", None] * 5
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 3 + [(None, texts[4]), (None, "only here"), (None, "only here")]
    draw.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **limits) == expected(rows)
