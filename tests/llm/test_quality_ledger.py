import re
from collections import Counter

import edges

from dwelltail.llm import quality_ledger


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_match_a_plain_count(spark):
    entries = quality_ledger.ledger(edges.frame(spark), ["doc_id", "text", "failed", "_note"])
    assert entries.columns == ["doc_id", "text", "_note", *quality_ledger.MEASURES, "failed"]
    rows = entries.collect()
    assert len(rows) == len(edges.rows())
    for row in rows:
        assert tuple(row[m] for m in quality_ledger.MEASURES[:5]) == brute(row["text"])


def test_line_and_window_edges(spark):
    texts = ["a b c d e f g h a b c d e f g h", "a\na\n\n\na ", "a b c d e f g h\na b c d e f g h i", "\v\fa b"]
    rows = quality_ledger.ledger(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"]).collect()
    for row in rows:
        assert tuple(row[m] for m in quality_ledger.MEASURES[:5]) == brute(row["text"])


def test_bits_follow_the_rules(spark):
    for row in quality_ledger.ledger(edges.frame(spark), ["doc_id"]).collect():
        values = {m: row[m] for m in quality_ledger.MEASURES}
        assert row["failed"] == sum(quality_ledger.BIT[r.name] for r in quality_ledger.RULES if eval(r.fails, {}, values))


def test_ablations_match_a_loop(spark):
    entries = quality_ledger.ledger(edges.frame(spark), ["doc_id"]).cache()
    policy = quality_ledger.POLICIES["v1"]
    bits = [r["failed"] & quality_ledger.mask(policy) for r in entries.collect()]
    for row in quality_ledger.ablations(entries, policy).collect():
        bit = quality_ledger.BIT[row["rule"]]
        assert (row["n_failed"], row["n_only"], row["n_docs"]) == (sum(b & bit > 0 for b in bits), bits.count(bit), len(bits))


def test_empty_table(spark):
    assert quality_ledger.ledger(edges.empty(spark), ["doc_id"]).count() == 0
