import zlib

import edges
import numpy as np
from pyspark.sql import functions as F

from dwelltail.llm import langid, queries


def test_accuracy_on_the_held_out_fifth(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang")
    found = queries.op10_langid(spark, medium).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    for row in found:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held) > 100


def test_counts_match_a_loop():
    texts = ["Ab, é1", None, "", "x" * 5, "!!", "a  b"]
    document, feature, count, has_letter = langid.gram_counts(texts)
    assert has_letter.tolist() == [True, False, False, True, False, True]
    totals = np.bincount(document, weights=count, minlength=len(texts))
    for i, text in enumerate(texts):
        symbols = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        while "  " in symbols:
            symbols = symbols.replace("  ", " ")
        assert totals[i] == sum(max(0, len(symbols) - n + 1) for n in langid.SIZES)
    alone = [langid.gram_counts([t]) for t in texts]
    assert np.concatenate([a[1] for a in alone]).tolist() == feature.tolist()


def test_elastic_net_leaves_unseen_features_at_zero():
    weights = langid.fit_ftrl(np.array([0, 1, 2]), np.array([3, 5]), np.ones(2), np.array([0, 1]), 2)
    assert set(np.flatnonzero(weights.any(1))) <= {3, 5, langid.BUCKETS}
    assert weights[3, 0] > 0 > weights[3, 1]


def test_temperature_calibrates():
    draw = np.random.default_rng(1)
    logits = draw.normal(size=(4_000, 3))
    label = (logits.cumsum(1) > -1e9).argmax(1)
    chance = langid.softmax(logits)
    label = np.array([draw.choice(3, p=p) for p in chance])
    assert abs(langid.fit_temperature(4 * logits, label) - 4) < 0.6


def test_edge_rows(spark):
    docs = edges.frame(spark)
    model = langid.train(docs)
    out = langid.predict(docs, model)
    assert out.columns.count("score") == 1 and out.columns[-2:] == ["lang_pred", "score"]
    for row in out.collect():
        has_letter = any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] in ("de", "en")) == has_letter and (row["lang_pred"] == "und") == (not has_letter)
        assert has_letter or row["score"] == 0


def test_nothing_to_learn_from(spark):
    docs = edges.frame(spark)
    assert langid.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.train(edges.empty(spark)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    single = langid.train(docs.filter("lang = 'en'"))
    assert langid.predict(edges.empty(spark), single).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, single).collect()} == {"en", "und"}
