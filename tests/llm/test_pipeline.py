import corpus_pipeline
import edges
from pyspark.sql import functions as F

from dwelltail.llm import chosen_path, langid, mixing, secret_forest


def test_stages_in_order():
    assert [s.__name__ for _, s in corpus_pipeline.STAGES] == [
        "known_language", "distinct_documents", "without_secrets", "weighed_sources", "encoded",
    ]


def test_run_applies_every_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.run(spark, small)
    rows = out.collect()
    kept = chosen_path.one_of_each(docs)
    clean = secret_forest.redact(kept, secret_forest.learn(kept))
    expected = sorted(r["doc_id"] for r in mixing.repeated(clean).collect())
    assert sorted(r["doc_id"] for r in rows) == expected  # no supplied document is without a language
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_take_edge_rows_and_empty_tables(spark, tmp_path):
    for number, docs in enumerate((edges.frame(spark), edges.empty(spark))):
        columns = docs.columns
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if place < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == columns
            path = str(tmp_path / f"{number}-{place}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (number == 0)


def test_language_stage_rejects_only_what_it_cannot_name(spark):
    docs = edges.frame(spark)
    kept = corpus_pipeline.known_language(spark, docs, "")
    letters = docs.filter(F.coalesce(F.regexp_count("text", F.lit(r"\p{L}")), F.lit(0)) > 0)
    assert kept.count() <= letters.count() and kept.filter(F.col("text").isNull()).count() == 0
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    sure = langid.predict(letters.drop("score", "lang_pred"), model).filter(F.col("score") >= corpus_pipeline.LEAST_SCORE)
    assert kept.count() == sure.count()
