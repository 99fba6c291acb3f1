import re
import time

import edges
import pytest
from pyspark.sql import functions as F

from dwelltail.llm import queries, secret_forest

PLANTED = re.compile(r"AKIA[0-9A-Z]{16}|token = \"[0-9a-f]{40}\"|password=[0-9a-f]{18}")


@pytest.fixture(scope="module")
def forest(spark, medium):
    return secret_forest.learn(spark.read.parquet(f"{medium}/documents.parquet"))


def test_planted_secrets_are_found_and_nothing_else(spark, medium):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    found = queries.op4_secret_forest(spark, medium).filter("is_secret").collect()
    planted = {(d, i) for d, t in texts.items() for i, w in enumerate(re.split(r"\s+", t)) if PLANTED.search(w) or re.search(r'"[0-9a-f]{40}"', w)}
    assert {(r["doc_id"], r["place"]) for r in found} == planted and planted


def test_candidates(spark):
    text = 'key=v  a@b.example.org 4111111111111111 password="hunter2x" api_key=abc ABCDEFGHIJKLMNOPQ token = "abcdef0123456789" (x1y2z3x1y2z3),'
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(secret_forest.candidates(F.col("t"))).alias("c")).select("c.*").collect()
    assert [(r["place"], r["key"], r["value"]) for r in found] == [
        (2, "", "4111111111111111"), (3, "password", "hunter2x"), (5, "", "ABCDEFGHIJKLMNOPQ"), (8, "", "abcdef0123456789"), (9, "", "x1y2z3x1y2z3"),
    ]
    assert found[3]["before"] == "=" and found[3]["before2"] == "token" and found[3]["quoted"]


AWS, GITHUB = "AKIA" + "ABCDEFGH12345678", "ghp_" + "a1B2c3D4e5F6" * 3
CORES = {
    f'"api_key":"{AWS}"': ("api_key", AWS), f'connect("{AWS}")': ("", AWS), f"<token>{GITHUB}</token>": ("token", GITHUB),
    f'{{"a":1,"token":"{GITHUB}"}}': ("token", GITHUB), f"id,{AWS}": ("", AWS), "password=P@ss!w0rd#2024xyz": ("password", "P@ss!w0rd#2024xyz"),
    "password = hunter2x": ("", "hunter2x"), "password: correcthorsebattery": ("", "correcthorsebattery"), '"password" : "P@ss!w0rd",': ("", "P@ss!w0rd"),
    "pwd =hunter2x": ("", "hunter2x"), "--password hunter2x": ("", "hunter2x"), "config.py:12:password=hunter2x": ("password", "hunter2x"),
    f"https://a.example/?x=1&token={GITHUB}&y=2": ("token", GITHUB), f"secret={{token:{GITHUB}}}": ("token", GITHUB),
    f"{{\\\"token\\\":\\\"{GITHUB}\\\"}}": ("token", GITHUB),
}


def test_every_core_of_a_word_is_read(spark):
    rows = spark.createDataFrame([(t,) for t in CORES], "t string")
    out = {r["t"]: r["c"] for r in rows.select("t", secret_forest.candidates(F.col("t")).alias("c")).collect()}
    for text, wanted in CORES.items():
        assert wanted in [(c["key"], c["value"]) for c in out[text]], (text, out[text])
        assert all(c["value"] in text for c in out[text])


def test_long_words_have_all_their_cores(spark):
    texts = [",".join(f'"k{i}":"{AWS}"' for i in range(2_000)), "a1+/" * 50_000, "=" * 100_000, "token" * 20_000 + "=1", '"' * 100_000 + "1", "password=" * 20_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    sizes = {r["t"][:20]: r["n"] for r in rows.select("t", F.size(secret_forest.candidates(F.col("t"))).alias("n")).collect()}
    assert sizes[texts[0][:20]] == 2_000


def test_very_long_words_take_linear_time(spark):
    """Words that hold a secret's name again and again and never assign anything to it."""
    units = ["password", "password.", "a-token_", "secret=secret", "key:", "x=", "auth/", "api_key\"", "-bearer"]
    rows = [(unit * (1_000_000 // len(unit)) + "1", "a") for unit in units]
    docs = spark.createDataFrame(rows, "text string, source string").repartition(len(rows))
    start = time.monotonic()
    assert secret_forest.scan(docs, secret_forest.Forest([], [])).select("findings").count() == len(rows)
    secret_forest.scan(docs, secret_forest.Forest([], [])).selectExpr("sum(size(findings))").collect()
    assert time.monotonic() - start < 120


def test_cores_are_redacted(spark):
    text = f'see {{"a":1,"token":"{GITHUB}"}} and connect("{AWS}"), <token>{GITHUB}</token>'
    docs = spark.createDataFrame([(text, "a")], "text string, source string")
    (row,) = secret_forest.redact(docs, secret_forest.Forest([], [])).collect()
    assert row["text"] == 'see {"a":1,"token":"[SECRET]"} and connect("[SECRET]"), <token>[SECRET]</token>'


def test_expression_is_the_mean_of_the_trees(spark):
    trees = [(0, 12.0, 0.25, (1, 0.5, 0.0, 1.0)), 0.5]
    rows = spark.createDataFrame([("", "abc123456789xyz", False, "", "", ""), ("", "1234567890123456", False, "", "", "")],
                                 "key string, value string, quoted boolean, before string, before2 string, after string")
    score = secret_forest.Forest(trees, ["the"]).score({c: F.col(c) for c in rows.columns}, F.lit(None).cast("string"))
    assert [r[0] for r in rows.select(score).collect()] == [0.75 if 9 / 15 > 0.5 else 0.25, 0.75]


def test_redaction(spark, forest):
    docs = edges.frame(spark)
    out = secret_forest.redact(docs, forest)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    after = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(before)
    changed = [k for k in after if k not in set(before)]
    (key,) = changed
    assert key[0] == 11 and key[1].endswith(' token = "[SECRET]"') and after[key]["n_chars"] == len(key[1])


def test_without_labels_and_empty_tables(spark):
    empty = secret_forest.learn(edges.empty(spark))
    assert empty.trees == []
    assert secret_forest.scan(edges.empty(spark), empty).count() == 0
    scanned = secret_forest.scan(edges.frame(spark), empty)
    assert scanned.columns.count("findings") == 1
    found = [f for r in scanned.collect() for f in r["findings"] or []]
    assert {f["score"] for f in found} <= {0.0, 0.5, 1.0} and any(f["score"] == 1.0 for f in found)


def test_labelled_findings_are_learned(spark, medium):
    """Any labels can be given: here capitals are the secrets."""
    found = secret_forest.findings(spark.read.parquet(f"{medium}/documents.parquet"))
    marked = found.withColumn("label", F.when(F.contains("value", F.lit("@")), 1).otherwise(0))
    forest = secret_forest.train(marked, ["the", "of"])
    scored = marked.withColumn("s", forest.score({n: F.col(n) for n in found.columns}, F.col("path")))
    assert scored.filter("(s >= 0.5) <> (label = 1)").count() == 0
