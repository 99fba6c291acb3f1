"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwelltail.llm import (
    chosen_path,
    langid,
    license_index,
    lyndon_suffix,
    mixing,
    multiset_hash,
    page_template,
    patricia_owners,
    piece_viterbi,
    quality_ledger,
    secret_forest,
    spectrum_whitening,
    zone_clustering,
)
from dwelltail.llm.common import table
from dwelltail.llm.oracles import ORACLES  # noqa: F401

#: Vocabulary of the encoding query; another file can be named in the environment.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_ledger.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    base_ok = quality_ledger.passes(quality_ledger.POLICIES["base"])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base_ok).alias("base_failed"),
        (base_ok & quality_ledger.passes(quality_ledger.POLICIES["v1"])).alias("kept"), "failed",
    )


@query
def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_edited(table(spark, sf_dir, "documents"))


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    named = langid.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    pieces = piece_viterbi.load_pieces(PIECE_MODEL, ranked=True)
    coded = piece_viterbi.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, verify=True)
    return coded.select("doc_id", "n_tokens", "ids", "round_trip")


@query
def op1_page_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_template.extract(pages)


@query
def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_index.scan(docs, license_index.word_weights(docs)).drop("text")


@query
def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its place, kind, hash and score, and whether it is a secret."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_forest.scan(docs, secret_forest.learn(docs)).select("doc_id", F.explode("findings").alias("f"))
    return found.select(
        "doc_id", "f.place", "f.kind", F.sha2("f.value", 256).alias("value_sha256"), F.round("f.score", 6).alias("score"),
        (F.col("f.score") >= secret_forest.THRESHOLD).alias("is_secret"),
    )


@query
def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"))


@query
def op6_lyndon_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_suffix.dedup(table(spark, sf_dir, "documents"))


@query
def op11_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia_owners.dedup(table(spark, sf_dir, "documents"))


@query
def op12_zone_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clustering.cluster(table(spark, sf_dir, "embeddings"))


@query
def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum_whitening.whiten(table(spark, sf_dir, "embeddings"))
