"""The corpus pipeline: documents through the operators of ``dwelltail.llm``, each stage on what the one before kept.

1. Language identification rejects texts without a letter and those whose most likely language stays below ``LEAST_SCORE``.
2. Of every class of near-copies one document stays, the one with the smallest id.
3. Secrets inside a text are replaced by a mark; the document stays.
4. The mix takes each document as often as its source's target asks, in whole copies (possibly none).
5. SentencePiece ids of every text.

Every stage handles NULL texts, ids, languages and sources, empty tables and further columns as its operator's docstring says; all but
the last return the columns of ``documents`` they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwelltail.llm import chosen_path, langid, mixing, piece_viterbi, secret_forest
from dwelltail.llm.queries import PIECE_MODEL
from dwelltail.session import shared_dir

#: No SQL: language model, join and token search are not expressible; the tests hold the stages against brute force.
ORACLE_SQL = None

#: Calibrated probability that the most likely language must reach.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows; it learns from those that carry one, the held-out fifth left aside."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    if model is None:  # nothing to learn from: nothing is rejected
        return docs
    named = langid.predict(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")}), model)
    kept = named.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({c: c.removeprefix("_in_") for c in kept.columns if c.startswith("_in_")}).select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_forest.redact(docs, secret_forest.learn(docs))


def weighed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Key, language and source of every document with its ids and their number."""
    pieces = piece_viterbi.load_pieces(PIECE_MODEL, ranked=True)
    coded = piece_viterbi.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), pieces)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES = [
    ("language identification", known_language),
    ("n-gram Jaccard join", distinct_documents),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", weighed_sources),
    ("SentencePiece encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
