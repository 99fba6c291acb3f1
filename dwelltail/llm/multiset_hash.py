"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors modulo powers
of two. Sums do not depend on order, so equal paragraph multisets have equal fingerprints, and a paragraph
is inserted or deleted by adding or subtracting its vector, without the other text.

The vector has two parts: 8 lanes of 64 bits from a cryptographic hash of the whole paragraph
(equality), and 256 lanes of 16 bits that are themselves the sum of one signed unit per five-word
shingle of the paragraph (likeness: inner products of these lanes estimate those of the shingle multisets).

Defined results: NULL and empty texts have no paragraph and the zero vector; lines without a word are no
paragraphs; equal rows get equal fingerprints. ``with_next`` orders by descending id, then by text hash, NULL
ids last; an empty table gives no rows and a single row is its own next.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltail.llm.common import text_blocks

EXACT_LANES = 8
LIKE_LANES = 256
SHINGLE = 5
#: Rows of a run of neighbours, and runs at most.
RUN_ROWS = 1_000
MAX_RUNS = 4_096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xD6E8FEB86659FD93)


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Exact lanes (n, 8) of uint64 and likeness lanes (n, 256) of int16."""
    digests, owners, words, spans = [], [], [], []
    for place, text in enumerate(texts):
        for paragraph in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
            found = paragraph.split()
            if found:
                digests.append(hashlib.blake2b(paragraph, digest_size=8 * EXACT_LANES).digest())
                owners.append(place)
                words += found
                spans.append(len(found))
    exact = np.zeros((len(texts), EXACT_LANES), np.uint64)
    like = np.zeros((len(texts), LIKE_LANES), np.int64)
    if not digests:
        return exact, like.astype(np.int16)
    digest = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, EXACT_LANES)
    owner, span = np.array(owners), np.array(spans)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    exact[owner[first]] = np.add.reduceat(digest, first, axis=0)

    codes, names = pd.factorize(np.array(words, dtype=object))
    word = pd.util.hash_array(names, categorize=False)[codes]
    paragraph_of = np.repeat(np.arange(len(span)), span)
    if len(word) >= SHINGLE:
        rolled = np.zeros(len(word) - SHINGLE + 1, np.uint64)
        for step in range(SHINGLE):
            rolled = rolled * _MULTIPLIER + word[step : step + len(rolled)]
        inside = paragraph_of[: len(rolled)] == paragraph_of[SHINGLE - 1 :]
        rolled, of = rolled[inside], owner[paragraph_of[: len(rolled)][inside]]
    else:
        rolled, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = span < SHINGLE  # such a paragraph is one shingle
    rolled, of = np.concatenate([rolled, digest[short, 0]]), np.concatenate([of, owner[short]])
    rolled = (rolled ^ (rolled >> np.uint64(32))) * _FINAL
    lane = (rolled >> np.uint64(56)).astype(np.int64)
    sign = ((rolled >> np.uint64(55)) & np.uint64(1)).astype(np.float64) * 2 - 1
    sums = np.bincount(of * LIKE_LANES + lane, weights=sign, minlength=len(texts) * LIKE_LANES)
    return exact, sums.astype(np.int64).reshape(len(texts), LIKE_LANES).astype(np.int16)


def encode(exact: np.ndarray, like: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + like.astype("<i2").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT_LANES], "<u8"), np.frombuffer(raw[8 * EXACT_LANES :], "<i2")


def insert(fingerprint: str, paragraph: str) -> str:
    """Fingerprint of the document with one more paragraph."""
    exact, like = decode(fingerprint)
    more, soft = fingerprints([paragraph])
    return encode(exact + more[0], like + soft[0])


def delete(fingerprint: str, paragraph: str) -> str:
    """Fingerprint of the document without that paragraph."""
    exact, like = decode(fingerprint)
    less, soft = fingerprints([paragraph])
    return encode(exact - less[0], like - soft[0])


def likeness(exact_a, like_a, exact_b, like_b) -> np.ndarray:
    """Estimated cosine of the shingle multisets, row by row; 1 for equal fingerprints."""
    a, b = like_a.astype(np.float64), like_b.astype(np.float64)
    norms = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), norms, out=np.zeros(len(a)), where=norms > 0)
    same = (exact_a == exact_b).all(1) & (like_a == like_b).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (_run, _extra, key, text) in which every row is followed by the next one by descending key.

    The keys are cut into runs at approximate quantiles (at most ``MAX_RUNS`` numbers on the driver). A run is
    one sorted stretch of a partition; its last row is followed by a copy (``_extra``) of the next
    run's first row. So the order of the whole table needs one shuffle and no global sort.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    total = rows.agg(F.count(F.lit(1)), F.count(key)).first()
    runs = max(1, min(MAX_RUNS, -(-total[0] // RUN_ROWS)))
    levels = [i / runs for i in range(1, runs)]
    cuts = rows.agg(F.percentile_approx(key, levels, 20 * runs)).first()[0] if levels and total[1] else None
    bounds = np.unique(np.array(cuts if cuts is not None else [], np.int64))

    # Run 0 holds the largest keys; the last run the rows without one.
    @F.pandas_udf("int")
    def run_of(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        place = len(bounds) - np.searchsorted(bounds, keys.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series(np.where(known, place, len(bounds) + 1))

    named = rows.withColumn("_own", run_of(F.col(key))).withColumn("_hash", F.xxhash64(text))
    place = F.struct((-F.col(key)).alias("k"), F.col("_hash").alias("h"))
    heads = {r["_own"]: r["head"] for r in named.groupBy("_own").agg(F.min(place).alias("head")).collect()}
    filled = sorted(heads)
    before = {run: filled[i - 1] for i, run in enumerate(filled)}

    @F.pandas_udf("int")
    def shown_in(own: pd.Series, keys: pd.Series, hashes: pd.Series) -> pd.Series:
        def other(run, k, h):
            head = heads[run]
            same_key = head["k"] is None if pd.isna(k) else head["k"] is not None and head["k"] == -int(k)
            return before[run] if same_key and head["h"] == h else -1

        ahead = own.map({run: head["h"] for run, head in heads.items()}).to_numpy() == hashes.to_numpy()
        result = np.full(len(own), -1)
        for i in np.flatnonzero(ahead):
            result[i] = other(own.iloc[i], keys.iloc[i], hashes.iloc[i])
        return pd.Series(result)

    spot = named.withColumn("_also", shown_in("_own", F.col(key), F.col("_hash")))
    own = F.struct(F.col("_own").alias("run"), F.lit(0).alias("extra"))
    also = F.struct(F.col("_also").alias("run"), F.lit(1).alias("extra"))
    placed = spot.withColumn("_at", F.explode(F.when(F.col("_also") < 0, F.array(own)).otherwise(F.array(own, also))))
    flat = placed.select(F.col("_at.run").alias("_run"), F.col("_at.extra").alias("_extra"), "_hash", key, text)
    return flat.repartition("_run").sortWithinPartitions("_run", "_extra", F.col(key).desc_nulls_last(), "_hash").drop("_hash")


def edited_text(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's."""

    def compared(batches):
        held = None  # (run, extra, key, text, exact, like) of the row before
        for block in text_blocks(batches, text):
            run, extra, keys, texts = (block.column(i).to_pylist() for i in range(4))
            texts = [t or "" for t in texts]
            exact, like = fingerprints(texts)
            if held is not None:
                run, extra, keys, texts = [held[0], *run], [held[1], *extra], [held[2], *keys], [held[3], *texts]
                exact, like = np.vstack([held[4], exact]), np.vstack([held[5], like])
            rows = [i for i in range(len(run) - 1) if not extra[i] and run[i] == run[i + 1]]
            held = run[-1], extra[-1], keys[-1], texts[-1], exact[-1:], like[-1:]
            if not rows:
                continue
            edited = [edited_text(texts[i], texts[i + 1]) for i in rows]
            exact_e, like_e = fingerprints(edited)
            after = [i + 1 for i in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([encode(exact[i], like[i]) for i in rows]), pa.array([encode(x, y) for x, y in zip(exact_e, like_e)]),
                pa.array(likeness(exact[rows], like[rows], exact_e, like_e)),
                pa.array(likeness(exact[rows], like[rows], exact[after], like[after])),
            ], names=RESULT.names)

    return with_next(docs, key, text).mapInArrow(compared, RESULT)
