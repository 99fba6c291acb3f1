"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the n-grams of 1 to 3 symbols are hashed to
``BUCKETS`` features. Document frequencies cover every training document: each task adds up its own
vector and sends at most one row per feature. The weights are fitted on a bounded sample (about
``SAMPLE_PER_LANGUAGE`` documents of each language, the lowest hashes of the key) by the follow-the-regularised-leader
rule with elastic-net penalties, in one task that sends back weights only; a part of the sample that the fit never sees sets the softmax
temperature.

Defined results: a text that is NULL or has no letter gets ``und`` and score 0; so does every text where there is
nothing to learn from (no row with a language, an empty table). Equal scores go to the first
language in code point order. Equal texts get equal results; other columns pass through, and
columns named ``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import text_blocks, without

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SIZES = (1, 2, 3)
#: Labelled documents per language that the fit reads, on average; the only bound in the training.
SAMPLE_PER_LANGUAGE = 1_000
UNKNOWN = "und"
_BLOCK = 1 << 20
#: A document counts as so many bytes at least: the counts of a block are a dense table of documents by features.
_ROW = 4 << 10


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    #: (BUCKETS + 1, languages); the last row is the intercept.
    weights: np.ndarray
    temperature: float


#: Filled at first use in a process: per code point, whether it is a letter.
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of the n-grams of a block, and per document whether it has a letter."""
    lowered = [f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(lowered), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) // 4 for t in lowered])
    letter = _letters()[codes]
    has_letter = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()  # of a run of other symbols the first stays, as a space
    keep[:1] = True
    keep[1:] |= letter[:-1]
    keep[1:] |= owner[1:] != owner[:-1]
    symbol = codes.copy()
    symbol[~letter] = 32
    symbol, owner = symbol[keep], owner[keep]
    first_cell = owner.astype(np.int64) * BUCKETS
    cells = []
    rolled = np.zeros(len(symbol), np.uint32)
    for size in range(1, max(SIZES) + 1):
        rolled = rolled[: len(symbol) - size + 1] * np.uint32(0x01000193) + symbol[size - 1 :]
        if size in SIZES:
            mixed = (rolled + np.uint32(size)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            cell = first_cell[: len(rolled)] + (mixed >> np.uint32(32 - BUCKET_BITS))
            cells.append(cell[owner[: len(rolled)] == owner[size - 1 :]])
    found = np.bincount(np.concatenate(cells), minlength=len(texts) * BUCKETS)
    filled = np.flatnonzero(found)
    return filled >> BUCKET_BITS, filled & (BUCKETS - 1), found[filled], has_letter


def tfidf(document, feature, count, idf, n) -> np.ndarray:
    """Values of the cells: (1 + log count) * idf, every document scaled to length one."""
    value = (1 + np.log(count)) * idf[feature]
    length = np.sqrt(np.bincount(document, weights=value * value, minlength=n))
    return value / np.maximum(length, 1e-12)[document]


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents per feature and documents, over all rows."""

    def counted(batches):
        total, n = np.zeros(BUCKETS + 1, np.int64), 0
        for block in text_blocks(batches, text, _BLOCK, _ROW):
            total[:BUCKETS] += np.bincount(gram_counts(block.column(0).to_pylist())[1], minlength=BUCKETS)
            total[BUCKETS] += block.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["feature", "n"])

    rows = texts.select(text).mapInArrow(counted, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(BUCKETS + 1, np.int64)
    for row in rows:
        totals[row["feature"]] = row["n"]
    return totals[:BUCKETS], int(totals[BUCKETS])


def fit_ftrl(starts, feature, value, label, languages, rows=None, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4, epochs=6, batch=16) -> np.ndarray:
    """Weights by follow-the-regularised-leader; L1 and L2 keep unused features at zero.

    Document d has the cells ``starts[d]`` to ``starts[d + 1]``; ``rows`` are the documents to learn from (all).
    """
    z, n = np.zeros((BUCKETS + 1, languages)), np.zeros((BUCKETS + 1, languages))
    weights = np.zeros((BUCKETS + 1, languages))
    learned = np.arange(len(label)) if rows is None else np.asarray(rows)
    order = np.random.default_rng(10)
    for _ in range(epochs):
        shuffled = learned[order.permutation(len(learned))]
        for at in range(0, len(shuffled), batch):
            chosen = shuffled[at : at + batch]
            spans = [slice(starts[r], starts[r + 1]) for r in chosen]
            features, values = np.concatenate([feature[s] for s in spans]).astype(np.int64), np.concatenate([value[s] for s in spans]).astype(float)
            of = np.repeat(np.arange(len(chosen)), [s.stop - s.start for s in spans])
            touched, where = np.unique(features, return_inverse=True)
            # documents by touched features: both products are small dense ones
            cells = np.zeros((len(chosen), len(touched)))
            cells[of, where] = values
            residual = softmax(cells @ weights[touched] + weights[BUCKETS])
            residual[np.arange(len(chosen)), label[chosen]] -= 1
            gradient = np.vstack([cells.T @ residual, residual.sum(0)])
            touched = np.append(touched, BUCKETS)
            grown = n[touched] + gradient**2
            z[touched] += gradient - (np.sqrt(grown) - np.sqrt(n[touched])) / alpha * weights[touched]
            n[touched] = grown
            pull = np.sign(z[touched]) * np.maximum(np.abs(z[touched]) - l1, 0)
            weights[touched] = -pull / ((beta + np.sqrt(grown)) / alpha + l2)
    return weights


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows the fit has not seen."""
    choices = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in choices]
    return float(choices[int(np.argmin(losses))])


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from the rows with a language and a text; None if there are none."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    frequency, total = document_frequencies(rows, text)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("language sample")), F.lit(1_000_000))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(1e6 * min(1.0, sample / n))).otherwise(share)
    chosen = rows.filter(draw < share).select(draw.alias("draw"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def featured(batches):
        for block in text_blocks(batches, "text", _BLOCK, _ROW):
            document, feature, count, _ = gram_counts(block.column("text").to_pylist())
            ends = np.searchsorted(document, np.arange(block.num_rows + 1))
            cut = list(zip(ends[:-1], ends[1:]))
            yield pa.RecordBatch.from_arrays([
                block.column("draw"), block.column("lang"),
                pa.array([feature[a:b].astype(np.uint16).tobytes() for a, b in cut], pa.binary()),
                pa.array([count[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()),
            ], names=["draw", "lang", "features", "counts"])

    examples = chosen.mapInArrow(featured, "draw long, lang string, features binary, counts binary").repartition(1)
    fitted = examples.mapInArrow(_fit(languages, idf), "weights binary, temperature double").first()
    if fitted is None:
        return None
    weights = np.frombuffer(fitted["weights"], np.float64).reshape(BUCKETS + 1, len(languages))
    return Model(languages, idf, weights, fitted["temperature"])


def _fit(languages: list[str], idf: np.ndarray):
    """The task that fits the bounded sample: six bytes a cell, whole arrays of them only once."""

    def fitted(batches):
        rows = []
        for batch in batches:
            rows += zip(*(column.to_pylist() for column in batch.columns))
        if not rows:
            return
        rows.sort()
        label = np.array([languages.index(r[1]) for r in rows], np.int64)
        starts = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r[2]) // 2 for r in rows], out=starts[1:])
        feature, value = np.empty(starts[-1], np.uint16), np.empty(starts[-1], np.float32)
        for place, (_, _, features, counts) in enumerate(rows):
            own = slice(starts[place], starts[place + 1])
            feature[own] = np.frombuffer(features, np.uint16)
            value[own] = tfidf(np.zeros(own.stop - own.start, np.int64), feature[own], np.frombuffer(counts, np.int32), idf, 1)
            rows[place] = None
        unseen = np.arange(len(label)) % 5 == 4
        weights = fit_ftrl(starts, feature, value, label, len(languages), np.flatnonzero(~unseen) if unseen.any() else None)
        temperature = 1.0
        if unseen.any():
            held = np.flatnonzero(unseen)
            logits = np.array([value[starts[r] : starts[r + 1]].astype(float) @ weights[feature[starts[r] : starts[r + 1]]] for r in held]) + weights[BUCKETS]
            temperature = fit_temperature(logits, label[held])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([temperature])], names=["weights", "temperature"])

    return fitted


def scores(document, feature, value, weights, n) -> np.ndarray:
    columns = [np.bincount(document, weights=value * weights[feature, k], minlength=n) for k in range(weights.shape[1])]
    return np.stack(columns, 1) + weights[BUCKETS]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the calibrated probability of that language."""
    kept = without(docs, ("lang_pred", "score"))
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*kept, F.col(text).alias("_text")) if text not in kept else docs.select(*kept)
    read = text if text in kept else "_text"

    def predicted(batches):
        names = np.array(model.languages, dtype=object)
        for block in text_blocks(batches, read, _BLOCK, _ROW):
            document, feature, count, has_letter = gram_counts(block.column(read).to_pylist())
            value = tfidf(document, feature, count, model.idf, block.num_rows)
            chance = softmax(scores(document, feature, value, model.weights, block.num_rows) / model.temperature)
            best = chance.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [block.column(c) for c in kept]
                + [pa.array(np.where(has_letter, names[best], UNKNOWN), pa.string()), pa.array(np.where(has_letter, chance.max(1), 0.0))],
                names=[*kept, "lang_pred", "score"],
            )

    schema = docs.select(*kept, F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(predicted, schema)


def held_out(key: Column) -> Column:
    """The fifth of the documents that a model never learns from; a missing key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0
