"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
versioned set of rules (a bit mask), so applying another policy, or leaving a rule out, is a bitwise operation
on the ledger and never reads a text again. ``ablations`` adds up documents per distinct bit
pattern first; only those few patterns are compared with the policy's rules.

Defined results: a NULL text has no words and fails the rules that ask for words; an empty text likewise; an empty
table gives an empty ledger; columns named like a measurement are replaced; equal rows give equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import byte_table, joined_bytes, sums_between, text_blocks, without

#: Words of the window whose repetition is measured.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits",
    "n_same_next",
)


@dataclass(frozen=True)
class Rule:
    name: str
    #: True where the document fails, from the measurements.
    fails: str


#: The rule at place i owns bit i. Rules are only ever added at the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("upper_case", "2 * n_upper > n_letters"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("digits", "2 * n_digits > word_chars"),
    Rule("same_word_runs", "4 * n_same_next > n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "upper_case", "word_length", "digits", "same_word_runs"),
}

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_START = np.ones(256, bool)
_START[0x80:0xC0] = False
_SYMBOL = byte_table(SYMBOLS)
_DIGIT = byte_table("0123456789")
_UPPER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | byte_table("abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\r\x0b\x0c"


def repetitions(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: words inside windows of ``WINDOW`` words that its text holds at least twice, and
    words equal to the one before.

    Windows get exact numbers by doubling: numbers of one word, of two, of four, of eight neighbours.
    """
    if not words:
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    document = np.repeat(np.arange(len(counts)), counts)
    numbers, names = pd.factorize(np.array(words, dtype=object))
    numbers = pd.factorize(document * np.int64(len(names)) + numbers)[0].astype(np.int64)
    same = np.bincount(document[1:][numbers[1:] == numbers[:-1]], minlength=len(counts))
    if len(words) < WINDOW:
        return np.zeros(len(counts), np.int64), same
    step = 1
    while step < WINDOW:
        numbers = pd.factorize(numbers[:-step] * np.int64(len(words)) + numbers[step:])[0].astype(np.int64)
        step *= 2
    inside = document[WINDOW - 1 :] == document[: len(numbers)]
    sizes = np.bincount(numbers[inside], minlength=numbers.max() + 1)
    repeats = inside & (sizes[numbers] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(repeats)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return np.bincount(document[np.cumsum(edges[:-1]) > 0], minlength=len(counts)), same


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of a block of texts."""
    data, offsets = joined_bytes(texts)
    raw = data.tobytes()
    words, counts, lines, repeats = [], [], [], []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        one = raw[start:end]
        found = one.split()
        words += found
        counts.append(len(found))
        filled = [line for line in one.split(b"\n") if line.strip(_SPACE)]
        lines.append(len(filled))
        repeats.append(len(filled) - len(set(filled)))
    count = np.array(counts, np.int64)
    covered, same = repetitions(words, count)

    def total(flags: np.ndarray) -> np.ndarray:
        return sums_between(flags[data], offsets)

    return {
        "n_words": count, "word_chars": total(_START & _WORD), "n_symbols": total(_SYMBOL), "n_dup_lines": np.array(repeats, np.int64),
        "n_repeat_words": covered, "n_lines": np.array(lines, np.int64), "n_upper": total(_UPPER),
        "n_letters": total(_LETTER), "n_digits": total(_DIGIT),
        "n_same_next": same,
    }


def ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with the measurements and ``failed``, the bits of the rules that a text fails."""
    kept = [c for c in keep if c in without(docs, (*MEASURES, "failed"))]
    rows = docs.select(*kept, F.col(text).alias("_text"))

    def measured(batches):
        for block in text_blocks(batches, "_text"):
            found = measure(block.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [block.column(c) for c in kept] + [pa.array(found[m]) for m in MEASURES], names=[*kept, *MEASURES]
            )

    schema = docs.select(*kept, *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    bits = sum((F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES), F.lit(0))
    return rows.mapInArrow(measured, schema).withColumn("failed", bits.cast("long"))


def mask(policy: tuple[str, ...]) -> int:
    return sum(BIT[name] for name in policy)


def passes(policy: tuple[str, ...], failed: str = "failed") -> Column:
    """True where no rule of the policy failed."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: tuple[str, ...]) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those kept if it alone were left out.

    One aggregation to the distinct bit patterns (at most 2 ** rules), then bitwise tests on them.
    """
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in policy]))
    each = patterns.select("_bits", "_n", rules.alias("_r"))
    hit = F.col("_bits").bitwiseAND(F.col("_r.bit")) != 0
    return each.groupBy(F.col("_r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("_bits") == F.col("_r.bit"), F.col("_n")).otherwise(0)).alias("n_only"),
        F.sum("_n").alias("n_docs"),
    )
