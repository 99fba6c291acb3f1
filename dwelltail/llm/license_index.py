"""License scans with a positional index of rare tokens.

The templates' words are weighed by their inverse document frequency over the whole table. An alignment counts only if the
template's key phrases stand in it word by word, so every place of a key phrase's rarest word proposes one (place in the file minus place in the
template) and none is missed; an alignment's score is the share of the template's word weight that stands where the template has it. Everything is column expressions on one row, so no file is joined, split or shuffled. Only the counts
of the templates' words reach the driver: their number is fixed.

Words are the runs of ASCII letters and digits and of non-ASCII characters, ASCII letters in lower case. Defined results: a
NULL or empty text has no words, no places and score 0; equal rows give equal rows; of alignments with equal score the
first counts; an empty table gives no rows; columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import without

# Phrases of the base scan, and the templates (label, key phrases, text) of common licence notices.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = (
    ("gpl-3.0", ("gnu general public license version 3",), "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", ("gnu general public license version 2",), "this work is licensed under the gnu general public license version 2"),
    ("lgpl", ("gnu lesser general public license",), "under the terms of the gnu lesser general public license"),
    ("agpl", ("gnu affero general public license",), "under the terms of the gnu affero general public license"),
    ("apache-2.0", ("apache license version 2 0",), "licensed under the apache license version 2 0"),
    ("mit", ("mit license",), "released under the mit license"),
    ("mit-grant", ("permission is hereby granted free of charge",),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", ("cc by sa 4 0",), "licensed under cc by sa 4 0"),
    ("cc-by-4.0", ("cc by 4 0",), "licensed under cc by 4 0"),
    ("bsd", ("redistribution and use in source and binary forms",),
     "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", ("permission to use copy modify and or distribute this software",),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", ("free and unencumbered software",), "this is free and unencumbered software released into the public domain"),
)
#: Every base phrase and key phrase has one of these; a text with none of them has no place and no label.
GATE_WORDS = ("license", "cc", "permission", "redistribution", "unencumbered")

#: Share of the template's word weight that must stand in place.
LEAST_SCORE = 0.4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def lexicon() -> list[str]:
    phrases = [*BASE_PHRASES, *(text for _, _, text in TEMPLATES)]
    return sorted({word for phrase in phrases for word in phrase.split()})


def word_weights(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of the lexicon's words, over all rows."""
    words = lexicon()
    found = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(rf"(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})"), F.lit(0))
    each = docs.select(F.explode_outer(F.array_union(F.array_distinct(found), F.array(F.lit("")))).alias("word"))
    counts = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n for word, n in counts.items() if not word)
    return {word: math.log((1 + total) / (1 + counts.get(word, 0))) + 1e-3 for word in words}


def stands(words: Column, place: Column, phrase: list[str]) -> Column:
    """True where the phrase's words stand at ``place`` (from 0) of the word array."""
    return _all([F.get(words, place + i) == F.lit(word) for i, word in enumerate(phrase)])


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return F.coalesce(result, F.lit(False))


def starts_of(words: Column, spots: Column, phrase: str) -> Column:
    """Places where the phrase stands, from the lexicon words' ``spots`` (place, word)."""
    parts = phrase.split()
    return F.transform(
        F.filter(spots, lambda s: (s["word"] == parts[0]) & stands(words, s["place"], parts)), lambda s: s["place"]
    )


def alignment(words: Column, spots: Column, text: str, keys: tuple[str, ...], weights: dict[str, float]) -> Column:
    """Best score of a template over all alignments in which its key phrases stand; 0 without one."""
    parts = text.split()
    whole = sum(weights[word] for word in parts)
    key_places = []
    for key in keys:
        size = len(key.split())
        key_places.append((next(i for i in range(len(parts)) if parts[i : i + size] == key.split()), key.split()))
    # the rarest of the words that every alignment has: its place in the template
    rarest = max((at + i for at, phrase in key_places for i in range(len(phrase))), key=lambda i: (weights[parts[i]], -i))
    offsets = F.transform(F.filter(spots, lambda s: s["word"] == parts[rarest]), lambda s: s["place"] - rarest)

    def score(offset: Column) -> Column:
        weight = F.lit(0.0)
        for i, word in enumerate(parts):
            there = F.when(offset + i >= 0, F.get(words, offset + i)) == word
            weight = weight + F.when(there, F.lit(weights[word])).otherwise(F.lit(0.0))
        verified = _all([stands(words, offset + at, phrase) & (offset + at >= 0) for at, phrase in key_places])
        return F.when(verified, F.least(weight / whole, F.lit(1.0))).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(offsets, score)), F.lit(0.0))


def scan(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` with word count, base places and labels, all labels, and the best template's score."""
    kept = without(docs, ADDED)
    gated = F.col(text).rlike("(?i)" + "|".join(GATE_WORDS))
    lowered = F.translate(F.col(text), _UPPER, _LOWER)
    words = F.when(gated, F.regexp_extract_all(lowered, F.lit(f"{_WORD}+"), F.lit(0)))
    counted = docs.select(
        *kept, F.coalesce(F.regexp_count(F.col(text), F.lit(f"{_ANY_CASE}+")), F.lit(0)).cast("long").alias("n_words"), words.alias("_words")
    )
    known = lexicon()
    spots = F.filter(
        F.transform(F.col("_words"), lambda w, i: F.when(w.isin(known), F.struct(i.alias("place"), w.alias("word")))), lambda s: s.isNotNull()
    )
    placed = counted.withColumn("_spots", spots)
    w, s = F.col("_words"), F.col("_spots")
    found = placed.withColumns({f"_b{i}": starts_of(w, s, phrase) for i, phrase in enumerate(BASE_PHRASES)})
    found = found.withColumns({f"_t{i}": alignment(w, s, t, keys, weights) for i, (_, keys, t) in enumerate(TEMPLATES)})
    nothing = F.array().cast("array<int>")
    places = F.coalesce(F.concat(*[F.col(f"_b{i}") for i in range(len(BASE_PHRASES))]), nothing)
    base = F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, label in enumerate(BASE_PHRASES.values())])
    own = F.array(*[F.when(F.col(f"_t{i}") >= LEAST_SCORE, F.lit(label)) for i, (label, _, _) in enumerate(TEMPLATES)])

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))), ",")

    return found.withColumn("_places", places).select(
        *kept, "n_words", F.size("_places").cast("long").alias("n_base"), F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.greatest(*[F.col(f"_t{i}") for i in range(len(TEMPLATES))]), F.lit(0.0)).alias("score"),
    )
