"""Documents that every operator must take: NULLs, empty and very long texts, ties, equal rows, clashing columns."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, score string, ids string, findings string, lang_pred string, "
    "failed string, labels string, class_id string, fingerprint string, _note string"
)


def words(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return " ".join("w" + format(draw.randrange(vocabulary), "x") + "aeiou"[draw.randrange(5)] for _ in range(n))


def rows():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (3, " ".join(near), "en", None),
        (4, None, "en", "b"), (5, "", None, "b"), (6, " \t\n ", "de", None), (7, "one two", "de", "c"), (8, "### 123 $$$", "de", "c"),
        (9, words(30_000, 2), "de", "a"), (10, "x" * 200_000, "de", "a"), (None, words(60, 3), "en", "a"), (None, None, None, None),
        (11, words(90, 4) + " token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"", "en", "b"),
        (12, "Released under the MIT License. " + words(40, 5), "en", "c"), (13, "é" * 60 + " ñandú ü\n\n" + base, "de", "c"),
        (14, "same same same same same same same same " * 20, "en", "c"), (15, "l▁l \U0001f600   a\u0000b", "en", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "0", "0", "0", "0", "0", "0", "0", "0", "0", "note") for i, t, lang, s in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
