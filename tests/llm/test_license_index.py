import random
import re

import edges

from dwelltail.llm import license_index, queries


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in license_index.BASE_PHRASES.items():
        size = len(phrase.split())
        here = [i for i in range(len(found) - size + 1) if found[i : i + size] == phrase.split()]
        places += here
        labels |= {label} if here else set()
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def held(rows, texts):
    for row in rows:
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute(texts[row["doc_id"]])
        labels = row["labels"].split(",") if row["labels"] else []
        assert labels == sorted(set(labels)) and set(row["base_labels"].split(",")) - {""} <= set(labels) and 0 <= row["score"] <= 1


def test_base_places_of_the_table(spark, medium):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = queries.op5_license_index(spark, medium).collect()
    assert len(rows) == len(texts)
    held(rows, texts)
    assert {r["labels"] for r in rows} == {"", "mit", "apache,apache-2.0", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0"}


def test_alignments(spark):
    texts = {
        1: "CC-BY 4.0", 2: "licensed under CC BY-SA 4.0", 3: "MIT\nLicense mit_license MIT License", 4: "the GNU General Public License",
        5: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", 6: "a license of the apache",
        7: "gnu General-Public LICENSE, version 3 " * 3, 8: "cc by", 9: "Apache LicenseX",
        10: "permission to use copy modify and or distribute this thing for any purpose with or without fee is hereby granted",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = license_index.scan(docs, license_index.word_weights(docs)).collect()
    held(rows, texts)
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels == {
        1: "cc-by,cc-by-4.0", 2: "cc-by,cc-by-sa-4.0", 3: "mit", 4: "", 5: "mit-grant", 6: "", 7: "gpl,gpl-3.0", 8: "cc-by", 9: "", 10: "",
    }


def test_weights_count_every_document(spark):
    docs = edges.frame(spark)
    texts = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower())) for r in edges.rows()]
    import math

    for word, weight in license_index.word_weights(docs).items():
        assert abs(weight - math.log((1 + len(texts)) / (1 + sum(word in t for t in texts))) - 1e-3) < 1e-9


def test_edge_rows(spark):
    docs = edges.frame(spark)
    rows = license_index.scan(docs, license_index.word_weights(docs))
    assert rows.columns.count("labels") == 1 and rows.count() == len(edges.rows())
    for row in rows.collect():
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute(row["text"])
    assert license_index.scan(edges.empty(spark), license_index.word_weights(edges.empty(spark))).count() == 0


def test_every_phrase_has_a_gate_word():
    for phrase in [*license_index.BASE_PHRASES, *(k for _, keys, _ in license_index.TEMPLATES for k in keys)]:
        assert set(phrase.split()) & set(license_index.GATE_WORDS)
    for _, keys, text in license_index.TEMPLATES:
        assert all(f" {k} " in f" {text} " for k in keys)


def aligned(text, template, keys, weights):
    """Best share of the template's weight in place over every offset of the file."""
    words = [w.translate(str.maketrans(license_index._UPPER, license_index._LOWER)) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    parts, best = template.split(), 0.0
    for offset in range(-len(parts), len(words)):
        there = [0 <= offset + i < len(words) and words[offset + i] == p for i, p in enumerate(parts)]
        starts = [next(i for i in range(len(parts)) if parts[i : i + len(k.split())] == k.split()) for k in keys]
        if all(all(there[s : s + len(k.split())]) for s, k in zip(starts, keys)):
            best = max(best, sum(weights[p] for p, t in zip(parts, there) if t) / sum(weights[p] for p in parts))
    return best


def test_labels_and_scores_equal_every_alignment(spark):
    """Pieces of templates, cut, changed and mixed with each other's rare words."""
    draw = random.Random(6)
    texts = {0: "obtaining associated documentation. Permission is hereby granted, free of charge, to any person"}
    for number in range(1, 160):
        words = []
        for _ in range(draw.randint(1, 4)):
            parts = draw.choice(license_index.TEMPLATES)[2].split()
            start = draw.randint(0, 3)
            words += [w for w in parts[start : draw.randint(start + 1, len(parts))] if draw.random() < 0.97]
            words += [draw.choice(license_index.lexicon()) for _ in range(draw.randint(0, 3))]
        texts[number] = " ".join(w.upper() if draw.random() < 0.2 else w for w in words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = license_index.word_weights(docs)
    rows = {r["doc_id"]: r for r in license_index.scan(docs, weights).collect()}
    assert "mit-grant" in rows[0]["labels"]
    for number, text in texts.items():
        scores = {label: aligned(text, template, keys, weights) for label, keys, template in license_index.TEMPLATES}
        base = rows[number]["base_labels"].split(",") if rows[number]["base_labels"] else []
        want = sorted({*base, *(label for label, s in scores.items() if s >= license_index.LEAST_SCORE)})
        assert rows[number]["labels"] == ",".join(want)
        assert abs(rows[number]["score"] - max(scores.values())) < 1e-9
