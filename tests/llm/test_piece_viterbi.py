import random

import edges
import pytest

from dwelltail.llm import piece_viterbi, queries


@pytest.fixture(scope="module")
def pieces():
    return piece_viterbi.load_pieces(queries.PIECE_MODEL, ranked=True)


def best(word, pieces):
    """Highest sum of scores over all segmentations, by trying every last piece."""
    scores = {t.replace(piece_viterbi.MARK, " "): s for i, (t, s) in enumerate(zip(pieces.texts, pieces.scores)) if i not in pieces.control and i not in pieces.byte_ids}
    spelled = min(pieces.scores) - piece_viterbi.BYTE_PENALTY
    sums = [0.0]
    for end in range(1, len(word) + 1):
        options = [sums[s] + scores[word[s:end]] for s in range(end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            options.append(sums[end - 1] + spelled)
        sums.append(max(options))
    return sums[-1]


def total(ids, word, pieces):
    spelled = min(pieces.scores) - piece_viterbi.BYTE_PENALTY
    sums, run = 0.0, bytearray()
    for number in ids:
        if number in pieces.byte_ids:
            run.append(pieces.byte_ids.index(number))
            try:
                run.decode()
            except UnicodeDecodeError:
                continue
            sums, run = sums + spelled, bytearray()
        else:
            sums += pieces.scores[number]
    return sums


def test_sorted_words_reach_the_best_sum(pieces):
    draw = random.Random(3)
    alphabet = "abcdefthe on éß漢😀▁"
    words = sorted({" " + "".join(draw.choice(alphabet.replace(" ", "")) for _ in range(draw.randint(1, 12))) for _ in range(300)} | {"   ", "\n\n", " the", " them", " theme"})
    search = piece_viterbi.SharedPrefixViterbi(pieces)
    shared = {w: search.segment(w) for w in words}
    for word in words:
        assert shared[word] == piece_viterbi.SharedPrefixViterbi(pieces).segment(word)
        assert total(shared[word], word, pieces) == pytest.approx(best(word, pieces))


def test_round_trip_of_edge_rows(spark, pieces):
    docs = edges.frame(spark)
    coded = piece_viterbi.encode(docs, pieces)
    assert coded.columns.count("ids") == 1
    rows = piece_viterbi.decode(coded, pieces).collect()
    assert len(rows) == len(edges.rows())
    for row in rows:
        assert row["decoded"] == (row["text"] or "") and row["n_tokens"] == len(row["ids"]) and bool(row["ids"]) == bool(row["text"])


def test_table_round_trip_and_library_decoding(spark, medium, pieces):
    from sentencepiece import SentencePieceProcessor

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = queries.op9_piece_viterbi(spark, medium).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    library = SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    assert all(library.decode(list(r["ids"])) == texts[r["doc_id"]] for r in rows[:100])


def test_cache_starts_afresh(spark, pieces, monkeypatch):
    docs = edges.frame(spark).filter("doc_id is not null")
    whole = {(r["doc_id"], r["text"]): r["ids"] for r in piece_viterbi.encode(docs, pieces).collect()}
    monkeypatch.setattr(piece_viterbi, "REMEMBERED", 20)
    assert {(r["doc_id"], r["text"]): r["ids"] for r in piece_viterbi.encode(docs, pieces).collect()} == whole


def test_empty_table(spark, pieces):
    coded = piece_viterbi.encode(edges.empty(spark), pieces, verify=True)
    assert coded.count() == 0 and piece_viterbi.decode(coded, pieces).count() == 0
