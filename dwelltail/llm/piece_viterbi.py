"""SentencePiece encoding and decoding by a Viterbi search that distinct words share along common prefixes.

Texts are cut into marked words (the spaces before a word belong to it). The distinct words of a block are sorted, which
lays them out as a trie in depth-first order; going from one word to the next, the forward scores, the back
pointers and the open vocabulary paths of the common prefix stay, and only the rest is searched. Words seen
lately by the task are looked up.

The best segmentation is the one with the highest sum of piece scores; of equal sums the one whose last piece
starts first. A unigram model brings log probabilities; the scores of a merge model are only ranks, which
``load_pieces`` turns into log probabilities by Zipf's law. A character that is no piece becomes its UTF-8 bytes' pieces at a penalty below every score, so every text
decodes to itself. For a merge model the ids can differ from those of its own merge order; the pieces and the
decoding are the same.

Defined results: NULL and empty texts have no ids and decode to the empty text; an empty table gives no rows;
columns named ``ids`` or ``n_tokens`` are replaced; equal texts get equal ids. A literal U+2581 is encoded by bytes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import text_blocks, without

MARK = "▁"
#: Words whose segmentation a task remembers in a generation. A full one is kept beside the next, and a word met again moves on to it.
REMEMBERED = 100_000
#: Score below the worst piece for a character that is spelled in bytes.
BYTE_PENALTY = 10.0
_BLOCK = 1 << 20
_WORD = re.compile(r" *[^ \n]+| +|\n+")


@dataclass
class Pieces:
    """A vocabulary: text, score and kind of every id."""

    texts: list[str]
    scores: list[float]
    #: Piece id of each byte value; empty if the model has no byte pieces.
    byte_ids: list[int]
    unknown: int
    #: Ids that never stand for text.
    control: frozenset[int] = field(default_factory=frozenset)


def load_pieces(model_file: str, ranked: bool = False) -> Pieces:
    """Read a model file on the driver; the vocabulary has a fixed size and goes along with the tasks.

    ``ranked`` says that the scores are ranks of merges: the k-th best gets the score -log(k + 1).
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    by_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
    scores = [model.get_score(i) for i in ids]
    if ranked:
        for place, number in enumerate(sorted(ids, key=lambda i: (-scores[i], i)), 1):
            scores[number] = -math.log(place + 1)
    return Pieces(
        [model.id_to_piece(i) for i in ids], scores,
        [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], model.unk_id(),
        frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)),
    )


class SharedPrefixViterbi:
    """Segments sorted words; everything up to the common prefix with the word before is kept."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.root: dict = {}
        skipped = pieces.control | set(pieces.byte_ids)
        for number, text in enumerate(pieces.texts):
            if number not in skipped and text:
                node = self.root
                for character in text.replace(MARK, " "):
                    node = node.setdefault(character, {})
                node[""] = number, pieces.scores[number]
        self.spelled = min(pieces.scores) - BYTE_PENALTY
        self.word = ""
        #: Per position: score, where the last piece starts, its id (-1: bytes), open vocabulary paths.
        self.score, self.start, self.piece, self.open = [0.0], [0], [0], [[]]

    def segment(self, word: str) -> tuple[int, ...]:
        shared, limit, before = 0, min(len(word), len(self.word)), self.word
        while shared < limit and word[shared] == before[shared]:
            shared += 1
        score, start, piece, paths = self.score, self.start, self.piece, self.open
        del score[shared + 1 :], start[shared + 1 :], piece[shared + 1 :], paths[shared + 1 :]
        root = self.root
        for place in range(shared, len(word)):
            character = word[place]
            best, best_start, best_piece = -1e300, -1, -1
            follow = []
            for node, begin in paths[place]:
                node = node.get(character)
                if node is not None:
                    follow.append((node, begin))
                    found = node.get("")
                    if found is not None and score[begin] + found[1] > best:
                        best, best_start, best_piece = score[begin] + found[1], begin, found[0]
            node = root.get(character)
            alone = None
            if node is not None:
                follow.append((node, place))
                alone = node.get("")
            if alone is None:
                alone = -1, self.spelled
            if score[place] + alone[1] > best:
                best, best_start, best_piece = score[place] + alone[1], place, alone[0]
            score.append(best)
            start.append(best_start)
            piece.append(best_piece)
            paths.append(follow)
        self.word = word
        ids, end = [], len(word)
        while end:
            begin = start[end]
            ids += self.bytes_of(word[begin:end]) if piece[end] < 0 else (piece[end],)
            end = begin
        return tuple(reversed(ids))

    def bytes_of(self, character: str) -> list[int]:
        """Ids of a character's bytes, last byte first."""
        if not self.pieces.byte_ids:
            return [self.pieces.unknown]
        return [self.pieces.byte_ids[b] for b in reversed(character.encode("utf-8", "surrogatepass"))]


def marked_words(text: str | None) -> list[str]:
    """The text behind one space, cut before every run of spaces and around line ends; nothing of an empty text."""
    return _WORD.findall(f" {text}") if text else []


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and their number ``n_tokens``; with ``verify`` also ``round_trip``, whether the ids spell the text."""
    added = ("ids", "n_tokens", "round_trip") if verify else ("ids", "n_tokens")
    kept = without(docs, added)
    rows = docs.select(*kept, F.col(text).alias("_text"))

    def encoded(batches):
        search, table = SharedPrefixViterbi(pieces), decode_table(pieces)
        known, older = {}, {}
        for block in text_blocks(batches, "_text", _BLOCK):
            texts = block.column("_text").to_pylist()
            words = [marked_words(t) for t in texts]
            fresh = set(chain.from_iterable(words)).difference(known)
            for word in sorted(fresh.difference(older)):
                known[word] = np.array(search.segment(word), np.int32).tobytes()
            for word in fresh.intersection(older):
                known[word] = older[word]
            found = list(map(known.__getitem__, chain.from_iterable(words)))
            lengths = np.zeros(len(found) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=lengths[1:])
            ends = np.cumsum([0, *map(len, words)])
            ids = np.frombuffer(b"".join(found), np.int32)
            offsets = lengths[ends].astype(np.int32)
            if len(known) > REMEMBERED:
                known, older = {}, known
            columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(np.diff(offsets).astype(np.int64))]
            if verify:
                columns.append(pa.array([(t or "") == spelled for t, spelled in zip(texts, spellings(ids, offsets, table))]))
            yield pa.RecordBatch.from_arrays([block.column(c) for c in kept] + columns, names=[*kept, *added])

    types = {"ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("long"), "round_trip": F.lit(True)}
    return rows.mapInArrow(encoded, docs.select(*kept, *[types[c].alias(c) for c in added]).schema)


def spellings(ids: np.ndarray, offsets: np.ndarray, table: list[bytes]):
    """The texts that the stretches of ids spell, without the space put before the first word."""
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield b"".join(map(table.__getitem__, ids[start:end].tolist())).decode("utf-8", "replace")[1:]


def decode_table(pieces: Pieces) -> list[bytes]:
    table = [b"" if i in pieces.control else t.replace(MARK, " ").encode() for i, t in enumerate(pieces.texts)]
    for value, number in enumerate(pieces.byte_ids):
        table[number] = bytes([value])
    return table


def decode(coded: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the text that its ids spell; NULL ids spell the empty text."""
    kept = without(coded, (into,))
    rows = coded.select(*kept)

    def decoded(batches):
        table = decode_table(pieces)
        for batch in batches:
            column = batch.column(ids)
            numbers, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = list(spellings(numbers, offsets, table))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, into])

    return rows.mapInArrow(decoded, coded.select(*kept, F.lit("").alias(into)).schema)
