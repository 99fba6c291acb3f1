"""Removal of repeated byte passages with suffix arrays built by linear grouping.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id. The strings are
never listed. Each one contains a minimiser, the 16-byte string in it with the least hash, so equal strings agree on it and
on everything around it:

1. Tasks cut their texts into pieces, runs of neighbouring strings with one minimiser, and deal the pieces' hashes by
   minimiser. Pieces that a block holds twice are settled in the block, so a passage of very many documents arrives once per block.
2. Equal pieces: all but the smallest document's are repeated. What is left are different pieces around one minimiser.
3. Their surroundings are sorted by suffix arrays. The 33 bytes that such a pair must share (the minimiser with the
   17 bytes before or after it) become one letter, so a string of 50 bytes is 18 letters. Neighbours in the suffix order
   with 18 equal letters are the same string, and the smallest document among them is compared with each.

The suffix array is built in two sweeps without renaming. The first splits the suffixes, from the greatest group to the least,
by how many members of the group point at them as their previous smaller one; it ends with groups of equal Lyndon prefixes.
The second walks the order and puts every suffix whose next smaller one it meets into the next free place of its group.

Pieces are compared by 96 bits of hashes, surroundings by a 64-bit hash and their bytes. Defined results: NULL and empty texts have
0 bytes; texts below ``LENGTH`` bytes keep all; a NULL id counts as greater than all others; equal ids do not cover each other;
equal rows get equal results; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import joined_bytes, text_blocks
from dwelltail.session import cut

LENGTH = 50
CORE = 16
#: Bytes beside the minimiser that a pair shares on one side at least: half of what a string has besides it.
SIDE = (LENGTH - CORE) // 2
#: Letters of a string once the shared part is one letter.
LETTERS = LENGTH - CORE - SIDE + 1
#: Bytes of text whose pieces one task sorts, on average.
BUCKET_BYTES = 12 << 20
#: Letters of a suffix array at least; one group of surroundings is never cut. Short arrays stay in the processor's cache.
ARRAY_LETTERS = 3_000
_BLOCK = 1 << 20

_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
_LOW48 = np.uint64((1 << 48) - 1)
_LAST = np.int64(2**63 - 1)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a block from one running sum of byte times inverse power."""

    def __init__(self, data: np.ndarray):
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(data) - 1), _INVERSE)]))[: len(data)]
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _POWER)]))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse, out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.power[start]) + (end - start).astype(np.uint64)


def minimised(data: np.ndarray, offsets: np.ndarray, rolling: Rolling):
    """(document, first start, last start, minimiser place) of the pieces of a block."""
    n, width = len(data), LENGTH - CORE + 1
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(document[: max(0, n - LENGTH + 1)] == document[LENGTH - 1 :]) if n >= LENGTH else np.zeros(0, np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    places = np.arange(n - CORE + 1)
    # a block longer than 16 MB is a single text; places then repeat every 16 MB, farther apart than any window
    least = (rolling.between(places, places + CORE) & ~_PLACE) | (places.astype(np.uint64) & _PLACE)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    low = (least[starts] & _PLACE).astype(np.int64)
    place = starts + ((low - starts) & np.int64(_PLACE))
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[first[1:] - 1, len(starts) - 1]
    return document[starts[first]], starts[first], starts[last], place[first]


def side_byte(rolling: Rolling, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One byte of the hash of a surrounding; 0 where it leaves the text."""
    inside = (start >= low) & (end <= high)
    value = rolling.between(np.where(inside, start, 0), np.where(inside, end, 0)) >> np.uint64(56)
    return np.where(inside, np.maximum(value, np.uint64(1)), np.uint64(0)).astype(np.uint8)


def low6(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from6(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: high bytes are mostly zeros and compress as a run."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


PACKED = "bucket int, owners binary, keys binary, counts binary, minimisers binary, pieces binary, starts binary, small binary"


def _packed(buckets: int):
    def pack(batches):
        for block in text_blocks(batches, "_text", _BLOCK):
            data, offsets = joined_bytes(block.column("_text"))
            rolling = Rolling(data)
            document, first, last, place = minimised(data, offsets, rolling)
            if not len(document):
                continue
            ids = block.column("_order").to_numpy()
            keys = block.column("_key").to_numpy()
            low, high = offsets[document], offsets[document + 1]
            minimiser = rolling.between(place, place + CORE)
            piece = mixed(rolling.between(first, last + LENGTH) + (place - first).astype(np.uint64) * _POWER)
            # a minimiser is the least of many hashes: mixed again, or the first buckets would hold nearly all
            bucket = ((mixed(minimiser * _POWER) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            start = (first - low).astype(np.uint32)
            small = np.stack([
                (last - first).astype(np.uint8), (place - first).astype(np.uint8),
                side_byte(rolling, place - SIDE, place + CORE, low, high), side_byte(rolling, place, place + CORE + SIDE, low, high),
            ], 1)
            # settled here: pieces that a smaller document of the block has as well
            order = np.lexsort((ids[document], piece, minimiser))
            run = np.cumsum(np.r_[True, (piece[order][1:] != piece[order][:-1]) | (minimiser[order][1:] != minimiser[order][:-1])]) - 1
            least = np.minimum.reduceat(ids[document][order], np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
            settled = np.zeros(len(document), bool)
            settled[order] = ids[document][order] > least[run]
            bucket[settled] = -1
            dealt = np.argsort(bucket, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(bucket[dealt])) + 1, len(dealt)]
            columns = [[] for _ in range(8)]
            for a, b in zip(edges[:-1], edges[1:]):
                rows = dealt[a:b]
                number = int(bucket[rows[0]])
                owner, count = np.unique(document[rows], return_counts=True)
                done = number < 0
                for column, value in zip(columns, (
                    int(keys[0] % buckets) if done else number, planes(np.diff(ids[owner], prepend=0)), keys[owner].tobytes(), planes(count.astype(np.uint32)),
                    None if done else low6(minimiser[rows] & _LOW48), None if done else low6(piece[rows] & _LOW48),
                    planes(start[rows]), small[rows].tobytes(),
                )):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]],
                names=["bucket", "owners", "keys", "counts", "minimisers", "pieces", "starts", "small"],
            )

    return pack


def by_owner(owner: np.ndarray, keys: np.ndarray, ids: np.ndarray, parts: list[np.ndarray], kind: int):
    """Rows (_key, _order, kind, spans): the values of each owner (a place in keys and ids) packed one after the other."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    packed = np.stack([p[order].astype(np.uint32) for p in parts], 1)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(owner)].astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(keys[owner[first]]), pa.array(ids[owner[first]]), pa.array(np.full(len(first), kind, np.int32)),
        pa.array([packed[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
    ], names=["_key", "_order", "kind", "spans"])


def compared_pieces(rows: list[dict]):
    """Spans of one bucket that are repeated (kind 0), and places whose surroundings must be sorted (kind 1)."""
    open_rows = []
    for row in rows:
        if row["pieces"] is not None:
            open_rows.append(row)
            continue
        ids, keys = np.cumsum(from_planes(row["owners"], np.int64)), np.frombuffer(row["keys"], np.int32)
        owner = np.repeat(np.arange(len(ids)), from_planes(row["counts"], np.uint32))
        length = np.frombuffer(row["small"], np.uint8)[::4].astype(np.uint32) + LENGTH
        yield by_owner(owner, keys, ids, [from_planes(row["starts"], np.uint32), length], 0)
    if not open_rows:
        return
    ids = np.concatenate([np.cumsum(from_planes(r["owners"], np.int64)) for r in open_rows])
    keys = np.concatenate([np.frombuffer(r["keys"], np.int32) for r in open_rows])
    counts = np.concatenate([from_planes(r["counts"], np.uint32) for r in open_rows])
    minimiser, piece = (np.concatenate([from6(r[c]) for r in open_rows]) for c in ("minimisers", "pieces"))
    start = np.concatenate([from_planes(r["starts"], np.uint32) for r in open_rows])
    small = np.concatenate([np.frombuffer(r["small"], np.uint8).reshape(-1, 4) for r in open_rows])
    for row in open_rows:
        row.clear()
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    order = np.lexsort((ids[owner], piece, minimiser))
    minimiser, piece, start, small, owner = minimiser[order], piece[order], start[order], small[order], owner[order]
    new_minimiser = np.r_[True, minimiser[1:] != minimiser[:-1]]
    new_piece = new_minimiser | np.r_[True, piece[1:] != piece[:-1]]
    first = np.flatnonzero(new_piece)
    least = ids[owner[first]][np.cumsum(new_piece) - 1]
    repeated = ids[owner] > least
    if repeated.any():
        yield by_owner(owner[repeated], keys, ids, [start[repeated], small[repeated, 0].astype(np.uint32) + LENGTH], 0)
    # different pieces around one minimiser: those of at least two documents that share a side
    group = np.cumsum(new_minimiser)
    several = np.bincount(group[first]) > 1
    left = np.flatnonzero(~repeated & several[group])
    minimiser, start, small, owner = minimiser[left], start[left], small[left], owner[left]
    wanted = np.zeros((len(left), 2), bool)
    for column, side in enumerate((2, 3)):
        key = mixed(minimiser * _POWER + small[:, side].astype(np.uint64))
        by_key = np.argsort(key, kind="stable")
        new = np.r_[True, key[by_key][1:] != key[by_key][:-1]][: len(by_key)]
        edge = np.flatnonzero(new)
        if len(edge):
            sorted_ids = ids[owner[by_key]]
            differs = np.minimum.reduceat(sorted_ids, edge) != np.maximum.reduceat(sorted_ids, edge)
            wanted[by_key, column] = differs[np.cumsum(new) - 1]
        wanted[:, column] &= small[:, side] > 0
    asked = wanted.any(1)
    if asked.any():
        flags = wanted[asked] @ np.array([1, 2], np.uint32)
        yield by_owner(owner[asked], keys, ids, [start[asked] + small[asked, 1], flags], 1)


def _compared(batches):
    held: list[dict] = []
    for batch in batches:
        for place in range(batch.num_rows):
            row = {name: batch.column(i)[place].as_py() for i, name in enumerate(batch.schema.names)}
            if held and held[-1]["bucket"] != row["bucket"]:
                yield from compared_pieces(held)
                held = []
            held.append(row)
    if held:
        yield from compared_pieces(held)


def _surroundings(batches):
    """Per asked place: the shared part's hash, and the bytes before and after it."""
    for block in text_blocks(batches, "_text", _BLOCK):
        keys, begins, cores, owners, orders, words = [], [], [], [], [], []
        for text, order, key, spans in zip(*(block.column(c).to_pylist() for c in ("_text", "_order", "_key", "spans"))):
            data = (text or "").encode("utf-8", "surrogatepass")
            for packed in spans:
                for place, flags in np.frombuffer(packed, np.uint32).reshape(-1, 2).tolist():
                    for side, core in ((1, place - SIDE), (2, place)):
                        if flags & side and core >= 0 and core + CORE + SIDE <= len(data):
                            left = max(0, core - (LETTERS - 1))
                            end = core + CORE + SIDE
                            digest = hashlib.blake2b(data[core:end], digest_size=8, salt=bytes([side])).digest()
                            keys.append(int.from_bytes(digest, "little", signed=True))
                            begins.append(left)
                            cores.append(core - left)
                            words.append(data[left:core] + data[end : end + LETTERS - 1])
                            owners.append(key)
                            orders.append(order)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(cores, pa.int32()), pa.array(begins, pa.int32()),
            pa.array(orders, pa.int64()), pa.array(owners, pa.int32()),
        ], names=["group", "word", "core", "begin", "_order", "_key"])


def suffix_array(text: list[int]) -> list[int]:
    """Suffix order of a text whose last letter is smaller than all others and occurs once."""
    n = len(text)
    letters = np.array(text)
    order = np.argsort(letters, kind="stable")
    new = np.r_[True, letters[order][1:] != letters[order][:-1]]
    head = np.flatnonzero(new)
    heads = head[np.cumsum(new) - 1]
    spot = np.empty(n, np.int64)
    spot[order] = np.arange(n)
    group_of = heads[spot]
    ends = np.zeros(n, np.int64)
    ends[head] = np.r_[head[1:], n] - 1
    rows, spots, group, end = order.tolist(), spot.tolist(), group_of.tolist(), ends.tolist()
    before = [-1] * n

    # First sweep: groups in descending order; a group is named by its first place, so a part split off its end is greater.
    top = n - 1
    while top >= 0:
        start = group[rows[top]]
        pointed: dict[int, int] = {}
        for suffix in sorted(rows[start : top + 1]) if top > start else (rows[top],):
            smaller = suffix - 1
            while smaller >= 0 and group[smaller] >= start:
                smaller = before[smaller]
            before[suffix] = smaller
            if smaller >= 0:
                pointed[smaller] = pointed.get(smaller, 0) + 1
        if pointed:
            most = max(pointed.values())
            if most == 1:
                levels = [list(pointed)]
            else:
                by_count: dict[int, list[int]] = {}
                for suffix, count in pointed.items():
                    by_count.setdefault(count, []).append(suffix)
                levels = [by_count[c] for c in sorted(by_count, reverse=True)]
            for level in levels:
                old_ends: dict[int, int] = {}
                for suffix in level:
                    of = group[suffix]
                    last = end[of]
                    if of not in old_ends:
                        old_ends[of] = last
                    other, at = rows[last], spots[suffix]
                    rows[at], spots[other] = other, at
                    rows[last], spots[suffix] = suffix, last
                    end[of] = last - 1
                for suffix in level:
                    group[suffix] = end[group[suffix]] + 1
                for of, last in old_ends.items():
                    end[end[of] + 1] = last
        top = start - 1

    # Second sweep: whoever's next smaller suffix is met takes the next free place of its group.
    free = list(range(n))
    result, placed = [0] * n, bytearray(n)
    result[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        suffix = result[i] - 1
        while suffix >= 0 and not placed[suffix]:
            of = group[suffix]
            result[free[of]] = suffix
            free[of] += 1
            placed[suffix] = 1
            suffix = before[suffix]
    return result


def with_partner(groups: list[int], words: list[bytes], cores: list[int], ids: list[int]) -> list[int]:
    """Rows that share nine bytes before or after the shared part with another document's row of their group.

    Besides the shared part a string has 17 bytes, so nine of them at least lie on one side.
    """
    half = LETTERS // 2
    seen: dict = {}
    sides = []
    for group, word, core, number in zip(groups, words, cores, ids):
        both = (group, word[max(0, core - half) : core], 0), (group, word[core : core + half], 1)
        sides.append(both)
        for side in both:
            if seen.setdefault(side, number) != number:
                seen[side] = None
    return [i for i, (before, after) in enumerate(sides) if seen[before] is None or seen[after] is None]


def repeated_starts(groups: np.ndarray, words: list[bytes], cores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, letter) of the strings that a row of the same group with a smaller id has as well."""
    distinct: dict = {}
    of_row = np.array([distinct.setdefault((g, c, w), len(distinct)) for g, c, w in zip(groups.tolist(), cores.tolist(), words)])
    least = np.full(len(distinct), _LAST)
    np.minimum.at(least, of_row, ids)
    group_number: dict = {}
    text: list[int] = []
    begin = np.zeros(len(distinct), np.int64)
    size = np.zeros(len(distinct), np.int64)
    for number, (group, core, word) in enumerate(distinct):
        begin[number] = len(text)
        letters = [b + 2 for b in word]
        letters.insert(core, 258 + group_number.setdefault(group, len(group_number)))
        size[number] = len(letters)
        text += letters
        text.append(1)
    text.append(0)
    order = np.array(suffix_array(text))
    # strings: starts up to the core letter whose 18 letters stay inside the word
    core_of = np.fromiter((c for _, c, _ in distinct), np.int64, len(distinct))
    valid = np.full(len(text), -1, np.int64)
    for letter in range(LETTERS):
        fits = (letter <= core_of) & (letter + LETTERS <= size) & (letter + LETTERS > core_of)
        valid[begin[fits] + letter] = np.flatnonzero(fits)
    order = order[valid[order] >= 0]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    strings = np.lib.stride_tricks.sliding_window_view(np.array(text, np.int32), LETTERS)[order]
    new = np.r_[True, (strings[1:] != strings[:-1]).any(1)]
    word_of = valid[order]
    smallest = np.minimum.reduceat(least[word_of], np.flatnonzero(new))[np.cumsum(new) - 1]
    # per distinct word and letter: the smallest document that has the string
    floor = np.full((len(distinct), LETTERS), _LAST)
    floor[word_of, order - begin[word_of]] = smallest
    row, letter = np.nonzero(floor[of_row] < ids[:, None])
    return row, letter


def _sorted_out(batches):
    held: list = []

    def work(rows: list):
        rows = [rows[i] for i in with_partner(*(list(c) for c in list(zip(*rows))[:3]), [r[4] for r in rows])]
        if not rows:
            return
        groups = np.array([r[0] for r in rows], np.int64)
        ids, keys = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int32)
        row, letter = repeated_starts(groups, [r[1] for r in rows], np.array([r[2] for r in rows]), ids)
        begin = np.array([r[3] for r in rows], np.int64)
        if len(row):
            yield by_owner(row, keys, ids, [begin[row] + letter, np.full(len(row), LENGTH)], 0)

    letters = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("group", "word", "core", "begin", "_order", "_key"))):
            if letters >= ARRAY_LETTERS and held[-1][0] != row[0]:
                yield from work(held)
                held, letters = [], 0
            held.append(row)
            letters += len(row[1]) + 2
    if held:
        yield from work(held)


RESULT = "_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_runs(spans: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of packed (start, length) pairs."""
    if not spans:
        return []
    pairs = np.frombuffer(b"".join(spans), np.uint32).reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 0] + pairs[:, 1])
    first = np.flatnonzero(np.r_[True, pairs[1:, 0] > ends[:-1]])
    last = np.r_[first[1:] - 1, len(pairs) - 1]
    return list(zip(pairs[first, 0].tolist(), ends[last].tolist()))


def _cleaned(id_column: str):
    def clean(batches):
        for block in text_blocks(batches, "_text", _BLOCK):
            sizes, removed, runs, digests = [], [], [], []
            for text, spans in zip(block.column("_text").to_pylist(), block.column("spans").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                gone = removed_runs(spans)
                digest, at = hashlib.sha256(), 0
                for start, end in gone:
                    digest.update(data[at:start])
                    at = end
                digest.update(data[at:])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                runs.append(len(gone))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.column(id_column)] + [pa.array(v, pa.int64()) for v in (sizes, removed, runs)] + [pa.array(digests, pa.string())],
                names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return clean


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its bytes, the removed bytes and runs, and the SHA-256 of what is left."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # a document is known by its id and a hash of its text: equal rows have equal results
    rows = rows.withColumn("_key", F.hash("_id", "_text")).withColumn("_order", F.coalesce(F.col("_id").cast("long"), F.lit(int(_LAST))))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    packed = rows.select("_order", "_key", "_text").mapInArrow(_packed(buckets), PACKED)
    dealt = packed.repartitionById(buckets, F.col("bucket"))  # one bucket to a task
    spans = cut(dealt.mapInArrow(_compared, "_key int, _order long, kind int, spans binary"))

    # both joins read the same exchange of the texts
    texts, known = rows.select("_order", "_key", "_id", "_text"), ["_order", "_key"]
    asked = spans.filter("kind = 1").groupBy(*known).agg(F.collect_list("spans").alias("spans"))
    around = texts.join(asked, known).mapInArrow(_surroundings, "group long, word binary, core int, begin int, _order long, _key int")
    sorted_out = around.repartition("group").sortWithinPartitions("group").mapInArrow(
        _sorted_out, "_key int, _order long, kind int, spans binary"
    )
    gone = spans.filter("kind = 0").unionByName(sorted_out).groupBy(*known).agg(F.collect_list("spans").alias("spans"))
    id_type = docs.schema[key].dataType.simpleString()
    done = texts.join(gone, known, "left").mapInArrow(_cleaned("_id"), RESULT.format(id=id_type))
    return done.withColumnRenamed("_id", key)
