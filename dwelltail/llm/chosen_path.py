"""N-gram Jaccard join by chosen paths: classes of near-copies and every document's links.

A document is the set of its five-word shingles. Documents with equal sets are one node, found by a grouping. Nodes are
embedded as min-hashes. In every run a node follows each token (place, min-hash) that a hash of the path so far samples,
about ``PICKS`` of them; similar sets sample the same tokens and meet in the same buckets. A bucket of at most ``LEAF`` nodes is
compared pair by pair. A larger one is compared in blocks, of every group found in a block one node goes on,
and the recursion samples further tokens; so a bucket of many copies collapses instead of growing. Runs are repeated
until a pair at the threshold is missed with less than ``MISSED`` (see ``runs_for``).

The pairs only make candidate clusters. In each cluster all pairs are verified on the whole sets; large clusters are cut
into blocks of bounded size and each pair of blocks is a task of its own. No pair is written: a block gives
link counts and one edge per node, so thousands of near-copies stay linear in rows.

Defined results: texts with fewer than five words are one shingle of all their words; texts without a word (NULL, empty)
are equal to each other; equal rows are copies; NULL ids are never chosen as class id unless nothing else is there.
An empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import text_blocks
from dwelltail.session import attach, cut, row_count

SHINGLE = 5
#: Threshold of the Jaccard similarity as a fraction.
NEAR = (4, 5)
TOKENS = 64
PICKS = 1.6
#: Chance that a pair at the threshold is in no bucket of any run.
MISSED = 0.002
LEAF = 256
#: Equal min-hashes (of ``TOKENS``) that make a candidate; a pair at the threshold has 51 of them on average.
LEAST_EQUAL = 38
#: Shingles of a verification block.
BLOCK_SHINGLES = 100_000

_SEED = np.random.default_rng(7)
_FACTORS = _SEED.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def runs_for(missed: float = MISSED, picks: float = PICKS, near: float = NEAR[0] / NEAR[1]) -> int:
    """Runs after which a pair at the threshold was missed in all of them with that chance at most.

    In one run the pair's common path dies out like a branching process with ``picks * near`` followers.
    """
    out = 0.0
    for _ in range(200):
        out = math.exp(-picks * near * (1 - out))
    return math.ceil(math.log(missed) / math.log(out))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; empty without a word."""
    words, counts = [], []
    for text in texts:
        found = (text or "").encode("utf-8", "surrogatepass").split()
        words += found
        counts.append(len(found))
    if not words:
        return [np.zeros(0, np.uint64)] * len(texts)
    codes, names = pd.factorize(np.array(words, dtype=object))
    word = pd.util.hash_array(names, categorize=False)[codes]
    rolled = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for step in range(SHINGLE):
        rolled = rolled * _MULTIPLIER + word[step : step + len(rolled)]
    rolled = mixed(rolled)
    sets, start = [], 0
    for count in counts:
        if count >= SHINGLE:
            sets.append(np.unique(rolled[start : start + count - SHINGLE + 1]))
        elif count:
            one = np.uint64(count)
            with np.errstate(over="ignore"):
                for value in word[start : start + count]:
                    one = one * _MULTIPLIER + value
            sets.append(mixed(np.array([one], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        start += count
    return sets


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(n, TOKENS) of uint64; the empty set has zeros."""
    result = np.zeros((len(sets), TOKENS), np.uint64)
    sizes = np.array([len(s) for s in sets])
    filled = np.flatnonzero(sizes)
    if len(filled):
        values = np.concatenate([sets[i] for i in filled])
        starts = np.r_[0, np.cumsum(sizes[filled])[:-1]]
        for token in range(TOKENS):
            result[filled, token] = np.minimum.reduceat((values ^ (values >> np.uint64(29))) * _FACTORS[token], starts)
    return result


def next_paths(paths: np.ndarray, values: np.ndarray, picks: float = PICKS) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every token that a row follows from its path; the choice hangs on path and token alone."""
    place = np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    drawn = mixed(paths[:, None] * _MULTIPLIER + mixed(values + place[None, :]))
    chosen = drawn < np.uint64(int(picks / TOKENS * 2**64))
    rows, tokens = np.nonzero(chosen)
    return rows, mixed(drawn[rows, tokens] + np.uint64(1))


def _embedded(runs: int):
    starts = mixed(np.arange(1, runs + 1, dtype=np.uint64))

    def embed(batches):
        for block in text_blocks(batches, "_text"):
            sets = shingle_sets(block.column("_text").to_pylist())
            hashes = min_hashes(sets)
            digests = [blake2b(s.tobytes(), digest_size=8).digest() for s in sets]
            paths: list[list[int]] = [[] for _ in sets]
            for start in starts:
                for row, path in zip(*(x.tolist() for x in next_paths(np.full(len(sets), start), hashes))):
                    paths[row].append(path - (1 << 63))
            small = (mixed(hashes) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                block.column("_id"), block.column("_key"), pa.array(np.frombuffer(b"".join(digests), np.int64)),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([row.tobytes() for row in small], pa.binary()), pa.array(paths, pa.list_(pa.int64())),
            ], names=["_id", "_key", "node", "n_shingles", "sketch", "paths"])

    return embed


def equal_tokens(sketches: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group (rows lie group by group) with at least ``LEAST_EQUAL`` equal tokens."""
    first, second, distance = [], [], 1
    while distance < len(group):
        rows = np.flatnonzero(group[:-distance] == group[distance:])
        if not len(rows):
            break
        alike = (sketches[rows] == sketches[rows + distance]).sum(1) >= LEAST_EQUAL
        first.append(rows[alike])
        second.append(rows[alike] + distance)
        distance += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate(first or [empty]), np.concatenate(second or [empty])


def smallest_connected(size: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Per row the smallest row it is connected with."""
    label = np.arange(size)
    while True:
        lower = label.copy()
        np.minimum.at(lower, first, label[second])
        np.minimum.at(lower, second, label[first])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compared(batches):
    """Edges inside the blocks of buckets; of large buckets' groups one node each with its next paths."""

    def work(rows: pd.DataFrame):
        group = rows.groupby(["path", "block"], sort=False).ngroup().to_numpy()
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, TOKENS)
        label = smallest_connected(len(rows), *equal_tokens(sketches, group))
        node = rows["node"].to_numpy()
        linked = np.flatnonzero(label != np.arange(len(rows)))
        on = np.flatnonzero((label == np.arange(len(rows))) & rows["large"].to_numpy())
        at, paths = next_paths(rows["path"].to_numpy().view(np.uint64)[on], sketches[on].astype(np.uint64))
        on = on[at]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([node[linked], node[on]])), pa.array(np.concatenate([node[label[linked]], np.zeros(len(on), np.int64)])),
            pa.array(np.concatenate([np.zeros(len(linked), np.int64), paths.view(np.int64)])),
            pa.array([None] * len(linked) + [sketches[i].tobytes() for i in on], pa.binary()),
        ], names=["node", "other", "path", "sketch"])

    held = None
    for batch in batches:
        rows = batch.to_pandas()
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        last = (rows["path"] == rows["path"].iloc[-1]) & (rows["block"] == rows["block"].iloc[-1])
        held = rows[last].reset_index(drop=True)
        if not last.all():
            yield from work(rows[~last].reset_index(drop=True))
    if held is not None and len(held):
        yield from work(held)


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Edges (node, other) that connect the nodes met in a bucket with alike sketches."""
    rows = nodes.select("node", "sketch", F.explode("paths").alias("path"))
    edges = None
    while True:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LEAF)
        sized = attach(rows, sizes, ["path"], "left")
        blocks = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("path", "node"), F.ceil(F.col("_n") * 2 / LEAF))).otherwise(F.lit(0))
        placed = sized.select("node", "sketch", "path", F.col("_n").isNotNull().alias("large"), blocks.cast("long").alias("block"))
        dealt = placed.repartition("path", "block").sortWithinPartitions("path", "block", "node")
        found = cut(dealt.mapInArrow(_compared, "node long, other long, path long, sketch binary"))
        # A node meets a bounded number of smaller nodes; linking those with the smallest of them leaves one edge per node.
        met = found.filter("sketch is null and node <> other").groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("_met"))
        least = F.array_min("_met")
        linked = met.select(F.explode(F.array_union(F.array("node"), F.slice("_met", 2, F.size("_met")))).alias("node"), least.alias("other")).distinct()
        edges = linked if edges is None else edges.unionByName(linked)
        rows = found.filter("sketch is not null").select("node", "sketch", "path")
        if rows.isEmpty():
            return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: the smallest node it is connected with."""
    both = cut(edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("_l")), "other")
        least = near.groupBy("node").agg(F.min("_l").alias("_l"))
        renewed = labels.join(least, "node").select("node", F.least("label", "_l").alias("label"), (F.col("_l") < F.col("label")).alias("_new"))
        stored = cut(renewed, F.count_if("_new"))
        labels = stored.drop("_new")
        if not stored._measured:
            return labels


def _sets_of(batches):
    for block in text_blocks(batches, "_text"):
        sets = shingle_sets(block.column("_text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [block.column(c) for c in ("cluster", "node", "copies", "blocks")] + [pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["cluster", "node", "copies", "blocks", "set"],
        )


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of all pairs, from incidence matrices over the shingles that both sides have."""
    values_l, values_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(values_l, values_r)
    result = np.zeros((len(left), len(right)), np.float32)

    def cells(sets, values):
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        inside = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[inside], at[inside]

    rows_l, columns_l = cells(left, values_l)
    rows_r, columns_r = cells(right, values_r)
    for start in range(0, len(shared), width):
        size = min(width, len(shared) - start)
        here_l, here_r = (columns_l >= start) & (columns_l < start + size), (columns_r >= start) & (columns_r < start + size)
        matrix_l, matrix_r = np.zeros((len(left), size), np.float32), np.zeros((len(right), size), np.float32)
        matrix_l[rows_l[here_l], columns_l[here_l] - start] = 1
        matrix_r[rows_r[here_r], columns_r[here_r] - start] = 1
        result += matrix_l @ matrix_r.T
    return result.astype(np.int64)


def linked_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one pair of blocks: per node the number of documents linked and one connected node."""
    rows = rows.drop_duplicates(["node", "side"])
    left, right = rows[rows["side"] == 0].reset_index(drop=True), rows[rows["side"] == 1].reset_index(drop=True)
    same = not len(right)
    right = left if same else right
    none = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return none
    sets_l, sets_r = ([np.frombuffer(s, np.uint64) for s in side["set"]] for side in (left, right))
    sizes_l, sizes_r = (np.array([len(s) for s in sets]) for sets in (sets_l, sets_r))
    common = common_counts(sets_l, sets_r)
    near = NEAR[1] * common >= NEAR[0] * (sizes_l[:, None] + sizes_r[None, :] - common)
    if same:
        np.fill_diagonal(near, False)
    near &= (sizes_l[:, None] > 0) & (sizes_r[None, :] > 0)
    first, second = np.nonzero(near)
    label = smallest_connected(len(left) + len(right), first, second if same else second + len(left))
    nodes = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
    frame_l = pd.DataFrame({"node": left["node"], "links": near @ right["copies"].to_numpy(), "other": nodes[label[: len(left)]]})
    if same:
        return frame_l[frame_l["links"] > 0]
    frame_r = pd.DataFrame({"node": right["node"], "links": near.T @ left["copies"].to_numpy(), "other": nodes[label[len(left) :]]})
    return pd.concat([frame_l[frame_l["links"] > 0], frame_r[frame_r["links"] > 0]])


def _verified(batches):
    held = None

    def work(rows: pd.DataFrame):
        for _, group in rows.groupby(["cluster", "a", "b"], sort=False):
            found = linked_rows(group)
            if len(found):
                yield pa.RecordBatch.from_pandas(found, preserve_index=False).select(["node", "links", "other"])

    for batch in batches:
        rows = batch.to_pandas()
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        last = (rows["cluster"] == rows["cluster"].iloc[-1]) & (rows["a"] == rows["a"].iloc[-1]) & (rows["b"] == rows["b"].iloc[-1])
        held = rows[last].reset_index(drop=True)
        yield from work(rows[~last])
    if held is not None:
        yield from work(held)


def verified_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, links, other) per pair of blocks: exact similarities of all pairs inside every candidate cluster."""
    members = nodes.join(clusters.select("node", F.col("label").alias("cluster")), "node").select("node", "_key", "copies", "n_shingles", "cluster")
    totals = members.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = attach(members, totals, ["cluster"]).select("_key", "node", "copies", "cluster", "blocks")
    sets = attach(docs, wanted, ["_key"]).select("cluster", "node", "copies", "blocks", "_text").mapInArrow(
        _sets_of, "cluster long, node long, copies long, blocks int, set binary"
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    spread = sets.withColumn("_own", own).select("cluster", "node", "copies", "set", "_own", other)
    placed = spread.select(
        "cluster", "node", "copies", "set", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
    )
    dealt = placed.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    return dealt.mapInArrow(_verified, "node long, links long, other long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, class_id, n_links) of every row: the smallest id of its class, and how many documents it is linked with.

    ``_key`` tells rows apart but for equal ones. Links are to documents with another shingle set at the
    threshold or above and to further documents with the same set.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).withColumn("_key", F.xxhash64("_id", "_text"))
    id_type = docs.schema[key].dataType.simpleString()
    embedded = cut(rows.select("_id", "_key", "_text").mapInArrow(
        _embedded(runs_for()), f"_id {id_type}, _key long, node long, n_shingles long, sketch binary, paths array<long>"
    ))
    nodes = cut(embedded.groupBy("node").agg(
        F.min("_id").alias("first_id"), F.min_by("_key", F.struct(F.col("_id").isNull(), "_id", "_key")).alias("_key"), F.count(F.lit(1)).alias("copies"),
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"),
    ))
    links = cut(verified_links(rows, nodes, components(candidate_edges(nodes))))
    connected = components(links.filter("node <> other").select("node", "other"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first_id", "copies").join(counted, "node", "left").join(connected, "node", "left")
    known = cut(known.select(
        "node", "first_id", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ))
    ids = known.groupBy("label").agg(F.min("first_id").alias("class_id"))
    table = attach(known, ids, ["label"]).select("node", "class_id", "label", "n_links")
    return attach(embedded.select("_id", "_key", "node"), table, ["node"]).select("_id", "_key", "class_id", "label", "n_links")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, its class id, and its number of links."""
    return classes(docs, key, text).select(F.col("_id").alias(key), "class_id", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every class: the one with the smallest id."""
    found = cut(classes(docs, key, text))
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("_key"))
    first = cut(found.groupBy("label").agg(F.min(place).alias("first")).select(F.col("first._key").alias("_key")))
    rows = docs.withColumn("_key", F.xxhash64(key, text))
    kept = rows.join(first, "_key", "left_semi")
    repeated = found.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(first, "_key", "left_semi")
    if not repeated.isEmpty():  # equal rows: one stays
        kept = kept.dropDuplicates(["_key"])
    return kept.drop("_key")
