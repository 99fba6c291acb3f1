"""Exact dedup by Patricia tries whose terminal nodes hold the owner of a text.

Texts are dealt to partitions by length and a 64-bit hash of the content. Each partition inserts the full byte strings into a compressed radix
trie; the node where a string ends holds the largest id that brought it, and the number of rows. So equality is decided byte by byte.

* Before the shuffle every task inserts its own rows into tries of bounded size, so a text arrives once per trie of a task however
  often it stands there, and a text of a third of all rows is no hot partition.
* A trie above its bound spills by subtree: the heaviest child of its first fork goes out as rows, and strings that lead there later
  follow unread. Spilled rows are stored, dealt anew by length and hash, and inserted in a further round; every trie keeps at
  least one string, so the rounds end.
* The rows find their owner by length, hash and SHA-256 of their bytes (all from the trie's node). Groups of very many copies are few and
  joined without a shuffle, the others are dealt by key.

Defined results: NULL counts as empty text and equals it; a NULL id is below all others, and owns a text only that rows without ids have;
of rows that repeat both id and text one stays; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import text_blocks
from dwelltail.session import attach, cut, row_count

#: Bytes of labels and nodes of a trie before it spills, and of a task's tries before the shuffle.
TRIE_BYTES = 48 << 20
LOCAL_BYTES = 16 << 20
#: Bytes of text that a partition gets on average.
PARTITION_BYTES = 12 << 20
#: What a node counts besides its label.
NODE_BYTES = 400
#: Copies from which a group is joined apart.
HOT_GROUP = 10_000

_SPILLED = object()


class Node:
    """A stretch of bytes, what follows it by first byte, and the entry of the string that ends here."""

    __slots__ = ("label", "after", "entry")

    def __init__(self, label: bytes, after: dict, entry):
        self.label, self.after, self.entry = label, after, entry


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and ``b[at:]``, by doubling and halving; both share the first byte."""
    limit = min(len(a), len(b) - at)
    good, step = 1, 16
    while good < limit:
        end = min(limit, good + step)
        if a[good:end] == b[at + good : at + end]:
            good, step = end, step * 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return good


class PatriciaTrie:
    """Byte strings with entries ``[owner, rows, rows of the owner, hash]``."""

    def __init__(self):
        self.root = Node(b"", {}, None)
        self.size = 0

    def insert(self, text: bytes, owner: int | None, rows: int = 1, owned: int = 1, hash_: int = 0) -> bool:
        """Add a string; False if its subtree has been spilled."""
        node, at = self.root, 0
        while at < len(text):
            child = node.after.get(text[at])
            if child is None:
                node.after[text[at]] = Node(text[at:], {}, [owner, rows, owned, hash_])
                self.size += len(text) - at + NODE_BYTES
                return True
            if child is _SPILLED:
                return False
            if not text.startswith(child.label, at):
                shared = _common(child.label, text, at)
                upper = Node(child.label[:shared], {child.label[shared]: child}, None)
                child.label = child.label[shared:]
                node.after[text[at]] = child = upper
                self.size += NODE_BYTES
            node, at = child, at + len(child.label)
        entry = node.entry
        if entry is None:
            node.entry = [owner, rows, owned, hash_]
        else:
            entry[1] += rows
            if owner == entry[0]:
                entry[2] += owned
            elif entry[0] is None or owner is not None and owner > entry[0]:
                entry[0], entry[2] = owner, owned
        return True

    def strings(self, start: Node | None = None, before: bytes = b""):
        """(bytes, entry) of every string below a node."""
        waiting = [(start or self.root, before)]
        while waiting:
            node, before = waiting.pop()
            if node is _SPILLED:
                continue
            text = before + node.label
            if node.entry is not None:
                yield text, node.entry
            waiting += [(child, text) for child in node.after.values()]

    def _weight(self, start: Node) -> int:
        total, waiting = 0, [start]
        while waiting:
            node = waiting.pop()
            if node is not _SPILLED:
                total += len(node.label) + NODE_BYTES
                waiting += node.after.values()
        return total

    def spill(self):
        """Take the heaviest subtree of the first fork out; yields its strings. Nothing if only one string is left."""
        node, before = self.root, b""
        while node.entry is None and len(live := [c for c in node.after.values() if c is not _SPILLED]) == 1:
            node, before = live[0], before + node.label
        weights = {first: self._weight(c) for first, c in node.after.items() if c is not _SPILLED}
        if not weights:
            return
        heaviest = max(weights, key=weights.__getitem__)
        subtree, node.after[heaviest] = node.after[heaviest], _SPILLED
        self.size -= weights[heaviest]
        yield from self.strings(subtree, before + node.label)


OWNED = "n_bytes long, hash long, sha binary, owner long, n long, owned long, text binary"
_NAMES = ["n_bytes", "hash", "sha", "owner", "n", "owned", "text"]


def _batches(rows, limit: int = 4 << 20):
    """Rows in the order of ``_NAMES`` as record batches of bounded bytes."""
    schema = pa.schema([(n, pa.binary() if n in ("sha", "text") else pa.int64()) for n in _NAMES])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[-1] or b"")
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _rows(trie: PatriciaTrie, entries=None):
    """Rows that carry their text."""
    for text, (owner, n, owned, hash_) in trie.strings() if entries is None else entries:
        yield len(text), hash_, None, owner, n, owned, text


def _local(limit: int):
    """The distinct texts of a task's rows (columns _id, n_bytes, hash, text), in tries of bounded size.

    A full trie is sent on but for the texts that have come repeatedly, so a very frequent one leaves a task once.
    """

    def rows(batches):
        trie = PatriciaTrie()
        for block in text_blocks(batches, "text"):
            for owner, hash_, text in zip(*(block.column(c).to_pylist() for c in ("_id", "hash", "text"))):
                trie.insert(text, owner, 1, 1, hash_)
            if trie.size > limit:
                full, trie = trie, PatriciaTrie()
                for text, entry in full.strings():
                    if entry[1] > 1 and trie.size < limit // 2:
                        trie.insert(text, *entry)
                    else:
                        yield from _rows(full, [(text, entry)])
        yield from _rows(trie)

    return lambda batches: _batches(rows(batches))


def _owners(limit: int):
    """Rows of distinct texts with their owners (``sha`` set, no text), and spilled ones (text, no ``sha``)."""

    def rows(batches):
        trie = PatriciaTrie()
        for block in text_blocks(batches, "text"):
            for row in zip(*(block.column(c).to_pylist() for c in ("text", "owner", "n", "owned", "hash"))):
                if not trie.insert(*row):
                    yield from _rows(trie, [(row[0], row[1:])])
            while trie.size > limit:
                before = trie.size
                yield from _rows(trie, trie.spill())
                if trie.size == before:
                    break
        for text, (owner, n, owned, hash_) in trie.strings():
            yield len(text), hash_, hashlib.sha256(text).digest(), owner, n, owned, None

    return lambda batches: _batches(rows(batches))


def owners(texts: DataFrame, trie_bytes: int = TRIE_BYTES, local_bytes: int = LOCAL_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Per distinct text (columns _id, n_bytes, hash, text): n_bytes, hash, sha, owner, n (rows), owned (rows with the owner's id)."""
    key = ["n_bytes", "hash"]
    total = texts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    waiting = texts.mapInArrow(_local(local_bytes), OWNED)
    done, number = None, 0
    while True:
        # another number of partitions in every round, so that spilled texts part
        partitions = max(1, -(-total // partition_bytes)) + number
        dealt = waiting.repartition(int(partitions), *key, F.lit(number))
        spilled = F.sum(F.when(F.col("sha").isNull(), F.col("n_bytes") + NODE_BYTES))
        found = cut(dealt.mapInArrow(_owners(trie_bytes), OWNED), F.coalesce(spilled, F.lit(0)))
        settled = found.filter("sha is not null").drop("text")
        done = settled if done is None else done.unionByName(settled)
        if not found._measured:
            return done
        waiting, total, number = found.filter("sha is null"), found._measured, number + 1


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT_GROUP, **limits: int) -> DataFrame:
    """Per row: key, keep_id, group_size, kept, text_sha256."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias("_id"), content.alias("text"))
    rows = rows.select("_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("hash"), "text")
    found = owners(rows, **limits)
    several = found.filter("n > 1").select("n_bytes", "hash", "sha", "owner", "n", "owned")

    known = rows.select("_id", "n_bytes", "hash", F.unhex(F.sha2("text", 256)).alias("sha"))
    names = ["n_bytes", "hash", "sha"]
    large = several.filter(F.col("n") >= hot).withColumnsRenamed({"owner": "_owner", "n": "_n", "owned": "_owned"})
    marked = attach(known, large, names, "left")
    # rows of large groups are done: their key is replaced, so that they spread over the partitions of the join
    free = F.when(F.col("_n").isNull(), F.col("hash")).otherwise(F.xxhash64("_id", "hash"))
    marked = marked.withColumn("_hash", free).withColumn("_len", F.when(F.col("_n").isNull(), F.col("n_bytes")).otherwise(F.lit(-1)))
    small = several.filter(F.col("n") < hot).withColumnsRenamed({"n_bytes": "_len", "hash": "_hash"})
    joined = marked.join(small, ["_len", "_hash", "sha"], "left")
    joined = joined.select(
        "_id", "sha", F.when(F.col("_n").isNotNull(), F.col("_owner")).when(F.col("n").isNotNull(), F.col("owner")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_n", "n", F.lit(1)).cast("long").alias("group_size"), F.coalesce("_owned", "owned", F.lit(1)).alias("owned"),
    )
    joined = joined.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    if several.filter("owned > 1").isEmpty():
        result = joined
    else:
        # rows that repeat id and text are the same in every column here: one of each keeps, the others do not
        tied = joined.filter(F.col("kept") & (F.col("owned") > 1))
        each = tied.groupBy("_id", "sha", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("owned"))
        each = each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("owned")))).withColumn("kept", F.col("_copy") == 1)
        result = joined.filter(~(F.col("kept") & (F.col("owned") > 1))).unionByName(each.drop("_copy"))
    return result.select(
        F.col("_id").cast(docs.schema[key].dataType).alias(key), F.col("keep_id").cast(docs.schema[key].dataType).alias("keep_id"),
        "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"),
    )
