"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a target in words. The mix is cut into blocks of equally many words; the blocks go to
the sources by the highest quotients target / (2k + 1), then within a source to its shards by the
same rule, which gives a whole number of blocks for every shard. A shard's documents, in an order drawn
from the seed, form a line of words that is cut into blocks; a seeded permutation picks as many of them
as the quota says, after whole passes over the line. What a document gives is the overlap of its
stretch of the line with the picked blocks, so no join of blocks is needed.

Defined results: a NULL text has size 0 and is never taken; a NULL source is a source of its own and comes last;
equal rows are told apart by their place in the line; an empty table gives no rows; columns of
the input named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwelltail.llm.common import without, word_count
from dwelltail.operators.sampling import hashed
from dwelltail.session import attach, cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Times a source (and a document) may be repeated.
MAX_REPEATS = 3
BLOCK_WORDS = 64
#: Words of a shard.
SHARD_WORDS = 1_000_000
#: Bins that documents are drawn into, a multiple of this many: at least one for every shard the table can need.
BINS = 256
#: Multipliers of the block permutation; the second where the first divides the block count.
STRIDES = (1_000_003, 999_983)

ADDED = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """(_source, _source_size) -> also _target: weight shares, at most ``cap`` times the source's size.

    What a capped source cannot use goes to the others by weight. That water level is found in one pass
    along cap * size / weight; the table has one row per source.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_weight", weight.cast("long"))
    ranked = ranked.withColumn("_limit", F.col("_source_size") * cap)
    whole = Window.partitionBy(F.lit(0))
    upward = whole.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("_source_size").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    shares = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = ranked.withColumn("_level", left / shares).withColumn("_place", F.row_number().over(upward))
    fits = F.col("_level") * F.col("_weight") <= F.col("_limit")
    reached = F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_place"))).over(whole)
    return level.select(
        "_source", "_source_size", F.least(F.col("_limit").cast("double"), reached * F.col("_weight")).alias("_target")
    )


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: Column) -> DataFrame:
    """Add ``_seats``: the seats of a group to its parties by highest quotients votes / (2k + 1).

    Seats are the rounded multiples of the votes by one common factor. Among n parties and S seats that factor's sum of
    multiples is within n / 2 of S, so a party's seats are within 1 + share * n / (2 S) of its share, and only those quotients are ranked: five
    per party on average. Ties go to the smaller party key.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total = F.sum(votes).over(whole)
    share = F.coalesce(F.try_divide(F.col(votes) * F.col("_all"), total), F.lit(0.0))
    near = parties.withColumn("_all", seats.cast("long")).withColumn("_exact", share).withColumn("_share", F.floor("_exact"))
    span = F.coalesce(F.try_divide(F.col("_exact") * F.count(F.lit(1)).over(whole), 2 * F.col("_all")), F.lit(0.0))
    near = near.withColumn("_span", F.ceil(span).cast("long") + 2)
    near = near.withColumn("_sure", F.greatest(F.lit(0), F.col("_share") - F.col("_span")).cast("long"))
    near = near.withColumn("_open", F.col("_all") - F.sum("_sure").over(whole))
    ladder = near.withColumn("_k", F.explode(F.sequence("_sure", F.col("_share") + F.col("_span"))))
    best = whole.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(party).asc_nulls_last(), "_k")
    placed = ladder.withColumn("_won", F.row_number().over(best) <= F.col("_open")).withColumn(
        "_won", F.col("_won") & (F.col(votes) > 0)
    )
    return placed.groupBy(*[c for c in parties.columns]).agg(
        (F.first("_sure") + F.sum(F.col("_won").cast("long"))).alias("_seats")
    )


def shard_quotas(
    sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(_source, _shard, _shard_size) -> also _source_size, _target and _quota in blocks."""
    sources = sizes.groupBy("_source").agg(F.sum("_shard_size").alias("_source_size"))
    targets = source_targets(sources, weights, cap)
    total = F.sum("_source_size").over(Window.partitionBy(F.lit(0)))
    blocks = targets.withColumn("_blocks", F.round(total / block_words).cast("long"))
    won = sainte_lague(blocks, [], "_source", "_target", F.col("_blocks"))
    won = won.select("_source", "_source_size", "_target", F.col("_seats").alias("_source_blocks"))
    shards = sizes.alias("z").join(won.alias("w"), F.col("z._source").eqNullSafe(F.col("w._source"))).select("z.*", "w._source_size", "w._target", "w._source_blocks")
    # NULL is a group of its own in windows and groupings, so the sources need no stand-in here.
    placed = sainte_lague(shards, ["_source"], "_shard", "_shard_size", F.col("_source_blocks"))
    line = F.ceil(F.col("_shard_size") / block_words).cast("long")
    return placed.select(
        "_source", "_shard", "_shard_size", "_source_size", "_target",
        F.least(F.col("_seats"), line * cap).alias("_quota"),
    )


def picks(block: Column, blocks: Column, quota: Column, offset: Column) -> Column:
    """How often a block of the line is taken: whole passes, then the first of a seeded permutation."""
    stride = F.when(blocks % STRIDES[0] == 0, F.lit(STRIDES[1])).otherwise(F.lit(STRIDES[0]))
    place = ((block % blocks) * (stride % blocks) + offset) % blocks
    return F.floor(quota / blocks) + (place < quota % blocks).cast("long")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights=WEIGHTS,
    cap: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 8,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted)."""
    kept = without(docs, ADDED)
    sized = docs.select(
        *kept, word_count(F.col(text)).alias("_size"), F.col(source).alias("_source"),
        hashed(seed, F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_draw"),
    )
    # a word has a byte and a separator at least
    most = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0))).first()[0] // 2
    bins_of_all = BINS * max(1, -(-most // (BINS * shard_words)))
    bin_of = F.pmod("_draw", F.lit(bins_of_all))
    by_source = cut(sized.groupBy("_source", bin_of.alias("_bin")).agg(F.sum("_size").alias("_bin_size")))
    size_of = F.sum("_bin_size").over(Window.partitionBy("_source"))
    shards = F.greatest(F.lit(1), F.ceil(size_of / shard_words)).cast("long")
    binned = by_source.withColumn("_shards", shards).withColumn("_shard", F.pmod("_bin", "_shards"))
    sizes = binned.groupBy("_source", "_shard").agg(F.sum("_bin_size").alias("_shard_size"))
    quotas = shard_quotas(sizes, weights, cap, block_words)
    bins = binned.alias("b").join(
        quotas.alias("q"), F.col("b._source").eqNullSafe(F.col("q._source")) & (F.col("b._shard") == F.col("q._shard"))
    ).select(
        F.coalesce(F.col("b._source"), F.lit("")).alias("_name"), F.col("b._source").isNull().alias("_none"), "b._bin",
        "q._shard", "q._shard_size", "q._source_size", "q._target", "q._quota",
    )
    keyed = sized.withColumns({
        "_name": F.coalesce("_source", F.lit("")), "_none": F.col("_source").isNull(), "_bin": bin_of,
    })
    placed = attach(keyed, bins, ["_name", "_none", "_bin"])
    along = Window.partitionBy("_name", "_none", "_shard").orderBy("_draw", F.col(key), "_size")
    end = F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, 0))
    lined = placed.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_size"))
    lined = lined.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_shard_size") / block_words)).cast("long"))
    offset = F.pmod(hashed(seed, F.lit("offset"), F.col("_name"), F.col("_shard")), F.col("_blocks"))
    lined = lined.withColumn("_offset", offset)
    inside = F.sequence(F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words))
    overlap = F.aggregate(
        inside, F.lit(0).cast("long"),
        lambda total, block: total + picks(block, F.col("_blocks"), F.col("_quota"), F.col("_offset"))
        * (F.least(F.col("_end"), (block + 1) * block_words) - F.greatest(F.col("_start"), block * block_words)),
    )
    taken = F.when(F.col("_size") > 0, overlap).otherwise(F.lit(0)).cast("long")
    return lined.select(
        *kept, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), taken.alias("taken"),
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each one as many times as ``taken`` rounds to in whole copies."""
    mixed = mix(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns if c.lower() in ADDED}), **options)
    copies = F.coalesce(F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5), F.lit(0))
    rows = mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    back = {f"_in_{c}": c for c in docs.columns if c.lower() in ADDED}
    return rows.drop("_copy", *ADDED).withColumnsRenamed(back).select(docs.columns)
