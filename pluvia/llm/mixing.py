"""Mixing sources to target weights: Sainte-Lague quotas of equal-word blocks, by source and shard.

Each source is split by hash into shards of about ``SHARD_WORDS`` words. In a shard the documents
stand in seeded order and their words are cut into equal blocks. Highest quotients deal the blocks
of the mix to sources, then each source's blocks to its shards. A shard gives its quota as whole
rounds of all its blocks and a run of blocks that starts at a seeded block, so at most a few of its
documents are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.shared import WORD, stored, text_of, words_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1024
#: Blocks that the smallest source with words has at least (down to blocks of one word).
BLOCKS_PER_SOURCE = 256


def water_filled(
    sources: DataFrame, weights: tuple[float, ...], max_repeats: int
) -> DataFrame:
    """``sources`` (source, source_size) with ``source_no``, ``weight`` and ``target``.

    Shares follow the weights until a source reaches ``max_repeats`` times its size; what is over
    goes to the others. With sources by rising cap per weight, the level of those still open is
    (words not yet given) / (weights still open), and the right one is the highest of them.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("source_no", F.row_number().over(by_source) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    listed = listed.withColumn("weight", F.get(turn, F.col("source_no") % len(weights)))
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    rising = W.orderBy(cap / F.col("weight"), "source_no")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    onward = rising.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything)
    given = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = (total - given) / F.sum("weight").over(onward)
    return (
        listed.withColumn("level", level)
        .withColumn("total", total)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(cap, F.col("weight") * F.col("level")))
        .select("source", "source_no", "source_size", "total", "target")
    )


def apportioned(
    parties: DataFrame, votes: str, seats: str, limit: Column, within: list[str], tie: str
) -> DataFrame:
    """``parties`` with the seats that the highest quotients votes / (2k + 1) win, as ``won``.

    ``seats`` is the number of seats of a party's group (columns ``within``), ``limit`` the most
    that a party can take. The last winning quotient is near votes per seat: it moves the fair share
    of a party by at most share * parties / (2 seats). Only quotients in that range are compared,
    about three a party, and all below it are won without comparison.
    """
    group = W.partitionBy(*within)
    fair = F.col(seats) * F.col(votes) / F.nullif(F.sum(votes).over(group), F.lit(0))
    slack = F.count(F.lit(1)).over(group) / (2 * F.nullif(F.col(seats), F.lit(0)))
    shares = parties.withColumns({"fair_": fair, "slack_": slack, "limit_": limit})
    # Groups without seats or votes have null shares; least and greatest would skip the null.
    low = F.coalesce(F.floor(F.col("fair_") * (1 - F.col("slack_"))) - 1, F.lit(0))
    high = F.coalesce(F.ceil(F.col("fair_") * (1 + F.col("slack_"))) + 1, F.lit(0))
    bounded = lambda k: F.greatest(F.least(k, F.col("limit_")), F.lit(0)).cast("long")
    shares = shares.withColumns({"low_": bounded(low), "high_": bounded(high)})
    key = [*within, tie]
    contest = (
        shares.withColumn("left_", F.col(seats) - F.sum("low_").over(group))
        .filter("high_ > low_")
        .select("*", F.explode(F.sequence("low_", F.col("high_") - 1)).alias("k_"))
        .withColumn("quotient_", F.col(votes) / (2 * F.col("k_") + 1))
        .withColumn("rank_", F.row_number().over(group.orderBy(F.desc("quotient_"), tie, "k_")))
        .filter("rank_ <= left_")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("more_"))
    )
    won = F.col("low_") + F.coalesce("more_", F.lit(0))
    return shares.join(contest, key, "left").select(*parties.columns, won.alias("won"))


def overlap(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Words that the ranges [start, end) and [lo, hi) share."""
    return F.greatest(F.least(end, hi) - F.greatest(start, lo), F.lit(0))


def sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, carry: bool) -> DataFrame:
    """A row's id, source, words, and place in the seeded order; with ``carry`` the row itself."""
    t = text_of(text)
    return docs.select(
        *[F.struct("*").alias("row")] * carry,
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.size(words_of(t)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{source}`"), t).alias("order_"),
    )


def in_shards(rows: DataFrame, targets: DataFrame, shard_words: int) -> DataFrame:
    """``rows`` with the number of their source and their shard in it."""
    n = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    numbers = targets.select(F.col("source").alias("source_"), "source_no", n.alias("shards_"))
    return (
        rows.join(numbers, F.col("source").eqNullSafe(F.col("source_")))
        .withColumn("shard", F.pmod(F.hash("order_"), F.col("shards_")).cast("int"))
        .drop("source_", "shards_")
    )


def plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 1,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    carry: bool = False,
) -> DataFrame:
    """What the mix takes of each row of ``docs``.

    Result: ``doc_id, size, source_size, target, taken`` and the geometry behind ``taken``: the
    row's words stand at [``at``, ``at + size``) of its shard, the mix takes ``rounds`` copies of
    the whole shard, and of the words in [``lo1``, ``hi1``) and [0, ``hi2``) one copy more. With
    ``carry`` the row itself is in ``row``.

    Sizes count words; null and empty texts have none, and nothing is taken of them. Sources go by
    code point, null last as a source of its own. Rows equal in id, source and text may differ in
    ``taken`` among themselves, but the set of results is the same in every run. Texts of any
    length are counted whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = stored(sized(docs, doc_id, text, source, seed, False), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(water_filled(sources, weights, max_repeats), "mix-targets")
    # Quotas are computed, not listed: many blocks cost no more than few.
    smallest = targets.agg(F.min(F.nullif("source_size", F.lit(0)))).first()[0]
    block = max(1, min((smallest or 0) // BLOCKS_PER_SOURCE, block_words))

    shards = (
        in_shards(rows, targets, shard_words)
        .groupBy("source_no", "shard")
        .agg(F.sum("size").alias("words"))
    )
    blocks = F.greatest(F.round(F.col("words") / block), F.least(F.col("words"), F.lit(1)))
    shards = stored(shards.withColumn("blocks", blocks.cast("long")), "mix-shards")
    owned = shards.groupBy("source_no").agg(F.sum("blocks").alias("owned"))
    everything = F.round(F.col("total") / block).cast("long")
    parties = targets.join(owned, "source_no").withColumn("all", everything)
    by_source = apportioned(
        parties, "target", "all", max_repeats * F.col("owned"), [], "source_no"
    ).select("source_no", "source_size", "target", F.col("won").alias("quota"))
    by_shard = apportioned(
        shards.join(stored(by_source, "mix-quotas"), "source_no"),
        "blocks", "quota", max_repeats * F.col("blocks"), ["source_no"], "shard",
    )
    n = F.greatest("blocks", F.lit(1))
    last = F.col("first") + F.pmod("won", n)
    edge = lambda k: F.floor(k * F.col("words") / n)
    quotas = by_shard.withColumn(
        "first", F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), n)
    ).select(
        "source_no", "shard", "source_size", "target",
        F.floor(F.col("won") / n).alias("rounds"),
        edge(F.col("first")).alias("lo1"),
        edge(F.least(last, n)).alias("hi1"),
        edge(F.greatest(last - n, F.lit(0))).alias("hi2"),
    )

    full = sized(docs, doc_id, text, source, seed, True) if carry else rows
    shard = W.partitionBy("source_no", "shard").orderBy("order_", "doc_id")
    before = F.sum("size").over(shard.rowsBetween(W.unboundedPreceding, -1))
    end = F.col("at") + F.col("size")
    more = overlap(F.col("at"), end, F.col("lo1"), F.col("hi1")) + overlap(
        F.col("at"), end, F.lit(0), F.col("hi2")
    )
    return (
        in_shards(full, targets, shard_words)
        .withColumn("at", F.coalesce(before, F.lit(0)))
        .join(quotas, ["source_no", "shard"])
        .select(
            *["row"] * carry, "doc_id", "size", "source_size", "target",
            (F.col("size") * F.col("rounds") + more).cast("long").alias("taken"),
            "at", "rounds", "lo1", "hi1", "hi2",
        )
    )


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as all its words are taken,
    and where only some are taken once more, a row with these words and the white space after them.

    Rows of which nothing is taken are gone. ``options`` and odd rows are as in ``plan``.
    """
    cuts = plan(docs, doc_id, text, source, carry=True, **options)
    whole = F.col(f"row.`{text}`")
    more = F.col("taken") - F.col("size") * F.col("rounds")
    word = lambda i: F.col("at") + i
    taken = lambda i: (
        (word(i) >= F.col("lo1")) & (word(i) < F.col("hi1"))
    ) | (word(i) < F.col("hi2"))
    pieces = F.regexp_extract_all(whole, F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    part = F.rtrim(F.array_join(F.filter(pieces, lambda _, i: taken(i)), ""))
    texts = F.concat(
        F.array_repeat(whole, F.when(F.col("taken") > 0, F.col("rounds")).otherwise(0).cast("int")),
        F.when(more <= 0, F.array().cast("array<string>"))
        .when(more == F.col("size"), F.array(whole))
        .otherwise(F.array(part)),
    )
    return cuts.select(
        F.inline(
            F.transform(
                texts,
                lambda t: F.struct(
                    *[(t if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
                ),
            )
        )
    )
