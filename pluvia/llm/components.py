"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.shared import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` for each node of ``edges`` (``a``, ``b``): the smallest node it can reach.

    In each round a node links its larger neighbours to the smallest node around it, then itself and
    its smaller neighbours. The forest gets flatter until every node hangs on its root; the rounds
    grow with the logarithm of the longest path. Rounds are written tables, so a lost executor costs
    one round at most, and no node's neighbours are gathered: a node's edges may be any number.
    """
    links = _proper(edges.select("a", "b"))
    links = stored(links, "component-links")
    for _ in range(max_rounds):
        large = _star(links.union(links.select("b", "a")), larger=True)
        small = stored(_star(stored(large, "component-large"), larger=False), "component-links")
        if _same(links, small):
            return small.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                small.select("b", "b").distinct()
            )
        links = small
    raise RuntimeError(f"components: not done after {max_rounds} rounds")


def _proper(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with a > b."""
    return (
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b")
        .distinct()
    )


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """``pairs`` (a, b) from a's point of view: its neighbours, larger or smaller, and a itself are
    linked to the smallest of all."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    around = pairs.filter("b > a") if larger else pairs
    linked = around.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        linked = linked.union(least.select("a", F.col("m").alias("b")))
    return _proper(linked)


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two tables of distinct pairs are equal, by count and two sums of hashes."""

    def sums(pairs: DataFrame):
        fold = lambda seed: F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)"))
        return tuple(pairs.agg(F.count(F.lit(1)), fold(1), fold(2)).first())

    return sums(x) == sums(y)
