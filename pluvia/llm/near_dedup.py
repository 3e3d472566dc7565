"""Near duplicates by MinHash with min-max signatures.

A document is its set of word shingles; documents with equal sets are one node. Each hash function
gives a node two values, its smallest and its largest shingle, so half the functions do. Bands of these
values are bucket keys. In a bucket all nodes are compared with one of them, its hub: the node whose
buckets are the fullest, as the original of many copies is. Confirmed links make components; where a
bucket still holds several, its nodes go through an exact prefix join that compares all pairs of
different components that can reach the threshold. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm import shingles as sh
from pluvia.llm.components import components
from pluvia.llm.shared import stored, text_of

THRESHOLD_PCT = 85
#: 26 bands of 5 values: a pair at 0.85 shares no bucket with probability 2.4e-7, one at 0.80 with 3.3e-5.
BANDS, ROWS = 26, 5
FUNCTIONS = BANDS * ROWS // 2
#: Bytes of text hashed at once.
STEP = 1 << 20
_RANDOM = np.random.default_rng(19470317)
FACTORS = _RANDOM.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _RANDOM.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64)
FOLDS = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min and max of each set under each function: sets x ``2 * FUNCTIONS``. No set is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = np.empty((len(sets), 2 * FUNCTIONS), np.uint64)
    for j in range(FUNCTIONS):
        x = flat * FACTORS[j] + SHIFTS[j]
        values[:, 2 * j] = np.minimum.reduceat(x, starts)
        values[:, 2 * j + 1] = np.maximum.reduceat(x, starts)
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band. A band takes values that lie ``BANDS`` apart, so that the smallest and
    the largest under one function, which depend on each other, are in different bands."""
    keys = np.zeros((len(values), BANDS), np.uint64)
    for r in range(ROWS):
        keys += values[:, r * BANDS : (r + 1) * BANDS] * FOLDS[r]
    keys += np.arange(BANDS, dtype=np.uint64)
    return sh.mixed(keys)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``STEP`` bytes."""
    size = start = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size > STEP or i == len(texts):
            yield start, i
            size, start = 0, i


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` (``row``, ``text``) as ``row, node, n_shingles, bands``; the node of an empty set is
    null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"].to_pylist()]
            for a, b in slices(texts):
                sets = sh.shingle_sets(texts[a:b])
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full)).astype("i8") if full else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row"].slice(a, b - a),
                        pa.array([sh.digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(list(map(len, sets)), pa.int64()),
                        pa.array(
                            [next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())
                        ),
                    ],
                    names=["row", "node", "n_shingles", "bands"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        sign, f"row {kind}, node binary, n_shingles long, bands array<bigint>"
    )


def shingled(rows: DataFrame) -> DataFrame:
    """``rows`` (``node``, ``text``) as ``node, n, shingles``: sorted hashes, 8 bytes each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            for a, b in slices(texts):
                sets = sh.shingle_sets(texts[a:b])
                yield pd.DataFrame(
                    {
                        "node": batch["node"].iloc[a:b],
                        "n": [len(s) for s in sets],
                        "shingles": [s.tobytes() for s in sets],
                    }
                )

    return rows.select("node", "text").mapInPandas(cut, "node binary, n long, shingles binary")


def can_reach(n1: Column, n2: Column, pct: int) -> Column:
    """Whether sets of these sizes can be as similar as that."""
    return 100 * F.least(n1, n2) >= pct * F.greatest(n1, n2)


def confirmed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full ``sets`` (node, n, shingles) are similar enough."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
            n = sh.common(x, y)
            found.append(100 * n >= pct * (len(x) + len(y) - n))
        return pd.Series(found, dtype=bool)

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").filter(similar("x", "y")).select("a", "b")


def hub_pairs(buckets: DataFrame, pct: int) -> DataFrame:
    """Each node of ``buckets`` (``key, node, n``; two nodes at least in a bucket) with its hubs."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weights = buckets.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = buckets.join(weights, "node")
    hubs = weighted.groupBy("key").agg(
        F.max(F.struct("weight", F.col("node").alias("b"), F.col("n").alias("m"))).alias("hub")
    )
    pairs = buckets.join(hubs, "key").select(F.col("node").alias("a"), "n", "hub.b", "hub.m")
    return (
        pairs.filter((F.col("a") != F.col("b")) & can_reach(F.col("n"), F.col("m"), pct))
        .select("a", "b")
        .distinct()
    )


def prefix_pairs(sets: DataFrame, pct: int) -> DataFrame:
    """Pairs of nodes with different labels that can be similar, from ``sets`` (node, label, n,
    shingles).

    Sets of n and m shingles that similar have at least a = ceil(pct (n + m) / (100 + pct)) in common,
    so in any order common to all, their first common shingle is among the first n - a + 1 of the one
    and m - a + 1 of the other. Rare shingles come first, so few nodes meet in one.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, data in zip(batch["node"], batch["shingles"]):
                hashes = np.frombuffer(data, "i8")
                yield pd.DataFrame({"node": [node] * len(hashes), "shingle": hashes})

    tokens = sets.select("node", "shingles").mapInPandas(split, "node binary, shingle long")
    tokens = stored(tokens, "near-tokens")
    often = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = tokens.join(often, "shingle")
    of = sets.select("node", "label", "n")
    # Shingles of one node alone come first and meet nobody: only their number counts.
    alone = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("node"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("often", "shingle"))
    length = F.col("n") - F.ceil(F.col("n") * pct / 100) + 1
    prefix = (
        shared.join(of, "node")
        .withColumn("rank", alone + rank)
        .filter(F.col("rank") <= length)
        .select("shingle", "node", "label", "n", "rank")
    )
    prefix = stored(prefix, "near-prefixes")
    mixed = (
        prefix.groupBy("shingle")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low != high")
        .select("shingle")
    )
    met = prefix.join(mixed, "shingle")
    left, right = (
        met.select("shingle", *[F.col(c).alias(f"{c}{i}") for c in ("node", "label", "n", "rank")])
        for i in (1, 2)
    )
    common = F.ceil(pct * (F.col("n1") + F.col("n2")) / (100 + pct))
    early = (F.col("rank1") <= F.col("n1") - common + 1) & (
        F.col("rank2") <= F.col("n2") - common + 1
    )
    return (
        left.join(right, "shingle")
        .filter((F.col("label1") < F.col("label2")) & early)
        .select(F.col("node1").alias("a"), F.col("node2").alias("b"))
        .distinct()
    )


def classes(rows: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """``node, label`` of all nodes that have a link. ``rows``: row, text; ``nodes``: node, row,
    n_shingles, bands, one a node."""
    buckets = nodes.select(
        F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n")
    )
    crowded = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = stored(buckets.join(crowded.select("key"), "key"), "near-buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", "row")
    sets = shingled(rows.join(wanted, "row").dropDuplicates(["node"]))
    sets = stored(sets, "near-sets")
    links = stored(confirmed(hub_pairs(buckets, pct), sets, pct), "near-links")
    labels = components(links)

    def labelled(df: DataFrame) -> DataFrame:
        own = F.coalesce("label", "node").alias("label")
        return df.join(labels, "node", "left").select(*df.columns, own)

    open_keys = (
        labelled(buckets)
        .groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low != high")
        .select("key")
    )
    open_nodes = buckets.join(open_keys, "key", "left_semi").select("node").distinct()
    rest = stored(labelled(sets.join(open_nodes, "node", "left_semi")), "near-open")
    more = stored(confirmed(prefix_pairs(rest, pct), sets, pct), "near-links")
    return components(links.union(more))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pct: int = THRESHOLD_PCT
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * common shingles >= ``pct`` * all shingles; ``component_id`` is
    the smallest id that a document reaches by links, itself included, and that document is kept.
    A text of fewer than five words is one shingle; null texts and texts without words have none, are
    linked with nothing and kept. Null ids are never smallest; a component of null ids alone has a
    null id and keeps all. Rows that repeat an id are kept together. Very long texts are compared
    whole. An empty table gives an empty result; other columns are ignored.
    """
    return judged(docs, doc_id, text, pct).drop("row")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pct: int = THRESHOLD_PCT
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    gone = judged(docs, doc_id, text, pct).filter("not kept").select("row").distinct()
    keyed = docs.select(F.struct("*").alias("all"), row_key(doc_id, text).alias("row"))
    # Merged at every size: the rows that go grow with the table.
    return keyed.join(gone.hint("merge"), "row", "left_anti").select("all.*")


def row_key(doc_id: str, text: str) -> Column:
    return F.struct(
        F.xxhash64(F.col(f"`{doc_id}`"), text_of(text)).alias("one"),
        F.hash(F.col(f"`{doc_id}`"), text_of(text)).alias("two"),
    )


def judged(docs: DataFrame, doc_id: str, text: str, pct: int) -> DataFrame:
    """The result of ``near_duplicates`` with the key of each row."""
    rows = docs.select(
        F.struct(F.col(f"`{doc_id}`").alias("doc_id"), row_key(doc_id, text).alias("key")).alias(
            "row"
        ),
        text_of(text).alias("text"),
    )
    signs = stored(signed(rows), "near-signatures").select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.key").alias("row"),
        "node", "n_shingles", "bands",
    )
    nodes = (
        signs.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first"), F.min("row").alias("row"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        )
    )
    nodes = stored(nodes, "near-nodes")
    texts = rows.select(F.col("row.key").alias("row"), "text")
    labels = stored(classes(texts, nodes, pct), "near-classes")
    linked = nodes.select("node", "first").join(labels, "node")
    smallest = linked.groupBy("label").agg(F.min("first").alias("smallest"))
    of_node = linked.join(smallest, "label").select("node", "smallest")
    found = nodes.select("node", "first").join(of_node, "node", "left").select(
        "node", F.coalesce("smallest", "first").alias("smallest")
    )
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("smallest"))
    return (
        signs.join(found, "node", "left")
        .withColumn("component_id", component)
        .select(
            "doc_id", "row", "n_shingles", "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )
