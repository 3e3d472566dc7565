"""Hard negatives by slot-decomposed selection.

An anchor has up to ``n_positives`` positives, its nearest rows of the same label. For each of them the
nearest rows of other labels are wanted whose score lies in a window that ends at the positive's. The
windows of an anchor overlap; their upper limits, the positives' scores, cut the scores into disjoint
slots, slot ``i`` from the limit of positive ``i + 1`` (excluded) up to that of positive ``i``. A row of another
label falls into one slot. Tasks keep the best ``k`` rows a slot, and so does every merge, so
nothing larger than ``k`` a slot travels. The best ``k`` of the window of positive ``i`` are then among
those of its slot and the lower ones: the slots are taken from the lowest up, each put in front of the
merge of those below, cut to ``k``.

The anchors are a stated query set against all rows. Both sides are packed into blocks of vectors, and
each block of rows meets each block of anchors once, as one matrix product; no pair of rows is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.shared import stored

SCALE = 256
ANCHOR_EVERY = 100
N_POSITIVES = 5
N_NEGATIVES = 5
LOWER_PCT = 80
#: Numbers in a block of rows, and in one of anchors, at most (2 MB and 0.5 MB).
ROW_BLOCK, ANCHOR_BLOCK = 1 << 18, 1 << 16
#: Groups of blocks of rows, each of which meets the anchors in tasks of its own.
GROUPS = 64
LEAST, MOST = np.iinfo("i8").min, np.iinfo("i8").max
#: A product of smaller numbers than this is exact in doubles.
EXACT = 2.0**52
#: Blocks of anchors that the same tasks work on.
TOGETHER = 16
#: Rows that a task holds before it merges them.
HELD = 1 << 16


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The components as whole numbers, ``floor(scale * x)``; null if there is none, or one is null or
    not finite."""
    known = F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    )
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(known, numbers)


def swapped_label(vec_id: Column, label: Column) -> Column:
    """The label that counts: every seventh row has the next one."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def blocks(rows: DataFrame, numbers: int) -> DataFrame:
    """``rows`` (``id, label, vector`` and maybe ``limits``) packed into blocks of at most ``numbers``
    numbers, or one row.

    Ids and labels are 64-bit, vectors and limits matrices of 64-bit integers, filled up with zeros
    and with the least number where a row has fewer.
    """
    lists = [c for c in ("vector", "limits") if c in rows.columns]

    def matrix(column: pa.Array, fill: int) -> list[pa.Array]:
        sizes = np.diff(column.offsets.to_numpy())
        wide = max(1, int(sizes.max()))
        full = np.full((len(sizes), wide), fill, "<i8")
        full[np.arange(wide) < sizes[:, None]] = column.flatten().to_numpy()
        return [pa.array([full.tobytes()], pa.binary()), pa.array([wide], pa.int32())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                widest = max(1, int(np.diff(batch["vector"].offsets.to_numpy()).max()))
                part = batch.slice(at, max(1, numbers // widest))
                columns = [pa.array([number], pa.int64())]
                for c in ("id", "label"):
                    columns.append(pa.array([part[c].to_numpy().tobytes()], pa.binary()))
                for c, fill in zip(lists, (0, LEAST)):
                    columns += matrix(part[c], fill)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at, number = at + part.num_rows, number + 1

    names = ["block", "ids", "labels"] + [n for c in lists for n in (c, f"{c}_dim")]
    kinds = ["long", "binary", "binary"] + ["binary", "int"] * len(lists)
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return rows.select("id", "label", *lists).mapInArrow(pack, schema)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of two matrices of whole numbers; missing components count as 0."""
    dim = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :dim], rows[:, :dim]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim
    if most < EXACT:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    return a @ b.T


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by falling score, ties by rising id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def few(slot: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where a score is among the ``k`` best of its row and slot, or ties with the last of them."""
    inside = slot >= 0
    n_slots = int(slot.max(initial=-1)) + 1
    if k >= slot.shape[1] or np.count_nonzero(inside) <= 8 * k * len(slot) * n_slots:
        return inside
    for x in range(n_slots):
        here = slot == x
        own = np.where(here, score, LEAST)
        own.partition(own.shape[1] - k, axis=1)
        inside &= ~here | (score >= own[:, -k, None])
    return inside


def least_score(limit: np.ndarray, pct: int) -> np.ndarray:
    """The least whole number ``s`` with ``pct * limit <= 100 * s``."""
    hundreds, rest = np.divmod(limit, 100)
    return hundreds * pct - (-(rest * pct) // 100)


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of rows. Both are dealt out on a grid: a block of rows is
    in one group and goes to every band of anchors, a block of anchors is in one band and goes to
    every group; they meet by an equi-join on (band, group)."""
    bands = -(-anchors.count() // TOGETHER)
    groups = max(1, min(GROUPS, rows.count()))
    row = rows.select(
        F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), "ids", "labels", "vector", "vector_dim",
        F.explode(F.expr(f"sequence(0L, {max(0, bands - 1)}L)")).alias("band"),
    )
    anchor = anchors.select(
        F.pmod(F.xxhash64("block"), F.lit(max(1, bands))).alias("band"),
        F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("group"),
        *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"],
    )
    return row.join(anchor, ["band", "group"]).drop("band", "group")


def _kept(met: DataFrame, k: int, slots) -> DataFrame:
    """The best ``k`` rows of each (anchor, slot) of the pairs of blocks that a task is given.

    ``slots(pair, scores, same, other)`` gives the slot of each score, below 0 for none; ``same`` and
    ``other`` tell whether the labels and the ids are equal and different.
    """

    def merged(held: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(held, axis=1)
        _, anchor = np.unique(rows[0], return_inverse=True)
        group = anchor * (rows[1].max(initial=0) + 1) + rows[1]
        return rows[:, best(group, rows[2], rows[3], k)]

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(x)) for x in rows], names=["anchor", "slot", "score", "id"]
        )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for n in range(batch.num_rows):
                pair = {c: batch[c][n].as_py() for c in batch.schema.names}
                a_ids, a_labels, ids, labels = (
                    np.frombuffer(pair[c], "<i8") for c in ("a_ids", "a_labels", "ids", "labels")
                )
                s = scores(
                    _matrix(pair["a_vector"], pair["a_vector_dim"]),
                    _matrix(pair["vector"], pair["vector_dim"]),
                )
                slot = slots(pair, s, a_labels[:, None] == labels, a_ids[:, None] != ids)
                i, j = np.nonzero(few(slot, s, k))
                top = best(i * (int(slot.max(initial=0)) + 1) + slot[i, j], s[i, j], ids[j], k)
                i, j = i[top], j[top]
                held.append(np.stack([a_ids[i], slot[i, j].astype("<i8"), s[i, j], ids[j]]))
                if sum(x.shape[1] for x in held) > HELD:
                    held = [merged(held)]
                    if held[0].shape[1] > HELD // 2:  # more anchors than a task holds
                        yield out(held.pop())
        if held:
            yield out(merged(held))

    return met.mapInArrow(keep, "anchor long, slot long, score long, id long")


def _first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best ``k`` rows of each key; ``rank`` counts from 1."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchors: Column,
    n_positives: int = N_POSITIVES,
    n_negatives: int = N_NEGATIVES,
    lower_pct: int = LOWER_PCT,
) -> DataFrame:
    """Hard negatives of the ``rows`` (``id, label, vector`` of whole numbers) that ``anchors`` picks.

    Result: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Scores are
    inner products, higher first, ties by smaller id. Positives are the first ``n_positives`` rows of the
    anchor's label with another id; the negatives of a positive with score ``p`` are the first
    ``n_negatives`` rows of other labels with ``lower_pct * p <= 100 * score <= 100 * p``. A window
    without rows, and thus one of a negative score, gives no row. An anchor has an id: of rows that
    share one, that with the smallest label and then vector asks. As answers, rows that are there twice
    count twice, each with a rank of its own. An empty table gives no rows.
    """
    if not 0 < lower_pct <= 100:
        raise ValueError("lower_pct is a percentage above 0")
    table = stored(blocks(rows, ROW_BLOCK), "rows")
    one = rows.filter(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    asked = stored(one.select("id", "r.label", "r.vector"), "anchors")

    def same_label(pair, s, same, other):
        return np.where(same & other, 0, -1)

    met = _met(stored(blocks(asked, ANCHOR_BLOCK), "anchor-blocks"), table)
    positives = stored(
        _first(_kept(met, n_positives, same_label), n_positives, "anchor"), "positives"
    )
    limits = positives.groupBy("anchor").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]
        ).alias("limits")
    )

    def slots(pair, s, same, other):
        """The last positive whose score is not below; none where every window ends above."""
        upper = _matrix(pair["a_limits"], pair["a_limits_dim"])
        slot = np.full(s.shape, -1, "i2")
        for limit in upper.T:
            slot += s <= limit[:, None]
        reach = least_score(np.where(upper >= 0, upper, MOST).min(axis=1), lower_pct)
        slot[same | (s < reach[:, None])] = -1
        return slot

    limited = asked.join(limits, asked["id"] == limits["anchor"]).drop("anchor")
    packed = stored(blocks(limited, ANCHOR_BLOCK), "anchor-limits")
    found = _first(_kept(_met(packed, table), n_negatives, slots), n_negatives, "anchor", "slot")
    by_slot = found.groupBy("anchor").agg(
        F.sort_array(
            F.collect_list(F.struct("slot", F.negative("score").alias("falling"), "id"))
        ).alias("found")
    )
    # Lower slots have lower scores, so a list by slot is by falling score too: what follows the start
    # of a slot is that slot in front of the merge of those below.
    window = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("rank") - 1), 1, n_negatives)
    near = F.filter(window, lambda x: F.col("score") * lower_pct <= -x["falling"] * 100)
    rows = positives.join(by_slot, "anchor").select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.posexplode(near).alias("place", "negative"),
    )
    return rows.select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("place") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"), "positive_score",
        (-F.col("negative.falling")).alias("negative_score"),
    )


def mine_embeddings(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``mine`` for a table of embeddings: every hundredth id is an anchor.

    Rows with a null id, a null label, a null vector, or a component that is null or not finite take no
    part. Components become ``floor(256 * x)``; where the id is divisible by 7, the label is first moved
    on by one (of ten). Vectors of different lengths meet in their common components. Other columns are
    ignored.
    """
    i, y = F.col(f"`{vec_id}`").cast("long"), F.col(f"`{label}`").cast("long")
    rows = table.select(
        i.alias("id"), swapped_label(i, y).alias("label"), whole(F.col(f"`{vector}`")).alias("vector")
    ).dropna()
    return mine(rows, F.col("id") % ANCHOR_EVERY == 0)
