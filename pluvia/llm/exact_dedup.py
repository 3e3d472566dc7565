"""Exact duplicates: groups of a 128-bit content hash, confirmed byte by byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.shared import ascii_lower, text_of


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Texts are equal when their bytes agree after lower-casing A-Z. ``keep`` says whether the
    smallest or the largest id of a group stays.

    Result: ``doc_id, keep_id, group_size (long), kept, text_sha256``. Null texts count as empty.
    Null ids never stay while the group has another id; a group of null ids alone has a null
    ``keep_id`` and keeps all of them. Rows that repeat an id and its text share one decision.
    An empty table gives an empty result; other columns of ``docs`` are ignored.

    Only 16-byte keys are shuffled for the search. Texts move for rows of repeated keys alone,
    and equal ones are combined before the shuffle, so a group may hold any share of the rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    best = F.min if keep == "smallest" else F.max
    texts = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), ascii_lower(text_of(text)).alias("norm")
    ).withColumn("key", F.unhex(F.md5("norm")))
    rows = texts.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))
    repeated = rows.groupBy("key").count().filter("count > 1").select("key")
    groups = (
        texts.join(repeated, "key", "left_semi")
        .groupBy("key", "norm")  # compares the bytes: a collision gives two groups
        .agg(best("doc_id").alias("best"), F.count(F.lit(1)).alias("size"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), "best", "size")
    )
    grouped = F.col("size").isNotNull()
    return rows.join(groups, ["key", "text_sha256"], "left").select(
        "doc_id",
        F.when(grouped, F.col("best")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.when(grouped, F.col("doc_id").eqNullSafe(F.col("best"))).otherwise(True).alias("kept"),
        "text_sha256",
    )
