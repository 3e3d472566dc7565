"""A training corpus from ``documents``: quality rules, line dedup, near dedup, source mix, BPE.

Every stage takes an empty table (and gives one), null and empty texts, rows that are there more than
once and further columns of any name, which it passes on; each says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from pluvia.llm.shared import stored, table

VOCABULARY = "word_bpe_49k.json"
#: Shingle sets that are so much alike, in percent, are near duplicates here; op9 alone asks for 85.
NEAR_PCT = 80


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts may have changed, with ``n_chars`` brought up to date."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go, among them those with a null or empty text. Equal rows share their
    verdict."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the runs of lines that an earlier place has; no row goes. Earlier is a smaller id, then
    a place further up; rows without an id come last, rows of equal id and text lose the same lines. A
    null text stays null."""
    return _counted(line_dedup.drop_repeated_runs(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; of equal rows one.
    Texts without words are in no group and stay."""
    return near_dedup.keep_one(docs, pct=NEAR_PCT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, three times at most; a row taken in part has only the words
    taken. Rows without words are not taken. A null source is a source like others; equal rows are
    taken each by itself."""
    return _counted(mixing.mixed(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, their number, and the text that they decode to, in place of its text. A null text
    counts as empty and has no ids."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("source_mix", mix),
    ("bpe", tokens),
]

#: SQL has no tokenizer; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
