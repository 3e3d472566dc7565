"""The queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    html_text,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality_rules,
    substring_dedup,
    token_blocks,
    warc,
    whitening,
)
from pluvia.llm.shared import table

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
END_OF_TEXT = 2

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_identify(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_runs(docs, removed="removed_lines")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(table(spark, sf_dir, "documents"))


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(BYTE_VOCABULARY)
    return token_blocks.store_and_check(docs, path, END_OF_TEXT)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(WORD_VOCABULARY))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


def substring_digests(docs: DataFrame) -> DataFrame:
    rows = substring_dedup.drop_repeated(docs)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits is null here; ``whitening.whiten`` has it as a decimal."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def registry() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_language,
            op2_line_dedup,
            op3_source_mix,
            op4_warc,
            op5_html_text,
            op6_quality_rules,
            op7_token_blocks,
            op8_bpe_round_trip,
            op9_near_dedup,
            op10_exact_dedup,
            op11_hard_negatives,
            op12_substring_dedup,
            op13_whitening,
        )
    }
