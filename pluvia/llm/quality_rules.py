"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.shared import SPACES, WORD, let, stored, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PCT = 30


@dataclass(frozen=True)
class Rule:
    """A rule of the cascade. ``rejects`` is true for bad rows and never null."""

    name: str
    rejects: Column


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that the text holds twice or more."""

    def covered(marks: Column) -> Column:
        """Length of the union of windows at the positions of equal neighbours in ``marks``."""
        at = F.transform(
            marks,
            lambda m, i: F.when(
                (m["hash"] == F.get(marks, i - 1)["hash"])
                | (m["hash"] == F.get(marks, i + 1)["hash"]),
                m["at"],
            ),
        )
        return let(
            F.sort_array(F.filter(at, lambda p: p.isNotNull())),
            lambda found: F.aggregate(
                F.transform(
                    found, lambda p, i: F.when(i == 0, window).otherwise(
                        F.least(F.lit(window), p - F.get(found, i - 1))
                    )
                ),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    def hashed(codes: Column) -> Column:
        n = F.size(codes) - window + 1
        return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                lambda i: F.xxhash64(F.slice(codes, i, window)),
            )
        )

    def total(hashes: Column) -> Column:
        return F.when(
            F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")
        ).otherwise(
            let(
                F.sort_array(
                    F.transform(
                        hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))
                    )
                ),
                covered,
            )
        )

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return let(codes, lambda c: let(hashed(c), total))


def features(text: Column) -> dict[str, Column]:
    """The base counts of a text without nulls, all long."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    words = words_of(text)
    longs = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words),
    }
    return {name: value.cast("long") for name, value in longs.items()}


def default_rules(text: str = "text_") -> list[Rule]:
    """The rules after the base. Counts are columns of the row; ``text`` is the text column."""
    t = F.col(text)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    words = F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 2 * words),
        Rule("short_words", F.col("word_chars") < 2 * words),
        Rule("long_words", F.col("word_chars") > 20 * words),
        Rule("capitals", 2 * count(r"\p{Lu}") > count(r"\p{L}")),
        Rule("few_letters", 2 * count(r"\p{L}") < F.col("word_chars")),
        Rule("shouting", 2 * count(r"[!?]") > words),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 50 * (count("\n") + 1)),
    ]


def ranked(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules with their share of rejected rows and seconds on the sample, best ratio first.

    The order changes the cost of a verdict, never the verdict: a row is kept if no rule rejects it.
    """
    if not rules:
        return []

    def seconds(*columns: Column) -> float:
        took = []
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.count(F.lit(1)), *columns).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    share = [F.avg(r.rejects.cast("double")).alias(f"r{i}") for i, r in enumerate(rules)]
    rejected = [x or 0.0 for x in sample.agg(*share).first()]
    scan = seconds(F.max(F.length("text_")))
    costs = [max(seconds(F.sum(r.rejects.cast("int"))) - scan, 1e-3) for r in rules]
    order = sorted(range(len(rules)), key=lambda i: (-rejected[i] / costs[i], i))
    return [(rules[i], rejected[i], costs[i]) for i in order]


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` with the base counts of ``text_``, a column without nulls."""
    return rows.withColumns(features(F.col("text_")))


def judged(rows: DataFrame, rules: list[Rule] | None, sample_rows: int) -> DataFrame:
    """``rows`` (``row``: any struct, ``text_``) with the base counts, ``base_failed``, ``kept``."""
    rules = default_rules() if rules is None else rules
    n = rows.count()
    share = int(min(1.0, sample_rows / max(n, 1)) * 1_000_000)
    chosen = rows.filter(F.pmod(F.xxhash64("row.id", "text_"), F.lit(1_000_000)) < share)
    sample = stored(measured(chosen).drop("row"), "quality-sample")
    verdict = F.when(F.col("base_failed"), False)
    for rule, _, _ in ranked(sample, rules):
        verdict = verdict.when(rule.rejects, False)
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words")
    return (
        measured(rows)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeats)
        .withColumn("kept", verdict.otherwise(True))
    )


def cascade(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: list[Rule] | None = None,
    sample_rows: int = 2000,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the base counts, ``base_failed`` and ``kept``.

    The base rejects texts below 20 words, or with over 30 % of their words in repeated windows of
    eight words. Then the rules run in the order found on a sample of about ``sample_rows`` rows
    (hashed by id and text), and the first that rejects ends the row's cascade.

    Null and empty texts have no words and fail the base. Equal rows get equal verdicts. Long texts
    are counted whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.struct(F.col(f"`{doc_id}`").alias("id")).alias("row"), text_of(text).alias("text_")
    )
    result = judged(rows, rules, sample_rows)
    return result.select(
        F.col("row.id").alias("doc_id"),
        *[c for c in result.columns if c not in ("row", "text_")],
    )


def keep_good(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: list[Rule] | None = None,
    sample_rows: int = 2000,
) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with all their columns, whatever the names."""
    rows = docs.select(
        F.struct(F.col(f"`{doc_id}`").alias("id"), F.struct("*").alias("all")).alias("row"),
        text_of(text).alias("text_"),
    )
    # A row becomes a list of one or none: a filter would be pushed below the counts, which it
    # would then compute once for each mention.
    kept = F.when(F.col("kept"), F.array("row.all"))
    return judged(rows, rules, sample_rows).select(F.inline(kept))
