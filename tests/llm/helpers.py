"""Odd documents, and the operators' results worked out row by row."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside.
CLASHING = ["row", "all", "node", "label", "key", "kept", "size", "gone", "text_", "at", "doc"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """(id, text, lang, source): nulls, empty and blank texts, ties, repeats, a very long text."""
    rng = random.Random(5)
    base = "\n".join(sentence(rng, 30) for _ in range(8))
    near = base.replace("\n", " changed \n", 1)
    rows = [
        (1, base, "aa", "s1"),
        (2, near, "aa", "s1"),
        (3, base.upper(), "aa", "s2"),
        (4, base, "aa", None),
        (4, base, "aa", None),
        (5, None, "aa", "s1"),
        (6, "", "bb", "s2"),
        (7, " \t\n\x0b\f\r ", None, "s3"),
        (8, "only four words here", "bb", "s2"),
        (9, "Only Four words here", "bb", ""),
        (10, sentence(rng, 20_000), "bb", "s1"),
        (None, base, "aa", "s1"),
        (None, None, None, None),
        (None, "text without an id " + sentence(rng, 40), "bb", "s2"),
        (11, "line one is here\n" * 60, "aa", "s1"),
        (12, "x", "aa", "s1"),
        (13, "été 日本語 \U0001f600 İstanbul ΣΑΣ don't 12 <|endoftext|>", "bb", "s3"),
    ]
    for i in range(14, 60):
        rows.append((i, "\n".join(sentence(rng, rng.randint(5, 60)) for _ in range(4)), "aa", f"s{i % 4}"))
    rows += [(60 + i, near.replace("w1", f"v{i}", 1), "aa", "s1") for i in range(12)]
    return rows


def frame(spark, rows: list[tuple]):
    full = [
        (*r, None if r[1] is None else len(r[1]), *[f"{c}-{r[0]}" for c in CLASHING]) for r in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(ascii_lower(text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def rows_of(df, *columns: str) -> list[tuple]:
    """The rows, in an order that does not depend on types."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
