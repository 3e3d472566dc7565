"""Repeated runs of lines, found by winnowing over line hashes.

A window is the shortest stretch of lines with words, from some line on, that has ``MIN_WORDS`` words.
Each window selects its smallest line hash (the last of equals) as a fingerprint, so two equal runs of
that many words are sure to share one at the same place. Windows whose fingerprint occurs once in the
corpus are done. The others are looked at with each stretch that starts where they do and ends before
the next line's window does. Any run is a union of windows and such a stretch at its end, and each of
these has an equal one wherever the run has, so a stretch is deleted if it is not the first of its
content: all earlier places count, without a comparison of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.llm.shared import stored, text_of

MIN_WORDS = 50


def line_numbers(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of words and place of each line that has words."""
    hashes, words, places = [], [], []
    for place, line in enumerate(text.encode().split(b"\n")):
        n = len(line.split())  # bytes split at the same white space as words do
        if n:
            hashes.append(xxhash.xxh3_64_intdigest(line))
            words.append(n)
            places.append(place)
    return np.array(hashes, "u8"), np.array(words, "i4"), np.array(places, "i4")


def window_ends(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each first line the line after its window; only lines that have a window."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + min_words)
    return ends[ends <= len(words)]


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each window the line that it selects: the last of its smallest hashes."""
    chosen = np.empty(len(ends), np.int64)
    queue: list[int] = []  # lines of the window that may be selected, hashes rising
    head = line = 0
    for start, end in enumerate(ends.tolist()):
        while line < end:
            while len(queue) > head and hashes[queue[-1]] >= hashes[line]:
                queue.pop()
            queue.append(line)
            line += 1
        while queue[head] < start:
            head += 1
        chosen[start] = queue[head]
    return chosen


def stretch_ends(ends: np.ndarray, n_lines: int) -> list[range]:
    """For each window where the stretches from its first line on end: with the window itself, and after
    each line up to where the next line's window is at hand; the last window's reach the last line."""
    after = np.maximum(np.append(ends[1:], n_lines + 1), ends + 1)
    return [range(a, b) for a, b in zip(ends.tolist(), after.tolist())]


def read_lines(rows: DataFrame) -> DataFrame:
    """``rows`` (``row``, ``text``) with their lines as arrays of numbers, and no text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [line_numbers(t) for t in batch["text"].to_pylist()]
            columns = [pa.array([x[i].tobytes() for x in lines], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], *columns], names=["row", "hashes", "words", "places"]
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(
        read, f"row {kind}, hashes binary, words binary, places binary"
    )


def select_fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """``mark``: a row for each line that a window selects."""

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.empty(0, "i8")]
            for h, w in zip(batch["hashes"], batch["words"]):
                hashes = np.frombuffer(h, "u8")
                ends = window_ends(np.frombuffer(w, "i4"), min_words)
                lines = np.unique(fingerprints(hashes, ends))
                found.append(hashes[lines].astype("i8"))
            yield pd.DataFrame({"mark": np.concatenate(found)})

    return lines.select("hashes", "words").mapInPandas(select, "mark long")


def cut_stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """All windows and their longer stretches: the window's ``mark``, ``content`` (128-bit hash of the
    lines), ``row``, ``at`` and ``end`` (lines with words). At most two for each line."""
    kind = lines.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            of = []
            for i, (h, w) in enumerate(
                zip(batch["hashes"].to_pylist(), batch["words"].to_pylist())
            ):
                hashes, words = np.frombuffer(h, "u8"), np.frombuffer(w, "i4")
                ends = window_ends(words, min_words)
                marks = hashes[fingerprints(hashes, ends)].astype("i8").tolist()
                for start, stretches in enumerate(stretch_ends(ends, len(words))):
                    for end in stretches:
                        content = xxhash.xxh3_128_digest(h[8 * start : 8 * end])
                        for column, value in zip(columns, (marks[start], content, start, end)):
                            column.append(value)
                        of.append(i)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch["row"].take(pa.array(of, pa.int32())), *arrays],
                names=["row", "mark", "content", "at", "end"],
            )

    return lines.select("row", "hashes", "words").mapInArrow(
        cut, f"row {kind}, mark long, content binary, at int, end int"
    )


def merged(ranges: list, limit: int) -> np.ndarray:
    """Marks of the lines inside the ranges."""
    edges = np.zeros(limit + 1, np.int64)
    pairs = np.array(ranges, np.int64).reshape(-1, 2)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, pairs[:, 1], -1)
    return np.cumsum(edges)[:limit] > 0


def repeated_lines(docs_rows: DataFrame, min_words: int) -> DataFrame:
    """``row, n_lines, gone``: rows that lose lines, and the places of these lines."""
    lines = stored(read_lines(docs_rows).dropDuplicates(["row"]), "lines")
    marks = select_fingerprints(lines, min_words)
    repeated = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    stretches = cut_stretches(lines, min_words).join(repeated.select("mark"), "mark", "left_semi")
    stretches = stored(stretches.drop("mark"), "line-stretches")
    first = stretches.groupBy("content").agg(
        F.min(F.struct("row", "at")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    later = (
        stretches.join(first.filter("n > 1").drop("n"), "content")
        .filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
        .select("row", F.col("at").alias("start"), "end")
    )
    runs = later.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("runs"))

    @F.pandas_udf("array<int>")
    def gone(places: pd.Series, runs: pd.Series) -> pd.Series:
        found = []
        for p, r in zip(places, runs):
            at = np.frombuffer(p, "i4")
            found.append(at[merged([(x["start"], x["end"]) for x in r], len(at))])
        return pd.Series(found)

    return runs.join(lines.select("row", "places"), "row").select(
        "row", gone("places", "runs").alias("gone")
    )


@F.pandas_udf(T.StringType())
def without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Each text without the lines at these places; null where there are none."""
    left = []
    for t, places in zip(text, gone):
        if places is None or t is None:
            left.append(None)
            continue
        drop = set(places.tolist() if hasattr(places, "tolist") else places)
        left.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
    return pd.Series(left, dtype=object)


def drop_repeated_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` with its columns, where the text has lost the runs of lines that an earlier place has.

    Places are ordered by id (null last), then by text hash, then by line. A run is a stretch of equal
    whole lines with ``min_words`` words at least; lines without words neither match nor part a run,
    and stay. Each run that has an equal one at any earlier place goes whole. So a line repeated in a
    stretch keeps its first place, and shorter repeats such as a lone short line stay everywhere.

    ``removed`` names an added column with the number of deleted lines. Null texts stay null, empty
    ones empty; a text that is all repeated becomes empty. Rows equal in id and text are one
    place and are changed alike. Long texts are searched whole. An empty table gives an empty one.
    Other columns pass unchanged, whatever their names.
    """
    t = text_of(text)
    row = F.struct(
        F.col(f"`{doc_id}`").isNull().alias("none"),
        F.col(f"`{doc_id}`").alias("id"),
        F.xxhash64(t).alias("hash"),
    )
    rows = docs.select(row.alias("row"), t.alias("text"))
    gone = stored(repeated_lines(rows, min_words), "lines-gone")
    packed = docs.select(F.struct("*").alias("all"), row.alias("row"))
    # Merged at every size: the rows to change grow with the table. Structs that hold a null are equal.
    found = packed.join(gone.hint("merge"), "row", "left")
    whole = F.col(f"all.`{text}`")
    touched = F.when(F.col("gone").isNotNull(), whole)
    cleaned = F.coalesce(without(touched, "gone"), whole)
    columns = [
        (cleaned if c == text else F.col(f"all.`{c}`")).alias(c) for c in docs.columns
    ]
    if removed:
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed))
    return found.select(*columns)
