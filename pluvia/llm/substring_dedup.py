"""Repeated passages by matching statistics over suffix automata.

A window of ``n`` words goes if a document with a smaller id has the same words in a row. Reference
shards are parts of documents; each becomes a suffix automaton, and the documents that may share a
passage with it are streamed past it. The automaton gives, for each word, the length of the longest
match that ends there (the matching statistics); where it is ``n`` or more, the words of the match go.

What is streamed past which shard is found by marks: of the ``n - MARK + 1`` runs of ``MARK`` words in
a window the one with the smallest hash is its mark, so equal windows have equal marks. The first
document with a mark is the reference of all others with it. A window that its mark's reference does
not have may still be in a third document; those windows, and only those, go through a second round in
which the window itself is the mark. Hashes only decide where to look: nothing goes that an automaton
has not matched word by word.

Documents with equal words are one document here, the one with the smallest id. Joins are equi-joins
of a shard with its streams, so a shard that a third of all documents share is split by AQE.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.llm import shingles as sh
from pluvia.llm.near_dedup import STEP, slices
from pluvia.llm.shared import stored, text_of

WINDOW = 13
#: Words of a mark.
MARK = 5
#: Words of a reference document that make a shard.
SHARD = 1024
#: States of the automata that a task remembers.
REMEMBERED = 64 * SHARD
BREAK = re.compile(rb"[\x09-\x0D\x20]")
_RANDOM = np.random.default_rng(13)
STEPS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
UNIT = ["doc", "variant", "offset"]
PIECES = (
    "reference boolean, first long, shard long, doc long, variant long, start long, words string"
)
MATCHES = "matched boolean, doc long, variant long, start long, stop long, words string"


class Automaton:
    """The suffix automaton of some runs of words."""

    def __init__(self, runs: list[list[str]]):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for number, run in enumerate(runs):
            last = self._extend(0, number)  # numbers are no words: no match crosses them
            for word in run:
                last = self._extend(last, word)

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, word) -> int:
        follow, link, length = self.next, self.link, self.length
        new = self._state(length[last] + 1, {}, 0)
        while last >= 0 and word not in follow[last]:
            follow[last][word] = new
            last = link[last]
        if last < 0:
            return new
        target = follow[last][word]
        if length[target] == length[last] + 1:
            link[new] = target
            return new
        copy = self._state(length[last] + 1, dict(follow[target]), link[target])
        while last >= 0 and follow[last].get(word) == target:
            follow[last][word] = copy
            last = link[last]
        link[target] = link[new] = copy
        return new

    def statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        follow, link, length = self.next, self.link, self.length
        state = n = 0
        found = []
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                n = length[state]
            if word in follow[state]:
                state = follow[state][word]
                n += 1
            found.append(n)
        return found


def ranges(inside: list[bool]) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch of True."""
    start = None
    for i, x in enumerate(inside):
        if x and start is None:
            start = i
        elif not x and start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(inside)


@functools.lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    both = (int(sh.BASE), pow(int(sh.BASE), -1, 1 << 64))
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in both)
    return up, down


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word. Words that differ in the case of A-Z alone have one hash."""
    letters = np.frombuffer(data, np.uint8)
    up, down = powers(1 << max(20, len(data).bit_length()))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~sh.SPACE[letters]
    starts, ends = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(sh.CODES[letters] * up[: len(data)], out=sums[1:])
    return sh.mixed((sums[ends] - sums[starts]) * down[starts]), starts


def hashed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some short texts or of a long one, and where each text's words end."""
    if len(texts) > 1:
        words, starts = hashed_words(b" ".join(texts))
        return words, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    text, parts, at = texts[0], [np.empty(0, np.uint64)], 0
    while at < len(text):
        cut = BREAK.search(text, at + STEP)
        end = cut.start() if cut else len(text)
        parts.append(hashed_words(text[at:end])[0])
        at = end
    words = np.concatenate(parts)
    return words, np.array([len(words)])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = pick(x[:-step], x[step:]), done + step
    return x


def marks(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each mark of the texts that end at ``ends`` among the hashed ``words``.

    A run of words is a mark if it has the smallest hash of a window, several if they tie.
    """
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.zeros(len(words) - MARK + 1, np.uint64)
    for j in range(MARK):
        grams += words[j : j + len(grams)] * STEPS[j]
    grams = sh.mixed(grams) | np.uint64(1)
    width = n - MARK + 1
    least = sliding(grams, width, np.minimum)
    for end in ends:  # windows that reach into the next text
        least[max(0, end - n + 1) : end] = 0
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    place = np.flatnonzero(sliding(around, width, np.maximum) == grams)
    return grams[place], place


def scanned(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (``doc, same, text``) with at least ``n`` words, as ``doc, same, key, n_words, marks,
    places``: ``key`` is a hash of the sequence of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"].to_pylist()]
            for a, b in slices(texts):
                words, ends = hashed_texts(texts[a:b])
                counts = np.diff(ends, prepend=0)
                found, places = marks(words, ends, n)
                cuts = np.searchsorted(places, np.r_[0, ends])
                places = places - np.repeat(ends - counts, np.diff(cuts))
                lists = [
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))
                    for x in (found.astype("i8"), places)
                ]
                keys = [
                    hashlib.sha256(b" ".join(t.split())).digest() if c >= n else None
                    for t, c in zip(texts[a:b], counts)
                ]
                columns = [
                    batch["doc"].slice(a, b - a), batch["same"].slice(a, b - a),
                    pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), *lists,
                ]
                names = ["doc", "same", "key", "n_words", "marks", "places"]
                rows = pa.RecordBatch.from_arrays(columns, names=names)
                yield rows.filter(pa.array(counts >= n))

    return docs.mapInArrow(
        scan,
        "doc long, same long, key binary, n_words long, marks array<long>, places array<long>",
    )


def routed(marked: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """For each text unit the places of its shared marks, with the shard each belongs to; stored.

    ``marked`` has ``mark, place`` and columns of ``UNIT``, 0 where they are missing; the result
    ``doc, variant, offset, routes``.
    """
    unit = [c for c in UNIT if c in marked.columns]
    shared = marked.groupBy("mark").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"),
        F.min_by("place", "doc").alias("at"),
    )
    shared = shared.filter(F.col("first") < F.col("last")).select(
        "mark", "first", F.expr(f"at div {SHARD}").alias("shard")
    )
    found = marked.join(stored(shared, "passages-marks", release=True), "mark").drop("mark")
    if copies is not None:
        found = found.join(copies, [c for c in unit if c in copies.columns], "left_anti")
    routes = found.groupBy(*unit).agg(
        F.collect_list(F.struct("first", "shard", "place")).alias("routes")
    )
    zeros = {c: F.lit(0).cast("long") for c in UNIT if c not in unit}
    return stored(routes.withColumns(zeros), "passages-routes", release=True)


def pieces(units: DataFrame, routes: DataFrame, n: int, mark: int) -> DataFrame:
    """The parts of the text units (``doc, variant, offset, words``) to be matched, with the shard of
    each: all windows that have the mark, as few runs as they make."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            lists = batch["routes"]
            offsets, places = lists.offsets.to_numpy(), lists.values
            first, shard, place = (places.field(k).to_numpy(False) for k in range(3))
            for i in range(batch.num_rows):
                text = batch["words"][i].as_py().encode()
                doc, variant, base = (batch[c][i].as_py() for c in UNIT)
                words = text.split()
                own = slice(offsets[i], offsets[i + 1])
                p = place[own] - base
                order = np.lexsort((p, shard[own], first[own]))
                runs: dict = OrderedDict()
                for f, s, at in zip(
                    first[own][order].tolist(), shard[own][order].tolist(), p[order].tolist()
                ):
                    low, high = max(0, at - n + mark), min(at, len(words) - n)
                    if low > high:
                        continue
                    kept = runs.setdefault((f, s), [])
                    if kept and low <= kept[-1][1] + 1:
                        kept[-1][1] = max(high, kept[-1][1])
                    else:
                        kept.append([low, high])
                for (f, s), kept in runs.items():
                    cuts = [(low, b" ".join(words[low : high + n]).decode()) for low, high in kept]
                    if f == doc:  # equal runs of a reference count once
                        cuts = [(0, "\n".join(dict.fromkeys(c for _, c in cuts)))]
                    rows += [(f == doc, f, s, doc, variant, base + low, c) for low, c in cuts]
                    size += sum(len(c) for _, c in cuts)
                if size > STEP:
                    yield as_batch(rows, PIECES)
                    rows, size = [], 0
            yield as_batch(rows, PIECES)

    return units.join(routes, UNIT).select(*UNIT, "words", "routes").mapInArrow(cut, PIECES)


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)],
        names=[name for name, _ in fields],
    )


def matched(parts: DataFrame, n: int) -> DataFrame:
    """Streams each piece past the automaton of its shard.

    ``matched`` rows have the words [start, stop) that go; the others a run of windows, with its words,
    that the shard does not have.
    """
    shards = parts.filter("reference").select("first", "shard", F.col("words").alias("runs"))
    streams = parts.filter("not reference").drop("reference")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, Automaton] = OrderedDict()
        held = 0

        def automaton(runs: str) -> Automaton:
            nonlocal held
            if runs in known:
                known.move_to_end(runs)
                return known[runs]
            found = known[runs] = Automaton([r.split(" ") for r in runs.split("\n")])
            held += len(found.link)
            while held > REMEMBERED and len(known) > 1:
                held -= len(known.popitem(last=False)[1].link)
            return found

        for batch in batches:
            rows, size = [], 0
            for doc, variant, start, text, runs in zip(
                *(batch[c].to_pylist() for c in ("doc", "variant", "start", "words", "runs"))
            ):
                words = text.split(" ")
                lengths = automaton(runs).statistics(words)
                gone = [False] * len(words)
                inside = [m >= n for m in lengths]
                for a, b in ranges(inside):
                    low = a - lengths[a] + 1
                    gone[low:b] = [True] * (b - low)
                rows += [(True, doc, variant, start + a, start + b, None) for a, b in ranges(gone)]
                for a, b in ranges([not x for x in inside[n - 1 :]]):
                    left = " ".join(words[a : b + n - 1])
                    rows.append((False, doc, variant, start + a, start + b + n - 1, left))
                    size += len(left)
                if size > STEP:
                    yield as_batch(rows, MATCHES)
                    rows, size = [], 0
            yield as_batch(rows, MATCHES)

    pairs = streams.join(shards, ["first", "shard"])
    return pairs.select("doc", "variant", "start", "words", "runs").mapInArrow(stream, MATCHES)


def windows(units: DataFrame, n: int) -> DataFrame:
    """Each window of the units as a mark of its own: ``doc, variant, offset, mark, place``."""
    schema = "doc long, variant long, offset long, mark binary, place long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, variant, base, text in zip(
                *(batch[c].to_pylist() for c in (*UNIT, "words"))
            ):
                words = text.split(" ")
                for i in range(len(words) - n + 1):
                    digest = xxhash.xxh3_128_digest(" ".join(words[i : i + n]))
                    rows.append((doc, variant, base, digest, base + i))
                    if len(rows) == 50_000:
                        yield as_batch(rows, schema)
                        rows = []
            yield as_batch(rows, schema)

    return units.select(*UNIT, "words").mapInArrow(each, schema)


def repeated(docs: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text"):
    """The words that go, as ``doc, variant, spans`` (lists of start and stop), and a function that
    gives a table with the columns of ``docs`` the columns ``doc`` and ``variant``.

    ``variant`` tells texts apart that share an id; it is 0 where none do.
    """
    if n < MARK:
        raise ValueError(f"a window has at least {MARK} words")

    def named(df: DataFrame) -> DataFrame:
        return df.withColumns({"doc": F.col(f"`{doc_id}`").cast("long"), "same": F.xxhash64(text)})

    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), text_of(text).alias(text))
    rows = named(rows).filter("doc IS NOT NULL")
    scan = stored(scanned(rows.select("doc", "same", F.col(text).alias("text")), n), "passages")
    again = scan.groupBy("doc").agg(
        F.count("*").alias("n"), (F.min("key") != F.max("key")).alias("several")
    )
    again = stored(again.filter("n > 1").drop("n"), "passages-again", release=True)
    several = again.filter("several")
    zero = F.lit(0).cast("long")
    if several.isEmpty():
        key = ["doc"]

        def variants(df):
            return df.withColumn("variant", zero).drop("same")
    else:
        key = ["doc", "variant"]

        def variants(df):
            apart = F.when(F.col("several"), F.col("same")).otherwise(zero)
            return df.join(several, "doc", "left").withColumn("variant", apart).drop("same", "several")

    scan = variants(scan)
    least = scan.groupBy("key").agg(F.min("doc").alias("least"))
    copies = (
        scan.select("doc", "variant", "key", "n_words").join(least, "key")
        .filter("doc > least").select("doc", "variant", "n_words").distinct()
    )
    copies = stored(copies, "passages-copies", release=True)
    marked = scan.select(*key, F.explode(F.arrays_zip("marks", "places")).alias("m")).select(
        *key, F.col("m.marks").alias("mark"), F.col("m.places").alias("place")
    )
    routes = routed(marked, copies.select(*key))
    units = variants(rows).select("doc", "variant", zero.alias("offset"), F.col(text).alias("words"))
    if not again.isEmpty():
        units = units.dropDuplicates(UNIT)
    parts = stored(pieces(units, routes, n, MARK), "passages-parts", release=True)
    found = stored(matched(parts, n), "passages-found", release=True)

    left = found.filter("not matched").select(
        "doc", "variant", F.col("start").alias("offset"), "words"
    )
    rest = stored(pieces(left, routed(windows(left, n)), n, n), "passages-rest", release=True)
    spans = (
        found.unionByName(matched(rest, n)).filter("matched").select("doc", "variant", "start", "stop")
        .unionByName(copies.select("doc", "variant", zero.alias("start"), F.col("n_words").alias("stop")))
    )
    spans = spans.groupBy("doc", "variant").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    )
    return spans, lambda df: variants(named(df))


KEPT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


@F.pandas_udf(KEPT)
def kept_words(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Number of words, number of words that go, and the others joined by one space."""
    rows = []
    for text, gone in zip(texts, spans):
        words, rest, at = text.encode().split(), [], 0
        for start, stop in sorted((x["start"], x["stop"]) for x in (() if gone is None else gone)):
            rest += words[at:start]
            at = max(at, stop)
        rest += words[at:]
        rows.append((len(words), len(words) - len(rest), b" ".join(rest).decode()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "text"])


def drop_repeated(
    docs: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` for each row of ``docs``: the text without the words that
    a window of ``n`` words covers which also starts in a document with a smaller id, one space between
    the words that stay. Windows are judged on the input, not on what is left.

    A null text has no words. Rows without an id have no place in the order: they keep all their words
    and are no reason to drop any. A row that is there twice is judged twice, with one result; texts
    that share an id are judged one by one, and none is earlier than the other. Texts with fewer than
    ``n`` words stay whole. An empty table gives an empty result. Other columns are ignored.
    """
    spans, named = repeated(docs, n, doc_id, text)
    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), text_of(text).alias(text))
    joined = named(rows).join(spans, ["doc", "variant"], "left")
    result = joined.select(F.col(doc_id).alias("doc_id"), kept_words(text, "spans").alias("r"))
    return result.select("doc_id", "r.n_words", "r.n_removed", "r.text")
