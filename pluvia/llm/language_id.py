"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes is counted on a sample. The code length
of a byte is that of its longest known context: -log2 n / (N + D), where D is the number of different
bytes seen after the context; a byte not seen there pays the escape -log2 D / (N + D) and goes on in
the next shorter context, at last with 8 bits. The statistics are frozen, so a byte's code length
depends on the ``ORDER`` bytes before it alone: all trees become one table from strings of
``ORDER + 1`` bytes to a code length in each language, and texts are scored by looking up all their
positions at once. The language of the shortest code wins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.shared import drawn

ORDER = 4
#: Labelled rows of each language from which the trees are counted, about.
SAMPLE_ROWS = 2000
#: Positions scored at once.
STEP = 1 << 20
UNKNOWN = "und"
#: Bytes that stand before each text, so that its first bytes have a context.
PAD = b"\n" * ORDER


def strings_at(data: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order`` on, its byte (lowest) and the ``order`` bytes before it."""
    keys = data[order:].astype(np.uint64)
    for j in range(1, order + 1):
        keys |= data[order - j : len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    return keys


def low_bytes(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * n)) - 1)


class KeyTable:
    """Finds the places of 64-bit keys: a hash table with linear probing, for whole arrays."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.FREE)
        self.places = np.full(1 << bits, -1, np.int32)
        todo, slots = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.keys[slots] == self.FREE
            self.places[slots[free]] = todo[free]  # of several, the last stays
            won = free & (self.places[slots] == todo)
            self.keys[slots[won]] = keys[todo[won]]
            todo, slots = todo[~won], (slots[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.MIX >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slots = self._home(keys)
        held = self.keys[slots]
        places = np.where(held == keys, self.places[slots], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != self.FREE))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            held = self.keys[slots[todo]]
            hit = held == keys[todo]
            places[todo[hit]] = self.places[slots[todo[hit]]]
            todo = todo[~hit & (held != self.FREE)]
        return places


@dataclass
class Level:
    """Strings of k + 1 bytes with their code lengths, contexts of k bytes with their escapes.

    The tables that find them are made where texts are scored and are not sent along.
    """

    strings: np.ndarray  # sorted
    bits: np.ndarray  # strings x languages
    contexts: np.ndarray  # sorted
    escapes: np.ndarray  # contexts x languages

    @functools.cached_property
    def find_string(self) -> KeyTable:
        return KeyTable(self.strings)

    @functools.cached_property
    def find_context(self) -> KeyTable:
        return KeyTable(self.contexts)

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


class ContextTrees:
    """The trees of all languages as tables by level."""

    def __init__(self, languages: list[str], strings: np.ndarray, counts: np.ndarray, order: int):
        """``strings``: distinct strings of ``order + 1`` bytes; ``counts``: strings x languages."""
        self.languages, self.order = languages, order
        self.levels: list[Level] = []
        for k in range(order + 1):
            own, back = np.unique(low_bytes(strings, k + 1), return_inverse=True)
            n = np.zeros((len(own), len(languages)))
            np.add.at(n, back, counts)
            contexts, of = np.unique(own >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(contexts), len(languages)))
            different = np.zeros_like(total)
            np.add.at(total, of, n)
            np.add.at(different, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(n / (total + different)[of])
                escapes = np.where(total > 0, -np.log2(different / (total + different)), 0.0)
            if k:
                below = self.levels[-1]
                shorter = below.bits[np.searchsorted(below.strings, low_bytes(own, k))]
            else:
                shorter = 8.0
            bits = np.where(n > 0, seen, escapes[of] + shorter)
            self.levels.append(
                Level(own, bits.astype(np.float32), contexts, escapes.astype(np.float32))
            )

    def bits_of(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each string's last byte in each language."""
        top = self.levels[-1]
        places = top.find_string.find(keys)
        bits = top.bits[places]
        todo = np.flatnonzero(places < 0)
        bits[todo] = 0
        for k in range(self.order, -1, -1):
            if not len(todo):
                break
            level = self.levels[k]
            own = low_bytes(keys[todo], k + 1)
            places = level.find_string.find(own)
            hit = places >= 0
            bits[todo[hit]] += level.bits[places[hit]]
            todo, own = todo[~hit], own[~hit]
            at = level.find_context.find(own >> np.uint64(8))
            known = at >= 0
            bits[todo[known]] += level.escapes[at[known]]
        bits[todo] += 8
        return bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
        sizes = np.array([len(t) + self.order for t in texts])
        starts = np.cumsum(sizes) - sizes
        total = np.zeros((len(texts), len(self.languages)))
        for at in range(0, max(len(data) - self.order, 0), STEP):
            keys = strings_at(data[at : at + STEP + self.order], self.order)
            bits = self.bits_of(keys)
            # Place p of bits is byte at + p + order; those of a text's padding don't count.
            first = np.searchsorted(starts, at + self.order, "right") - 1
            last = np.searchsorted(starts, at + self.order + len(keys), "left")
            lo = np.clip(starts[first:last] - at, 0, len(keys))
            hi = np.clip(starts[first:last] + sizes[first:last] - self.order - at, 0, len(keys))
            summed = np.vstack([np.zeros(bits.shape[1]), np.cumsum(bits, axis=0, dtype=np.float64)])
            total[first:last] += summed[hi] - summed[lo]
        return total

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of the shortest code, and its share of 2 ** -bits."""
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        behind = bits - bits[np.arange(len(bits)), best][:, None]
        return best, 1 / np.exp2(-np.minimum(behind, 1000)).sum(axis=1)


def prepared(text: Column) -> Column:
    """The text as it is counted and scored: lower case, so that capitals share their statistics."""
    return F.lower(text)


def sample(labelled: DataFrame, rows_per_language: int) -> DataFrame:
    """About so many rows of each language (``lang``, ``text``), chosen by a hash of the row."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows_per_language / n)).otherwise(share)
    return labelled.filter(drawn(F.xxhash64("key", "text"), share))


def fit(labelled: DataFrame, rows_per_language: int = SAMPLE_ROWS, order: int = ORDER) -> ContextTrees:
    """Trees from ``labelled`` (``key``, ``lang``, ``text``), counted where the rows lie.

    The driver gets the counted strings of about ``rows_per_language`` rows of each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                data = np.frombuffer(b"".join(PAD + t.encode() for t in texts), np.uint8)
                if len(data) <= order:
                    continue
                sizes = np.array([len(t.encode()) + order for t in texts])
                starts = (np.cumsum(sizes) - sizes)[:, None] + np.arange(order)
                keep = np.ones(len(data), bool)
                keep[starts.reshape(-1)] = False
                strings, n = np.unique(strings_at(data, order)[keep[order:]], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(strings), "string": strings.astype("i8"), "n": n}
                )

    rows = sample(labelled, rows_per_language).select("lang", prepared(F.col("text")).alias("text"))
    counted = (
        rows.mapInArrow(count, "lang string, string long, n long")
        .groupBy("string", "lang")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counted["lang"].unique())
    strings, at = np.unique(counted["string"].to_numpy().astype(np.uint64), return_inverse=True)
    counts = np.zeros((len(strings), len(languages)))
    counts[at, np.searchsorted(languages, counted["lang"])] = counted["n"]
    return ContextTrees(languages, strings, counts, order)


def identify(
    docs: DataFrame, trees: ContextTrees, text: str = "text", key: Column | None = None
) -> DataFrame:
    """Each row's ``key`` (a struct, as given), ``lang_pred`` and ``score``.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned.
    """
    if not trees.languages:
        return docs.select(
            key.alias("key"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array(model.languages, object)
        for series in batches:
            texts = [(t or "").encode() for t in series]
            parts, size, start = [], 0, 0
            for i, t in enumerate(texts, 1):
                size += len(t)
                if size > STEP or i == len(texts):
                    parts.append(model.predict(texts[start:i]))
                    size, start = 0, i
            best = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, int)
            score = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    t = F.col(f"`{text}`")
    letters = F.coalesce(t.rlike(r"\p{L}"), F.lit(False))
    scored = docs.select(
        key.alias("key"), letters.alias("letters"), predict(prepared(t)).alias("p")
    )
    return scored.select(
        "key",
        F.when(F.col("letters"), F.col("p.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("p.score")).otherwise(0.0).alias("score"),
    )


def learn_and_identify(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = SAMPLE_ROWS,
) -> DataFrame:
    """Learns from the rows of two thirds of the ids and predicts every row.

    Result: ``doc_id, held_out, lang_pred, score``. Held out are rows with crc32(id as text) mod 3 = 1;
    of the others, those with text and language are learned from. A null id counts as empty text.
    ``score`` is the share of the predicted language in the likelihood of all. Ties go to the first
    language in order. Equal texts get equal predictions. Long texts are scored whole. An empty table
    gives an empty result; other columns are ignored.
    """
    crc = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    held = crc % 3 == 1
    labelled = docs.filter(
        ~held & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()
    ).select(
        F.col(f"`{doc_id}`").alias("key"),
        F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{text}`").alias("text"),
    )
    key = F.struct(F.col(f"`{doc_id}`").alias("doc_id"), held.alias("held_out"))
    found = identify(docs, fit(labelled, rows_per_language), text, key)
    return found.select("key.*", "lang_pred", "score")
