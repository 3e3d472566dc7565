"""BPE encoding by forced boundaries, and decoding.

Two neighbouring bytes that no token of the vocabulary holds side by side can never be merged: the
text is cut there, each fragment is merged on its own, and the ids are concatenated. Words recur, so a
worker remembers their ids.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pluvia.llm.shared import text_of
from pluvia.llm.vocabularies import Memory, well_known

IDS = "<u4"
#: Words, and stretches without spaces, that a worker remembers; twice as many at most in memory.
REMEMBERED = 150_000
#: Characters of text whose ids and decoded text are held at once; a longer text is held whole.
STEP = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is
    printable Latin-1, else the next letter from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class ForcedBoundaryBpe:
    """A tokenizer file with byte letters, a suffix at word ends, and a pattern that finds words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        model = settings["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        splits = [
            p["pattern"]["Regex"]
            for p in settings["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]
        ]
        kinds = [n["type"] for n in settings["normalizer"]["normalizers"]]
        if len(splits) != 1 or kinds != ["NFC", "Replace", "Lowercase"] or settings["decoder"]:
            raise ValueError(f"{path}: these steps are not supported")
        self.word = regex.compile(splits[0])
        self.added = {t["content"]: t["id"] for t in settings["added_tokens"]}
        if any(t["normalized"] or t["single_word"] for t in settings["added_tokens"]):
            raise ValueError(f"{path}: added tokens must be matched as they are")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        letters = byte_letters()
        # Symbols: bytes 0-255, and 256-511 for a byte that ends a word.
        self.symbols = [vocab[c] for c in letters] + [vocab[c + suffix] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {
            (vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        by_letter = {c: b for b, c in enumerate(letters)}
        self.inside: set[tuple[int, int]] = set()
        for token in vocab:
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            codes = [by_letter[c] for c in (token[: -len(suffix)] if ends else token)]
            codes[-1] += 256 * ends
            self.inside.update(zip(codes, codes[1:]))
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in (vocab | self.added).items():
            self.tokens[i] = token
        self.words = Memory(self._word, REMEMBERED)
        self.chunks = Memory(self._chunk, REMEMBERED)

    def fragments_of(self, word: str) -> list[tuple[int, ...]]:
        """The symbols of a word, cut at the pairs that no token holds."""
        codes = list(word.encode())
        codes[-1] += 256
        found, start = [], 0
        for i in range(1, len(codes)):
            if (codes[i - 1], codes[i]) not in self.inside:
                found.append(tuple(codes[start:i]))
                start = i
        return [*found, tuple(codes[start:])]

    def _merged(self, codes: tuple[int, ...]) -> list[int]:
        """The ids of a fragment: always the merge of lowest rank, the leftmost first."""
        ids = [self.symbols[c] for c in codes]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            hit = merges.get((ids[i], ids[i + 1]))
            if hit:
                heap.append((hit[0], i, hit[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j]), (-1,))[0] != rank:
                continue
            ids[i], ids[j], k = merged, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                hit = merges.get((merged, ids[k]))
                if hit:
                    heapq.heappush(heap, (hit[0], i, hit[1]))
            h = before[i]
            if h >= 0:
                hit = merges.get((ids[h], merged))
                if hit:
                    heapq.heappush(heap, (hit[0], h, hit[1]))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        ids: list[int] = []
        for fragment in self.fragments_of(word):
            ids += self._merged(fragment)
        return np.array(ids, IDS).tobytes()

    def _words_of(self, text: str) -> list[str]:
        if well_known(text):
            normal = unicodedata.normalize("NFC", text)
            # The library lowers each character alone: no final sigma.
            return self.word.findall(normal.replace("Σ", "σ").lower())
        return self.word.findall(self.library.normalizer.normalize_str(text))

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a stretch without spaces; the strings of added tokens are these tokens."""
        parts = []
        for k, segment in enumerate(self.special.split(chunk)):
            if k % 2:
                parts.append(np.array([self.added[segment]], IDS).tobytes())
            elif segment:
                parts += map(self.words.__getitem__, self._words_of(segment))
        return b"".join(parts)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text. Words never cross spaces, so stretches without are encoded."""
        stretches = text.replace("\n", " ").split(" ")
        ids = b"".join(map(self.chunks.__getitem__, stretches))
        self.chunks.make_room()
        self.words.make_room()
        return np.frombuffer(ids, IDS)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens side by side, special ones included: this file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.cache
def load(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` (long), ``ids`` (array of int) and ``decoded``.

    Null texts count as empty: no ids, and an empty decoded text. Columns of ``docs`` with these
    names are replaced; the others pass. Equal texts get equal ids. Long texts are encoded whole. An
    empty table gives an empty one.
    """

    new = ("n_tokens", "ids", "decoded")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *new)]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("others"), text_of(text).alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                ids, decoded, held, end = [], [], 0, start
                while end < batch.num_rows and held < STEP:
                    t = batch["text"][end].as_py()
                    ids.append(bpe.encode(t).astype("i4"))
                    decoded.append(bpe.decode(ids[-1]))
                    held, end = held + len(t), end + 1
                sizes = np.array(list(map(len, ids)))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["others"].slice(start, end - start),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["others", *new],
                )
                start = end

    schema = T.StructType(
        [
            T.StructField("others", rows.schema["others"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    made = rows.mapInArrow(both, schema)
    kept = [F.col(f"others.`{c}`") for c in docs.columns if c not in (text, *new)]
    return made.select(*kept, *new)


def digests(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each row's ``doc_id, n_tokens, ids_sha256, decoded_sha256`` after encoding and decoding.

    Ids and decoded texts stay inside the task. The hashes are those of the ids as little-endian
    unsigned 32-bit integers and of the decoded text in UTF-8, in lower-case hex. Null texts count as
    empty: no ids. Equal rows get equal results. Long texts are encoded whole, a word at a time. An
    empty table gives an empty result; other columns are ignored.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for texts in batches:
            rows = []
            for t in texts:
                ids = bpe.encode(t)
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(ids.tobytes()).hexdigest(),
                        hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), both(text_of(text)).alias("r")
    ).select("doc_id", "r.*")
