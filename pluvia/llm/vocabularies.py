"""Pieces of text and their token ids, for vocabularies of the tokenizers library."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Pieces that a worker remembers; twice as many at most are in memory.
REMEMBERED = 400_000
#: New pieces that are learned together; few enough for a processor's cache.
TOGETHER = 1000
#: Bytes of text whose pieces are counted as different or the same.
STEP = 1 << 22


class Memory(dict):
    """Remembers the values of pieces. Full, it keeps only what is asked for again."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, piece: str):
        value = self.old.pop(piece, None)
        if value is None:
            value = self.compute(piece)
        self[piece] = value
        return value

    def make_room(self) -> None:
        """Called between texts: a full memory becomes the old one, which fades."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


@functools.cache
def _unknown() -> regex.Pattern:
    """Code points that Python's tables don't know; the library's tables may be newer."""
    points = (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


def well_known(text: str) -> bool:
    """Whether Python and the library must agree on the classes of the text's characters."""
    return text.isascii() or max(text) < chr(0x378) or not _unknown().search(text)


class LibraryEncoder:
    """Whole texts encoded by the tokenizers library, each stretch only once while remembered.

    A stretch is white space with what follows up to the next white space, or to a last mark that
    follows a letter: such a mark is a stretch of its own. Byte-level vocabularies split between
    stretches, and inside them the same way wherever these stand, so their ids can be joined. Texts
    with white space beyond ASCII, and files with other steps, go to the library in one piece.

    Arrow cuts some texts at a time, finds their different stretches and puts the ids in place of each;
    only the different ones are looked up one by one.
    """

    SPACES = b" \t\n\x0b\x0c\r"
    MARKS = b".,;:!?"
    OTHER_SPACE = (
        r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    )

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        steps = settings["pre_tokenizer"] or {}
        self.by_stretch = (
            not settings["normalizer"]
            and steps.get("type") == "ByteLevel"
            and steps.get("use_regex")
            and not steps.get("add_prefix_space")
            and not any(
                t["lstrip"] or t["rstrip"] or set(t["content"].encode()) & set(self.SPACES + self.MARKS)
                for t in settings["added_tokens"]
            )
        )
        # Byte-level tokens have a letter for each of their bytes.
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, i in tokens.items():
            self.sizes[i] = len(token)
        # The kinds of bytes: 1 white space, 2 a mark, 4 a letter of ASCII.
        self.kinds = np.zeros(256, np.uint8)
        for kind, of_kind in ((1, self.SPACES), (2, self.MARKS), (4, ascii_letters.encode())):
            self.kinds[list(of_kind)] = kind
        self.known = Memory(self._one)

    def _ids(self, text: bytes) -> np.ndarray:
        found = self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
        return np.array(found, "<u4")

    def _one(self, text: bytes) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, stretches: list[bytes]) -> None:
        """Encodes stretches that begin with white space and end without as one text; they are split
        there as anywhere. Tokens cover the bytes of a text one after the other, so their lengths
        tell to which stretch each belongs."""
        ids = self._ids(b"".join(stretches))
        sizes = np.cumsum(list(map(len, stretches)))
        places = np.searchsorted(np.cumsum(self.sizes[ids]), sizes, "right")
        raw, known, first = ids.tobytes(), self.known, 0
        for stretch, end in zip(stretches, (4 * places).tolist()):
            known[stretch] = raw[first:end]
            first = end

    def _marked(self, stretch: bytes) -> bool:
        """Whether it ends in a mark after a letter beyond ASCII."""
        return (
            stretch[-1] in self.MARKS and stretch[-2] > 127 and stretch[:-1].decode()[-1].isalpha()
        )

    def _know(self, new: list[bytes]) -> None:
        """Remembers these stretches; those that are not remembered from before are learned together."""
        known, old = self.known, self.known.old
        spaces, marks = set(self.SPACES), set(self.MARKS)
        unknown, marked = [], []
        for s in new:
            if s in old or s[0] not in spaces or s[-1] in spaces:
                known[s]  # from before, or the library's own ids
            elif s[-1] in marks and self._marked(s):
                marked.append(s)
            else:
                unknown.append(s)
        for s in {s[:-1] for s in marked}.difference(unknown if marked else ()):
            if s in old:
                known[s]
            elif s not in known:
                unknown.append(s)
        for a in range(0, len(unknown), TOGETHER):
            self._learn(unknown[a : a + TOGETHER])
        for s in marked:
            known[s] = known[s[:-1]] + known[s[-1:]]

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an array of strings without nulls, as little-endian unsigned 32-bit
        integers. About ``STEP`` bytes of text are worked on at once; a longer text is held whole."""
        texts = texts.cast(pa.large_string())
        a, n = 0, len(texts)
        ends = self._offsets(texts)
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + STEP, "right")) - 1)
            yield from self._encode(texts[a:b]).to_pylist()
            a = b

    @staticmethod
    def _offsets(values: pa.Array) -> np.ndarray:
        if not len(values):
            return np.zeros(1, np.int64)
        return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)

    def _starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where stretches start in the bytes of texts that have these ends."""
        kinds = self.kinds[data]
        space = kinds == 1
        first = space.copy()
        first[1:] &= ~space[:-1]
        begins = ends[ends < len(data)]
        first[begins] = True
        marks = np.flatnonzero(kinds == 2)
        marks = marks[(marks > 0) & (kinds[marks - 1] == 4)]
        # a mark that ends a stretch; one that begins a text has no letter before it
        closed = np.append(first, True)[marks + 1]
        first[marks[closed]] = True
        return np.flatnonzero(first)

    def _encode(self, texts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        ends, data = self._offsets(texts), texts.buffers()[2]
        size = int(ends[-1] - ends[0])
        if not self.by_stretch or not size:
            found = map(self._one, texts.cast(pa.large_binary()).to_pylist())
            return pa.array(list(found), pa.large_binary())
        data = data.slice(int(ends[0]), size)
        ends = ends - ends[0]
        starts = self._starts(np.frombuffer(data, "u1"), ends)
        whole = pc.match_substring_regex(texts, self.OTHER_SPACE).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(whole)
        if len(whole):
            text = np.searchsorted(ends, starts, "right") - 1
            starts = starts[~np.isin(text, whole) | (ends[text] == starts)]
        cuts = pa.py_buffer(np.append(starts, size))
        stretches = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, cuts, data])
        stretches = stretches.dictionary_encode()
        different = stretches.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        found = list(map(known.get, different))
        places = np.searchsorted(starts, ends)  # of each text among the stretches
        for k in stretches.indices.take(pa.array(places[whole])).to_pylist():
            found[k] = self._one(different[k])
        new = list(compress(different, map(is_, found, repeat(None))))
        if new:
            self._know(new)
            found = [known[s] if ids is None else ids for s, ids in zip(different, found)]
            known.make_room()
        ids = pa.array(found, pa.large_binary()).take(stretches.indices)
        cuts = pa.py_buffer(self._offsets(ids)[places])
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, cuts, ids.buffers()[2]])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.large_string())))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]
