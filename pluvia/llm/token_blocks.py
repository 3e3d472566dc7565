"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, block after block of ``BLOCK`` ids. A block stores its
smallest id, the width that covers ``PERCENTILE`` % of its ids less that smallest one, these ids
packed at that width, and a list of exceptions (place, high bits) for the rest. The footer has where
each block starts and, for each document, its id and number of tokens:

    block     min u32, width u8, count u16, exceptions u16, packed u32 words, places u16, highs u32
    footer    block starts i64, document ids i64, token counts i64, null flags u8
    trailer   footer offset i64, blocks i64, documents i64, MAGIC
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.shared import dealt, stored, text_of
from pluvia.llm.vocabularies import LibraryEncoder
from pluvia.session import shared_dir

BLOCK = 32_768
PERCENTILE = 95
MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<IBHH")
TRAILER = struct.Struct("<qqq8s")
#: Ids of a range that is read at once, and ranges that a task reads.
CHUNK = 1 << 20
CHUNKS_A_TASK = 8


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, side by side in 32-bit words; 32 values fill ``width``
    words, the last group is padded with zeros."""
    groups = -(-len(values) // 32)
    if width == 0:
        return np.empty(0, "<u4")
    padded = np.zeros(groups * 32, np.uint64)
    padded[: len(values)] = values
    lanes = np.ascontiguousarray(padded.reshape(groups, 32).T) & np.uint64((1 << width) - 1)
    words = np.zeros((width + 1, groups), np.uint64)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        spread = lanes[j] << np.uint64(shift)
        words[word] |= spread & np.uint64(0xFFFFFFFF)
        words[word + 1] |= spread >> np.uint64(32)
    return np.ascontiguousarray(words[:width].T).astype("<u4").reshape(-1)


def unpack(words: np.ndarray, width: int, count: int) -> np.ndarray:
    """The ``count`` values behind ``pack``."""
    if width == 0:
        return np.zeros(count, np.uint64)
    groups = -(-count // 32)
    columns = np.zeros((width + 1, groups), np.uint64)
    columns[:width] = words.reshape(groups, width).T
    lanes = np.empty((32, groups), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        pair = columns[word] | columns[word + 1] << np.uint64(32)
        lanes[j] = pair >> np.uint64(shift) & mask
    return lanes.T.reshape(-1)[:count]


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to 65,535 ids below 2**32."""
    ids = ids.astype(np.uint64)
    least = ids.min()
    rest = ids - least
    place = max(0, -(-len(rest) * percentile // 100) - 1)
    width = int(np.partition(rest, int(place))[int(place)]).bit_length()
    high = rest >> np.uint64(width)
    places = np.flatnonzero(high)
    head = HEAD.pack(int(least), width, len(ids), len(places))
    return b"".join(
        (
            head,
            pack(rest, width).tobytes(),
            places.astype("<u2").tobytes(),
            high[places].astype("<u4").tobytes(),
        )
    )


def decode_block(data: bytes | memoryview) -> np.ndarray:
    """The ids of a block."""
    least, width, count, n = HEAD.unpack_from(data)
    at = HEAD.size
    size = -(-count // 32) * width
    ids = unpack(np.frombuffer(data, "<u4", size, at), width, count)
    at += 4 * size
    places = np.frombuffer(data, "<u2", n, at)
    ids[places] |= np.frombuffer(data, "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(width)
    return (ids + np.uint64(least)).astype("<u4")


class Writer:
    """Writes one file; documents come in the order in which they are read back."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id or 0, n, doc_id is None))
        self.waiting.append(ids)
        self.n_waiting += n
        self.n_ids += n
        if self.n_waiting >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, everything: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        full = len(ids) if everything else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            block = encode_block(ids[i : min(i + BLOCK, full)])
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.waiting, self.n_waiting = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> int:
        """Writes what is left and the footer; returns the file's size."""
        self._flush(True)
        docs = np.array(self.docs, "<i8").reshape(-1, 3)
        footer = [np.array([*self.starts, self.at], "<i8"), docs[:, 0], docs[:, 1]]
        for column in footer:
            self.out.write(np.ascontiguousarray(column).tobytes())
        self.out.write(docs[:, 2].astype("u1").tobytes())
        self.out.write(TRAILER.pack(self.at, len(self.starts), len(docs), MAGIC))
        return self.at + 8 * (len(self.starts) + 1) + 17 * len(docs) + TRAILER.size


class Reader:
    """Reads a file's footer, and from it any range of its ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, blocks, docs, magic = TRAILER.unpack(self._bytes(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        footer = self._bytes(at, size - TRAILER.size - at)
        self.starts = np.frombuffer(footer, "<i8", blocks + 1)
        self.doc_ids = np.frombuffer(footer, "<i8", docs, 8 * (blocks + 1))
        self.counts = np.frombuffer(footer, "<i8", docs, 8 * (blocks + 1 + docs))
        self.nulls = np.frombuffer(footer, "u1", docs, 8 * (blocks + 1 + 2 * docs)).astype(bool)
        self.ends = np.cumsum(self.counts)

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at the places [start, end) of the file."""
        if end <= start:
            return np.empty(0, "<u4")
        first, last = start // BLOCK, -(-end // BLOCK)
        at = int(self.starts[first])
        data = memoryview(self._bytes(at, int(self.starts[last]) - at))
        cuts = (self.starts[first : last + 1] - at).tolist()
        blocks = [decode_block(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        return np.concatenate(blocks)[start - first * BLOCK : end - first * BLOCK]


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encodes the documents and writes them below ``folder`` in ascending id order.

    Result, stored: a row a file, ``part`` (its number in order), ``path, docs, ids, bytes``. Each
    document is followed by ``end_id``. Null ids come first. Null texts count as empty: only the end
    id. Rows that share an id go by text. Long texts are encoded whole. An empty table gives no file.
    Other columns of ``docs`` are ignored.

    The file of a task that is lost or runs twice has a name of its own: only the files that this
    table names count.
    """

    def to_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode_column
        end = np.array([end_id], "<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        writer = out = None
        for batch in batches:
            if batch.num_rows and writer is None:
                store.create_dir(base)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                out = store.open_output_stream(f"{base}/{name}")
                writer = Writer(out)
            for i, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"])):
                writer.add(i, ids + end)
        if writer:
            size = writer.close()
            out.close()
            row = [part], [f"{folder}/{name}"], [len(writer.docs)], [writer.n_ids], [size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1]), *map(pa.array, row[2:])],
                names=["part", "path", "docs", "ids", "bytes"],
            )

    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text")
    )
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(to_file, "part int, path string, docs long, ids long, bytes long")
    return stored(files, "token-files")


def read(files: DataFrame) -> DataFrame:
    """The documents in the files of ``write``: ``doc_id, start, n_tokens, ids`` (array of int).

    ``start`` counts the ids of all documents before, over all files. Tasks read ranges of about
    ``CHUNK`` ids and own the documents that start in them.
    """
    return _read(files, "ids array<int>", lambda ids: ids.astype("i4"))


def read_checksums(files: DataFrame) -> DataFrame:
    """As ``read``, with the unsigned crc32 of the ids (``ids_crc32``) in place of the ids."""
    return _read(files, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))


def _read(files: DataFrame, field: str, use) -> DataFrame:
    def from_file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base, chunk in zip(batch["path"], batch["base"], batch["chunk"]):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    reader = Reader(source)
                    starts = reader.ends - reader.counts
                    own = slice(*np.searchsorted(starts, [chunk * CHUNK, (chunk + 1) * CHUNK]))
                    if own.start == own.stop:
                        continue
                    first = int(starts[own.start])
                    ids = reader.ids(first, int(reader.ends[own.stop - 1]))
                    numbers = pd.Series(reader.doc_ids[own], dtype="Int64")
                    numbers[reader.nulls[own]] = pd.NA
                    ends = (reader.ends[own] - first).tolist()
                    yield pd.DataFrame(
                        {
                            "doc_id": numbers,
                            "start": starts[own] + base,
                            "n_tokens": reader.counts[own],
                            name: [use(ids[a:b]) for a, b in zip([0, *ends], ends)],
                        }
                    )

    name = field.split()[0]
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    chunks = files.withColumn(
        "base", F.coalesce(F.sum("ids").over(before), F.lit(0))
    ).select(
        "path", "base",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("ids") / CHUNK))).alias("chunk"),
    )
    n = files.agg(F.sum(F.floor(F.col("ids") / CHUNK) + 1)).first()[0] or 0
    spread = dealt(chunks, n, CHUNKS_A_TASK, "path", "chunk")
    return spread.mapInPandas(from_file, f"doc_id long, start long, n_tokens long, {field}")


def store_and_check(
    docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes ``docs`` below ``spark.checkpoint.dir`` and reads back where each document lies."""
    folder = shared_dir(docs.sparkSession, "token-blocks")
    return read_checksums(write(docs, folder, vocabulary, end_id, doc_id, text))
