"""WARC archives: a writer with revisit records, and a reader that splits files at any byte.

A file is a chain of gzip members, one a record. The reader's tasks take byte ranges: a task searches
its range for the gzip magic, takes a place for a record only if decompressing from there gives a WARC
header, reads on from member to member, and owns the records that start inside its range.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.shared import dealt, stored, text_of
from pluvia.session import shared_dir

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT = 100
SPLIT_BYTES = 1 << 20
RANGES_A_TASK = 32
READ_BYTES = 1 << 18
GZIP_LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_urn(record_id: str | None) -> str:
    return f"<urn:x-record:{quote(record_id or '', safe='')}>"


def id_of(urn: str | None) -> str | None:
    """The id behind ``record_urn``; null where there was none."""
    return (urn and unquote(urn.removeprefix("<urn:x-record:").removesuffix(">"))) or None


def member(
    record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None
) -> bytes:
    """A record as a gzip member: a response, or with ``refers_to`` a revisit of that record, which
    has the HTTP header with the payload's length but no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_urn(record_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: quote(m[0]), url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    pack = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    parts = [VERSION, b"\r\n", head, b"\r\n", block, b"\r\n\r\n"]
    return b"".join([pack.compress(b"".join(parts)), pack.flush()])


@dataclass
class Record:
    start: int
    fields: dict[str, str]
    block: bytes

    @classmethod
    def parse(cls, start: int, data: bytes) -> Record:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        return cls(start, fields, rest[: int(fields["content-length"])])

    def payload(self) -> tuple[int, bytes]:
        """The length that the HTTP header states, and the payload that is there."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return int(stated[1]) if stated else len(body), body


def unpacked(source, size: int, start: int, limit: int | None = None) -> tuple[bytes, int] | None:
    """What the gzip member at ``start`` holds, and where it ends; null if there is no whole one.
    With ``limit``, only so many bytes of it are unpacked, and the end is unknown."""
    unpack, parts, at, got = zlib.decompressobj(31), [], start, 0
    source.seek(start)
    while at < size and not unpack.eof:
        data = source.read(min(READ_BYTES, size - at))
        at += len(data)
        try:
            while data and not unpack.eof:
                parts.append(unpack.decompress(data, 0 if limit is None else limit - got))
                got += len(parts[-1])
                if limit is not None and got >= limit:
                    return b"".join(parts), -1
                data = unpack.unconsumed_tail
        except zlib.error:
            return None
    if not unpack.eof:
        return None
    return b"".join(parts), at - len(unpack.unused_data)


def is_record(source, size: int, start: int) -> bool:
    """Whether a gzip member with a WARC header starts there."""
    begun = unpacked(source, size, start, len(VERSION) + 2)
    return begun is not None and re.match(rb"WARC/\d\.\d\r\n", begun[0]) is not None


def next_record(source, size: int, start: int, end: int) -> int | None:
    """Place of the first record that starts in [start, end)."""
    at = start
    while at < end:
        source.seek(at)
        data = source.read(min(READ_BYTES, end + len(MAGIC) - 1 - at, size - at))
        found = data.find(MAGIC)
        while found >= 0:
            if is_record(source, size, at + found):
                return at + found
            found = data.find(MAGIC, found + 1)
        if len(data) < READ_BYTES:
            return None
        at += len(data) - len(MAGIC) + 1
    return None


def records_in(source, size: int, start: int, end: int) -> Iterator[Record]:
    """The records that start in [start, end), wherever they end. What is no record is skipped."""
    at = next_record(source, size, start, end)
    while at is not None and at < end:
        whole = unpacked(source, size, at) if is_record(source, size, at) else None
        if whole is None:
            at = next_record(source, size, at + 1, end)
            continue
        yield Record.parse(at, whole[0])
        at = whole[1]


def with_revisits(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``id, url, payload, digest, refers_to``: of records with equal payloads of ``MIN_REVISIT`` bytes
    or more, all but that with the smallest id refer to it."""
    rows = pages.select(
        F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"),
        text_of(html).alias("payload"),
    ).withColumn("key", F.unhex(F.sha2("payload", 256)))
    first = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("key")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", "first")
    )
    # short payloads refer to nothing: their rows are spread by id, or the empty one would be a hot key
    apart = F.unhex(F.sha2(F.concat(F.lit("id "), F.coalesce(F.col("id").cast("string"), "url", F.lit(""))), 256))
    long = F.octet_length("payload") >= MIN_REVISIT
    rows = rows.withColumn("digest", F.lower(F.hex("key"))).withColumn(
        "key", F.when(long, F.col("key")).otherwise(apart)
    )
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "key", "left").select(
        "id", "url", "payload", "digest", refers.alias("refers_to")
    )


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Writes a record for each row of ``pages`` below ``folder``; a row a file: ``path, records,
    bytes``, stored.

    Payloads are the html in UTF-8. Null html is an empty payload; a null url is left out; white space
    and controls in a url are escaped. Rows with a null id are never the first of equal payloads unless
    all are null, and then all are responses, as are rows that repeat the smallest id. Very long
    payloads are written whole. An empty table gives no file. Other columns are ignored.

    The file of a task that is lost or runs twice has a name of its own: only the files that this
    table names count.
    """

    def to_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size = None, 0, 0
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            columns = [batch[c] for c in ("id", "url", "payload", "digest", "refers_to")]
            for values in zip(*columns):
                i, u, payload, digest, first = (v.as_py() for v in values)
                if out is None:
                    store.create_dir(base)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = member(i, u, payload.encode(), digest, first)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]}
            )

    rows = with_revisits(pages, page_id, url, html)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")})
    files = rows.mapInArrow(to_file, "path string, records long, bytes long")
    return stored(files, "warc-files")


RESULT = (
    "id string, url string, record_type string, refers_to string, payload_bytes long, "
    "payload_digest string"
)


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """The records in ``files`` (``path``, ``bytes``): ``id, url, record_type, refers_to,
    payload_bytes, payload_digest`` and, if asked for, ``payload`` (binary, null for revisits).

    Length and SHA-256 of a response are taken from its payload; a revisit states them.
    """
    schema = RESULT + (", payload binary" if payload else "")

    def row(record: Record) -> tuple:
        kind = record.fields["warc-type"]
        size, body = record.payload()
        digest = record.fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response":
            size, digest = len(body), hashlib.sha256(body).hexdigest()
        return (
            id_of(record.fields["warc-record-id"]), record.fields.get("warc-target-uri"), kind,
            id_of(record.fields.get("warc-refers-to")), size, digest,
            *[body if kind == "response" else None] * payload,
        )

    def from_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for path, size, start, end in batch.itertuples(index=False):
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(at) as source:
                    for record in records_in(source, size, start, end):
                        rows.append(row(record))
                        held += len(record.block) * payload
                        if len(rows) >= 5000 or held > 1 << 24:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = files.select(
        "path", "bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias(
            "start"
        ),
    ).select(
        "path", "bytes", "start",
        F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"),
    )
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    return dealt(ranges, n, RANGES_A_TASK, "path", "start").mapInPandas(from_ranges, schema)


def write_and_read(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Archives ``pages`` below ``spark.checkpoint.dir`` and reads the archives back; ids have the type
    that they have in ``pages``."""
    folder = shared_dir(pages.sparkSession, "warc")
    kind = pages.schema[page_id].dataType
    return read(write(pages, folder, page_id, url, html)).select(
        F.col("id").cast(kind).alias("page_id"), "url", "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )
