import gzip
import hashlib
import io
import random

import pytest

from pluvia.llm import warc
from tests.llm.helpers import rows_of

SCHEMA = "page_id long, url string, html string, key string, n string, first string, digest string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages():
    rng = random.Random(2)
    long = "é" * 60
    rows = [
        (5, "http://a/ b\r\nc", long), (3, "http://a", long), (9, None, long), (None, "u", long),
        (3, "http://a", long), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "", None), (6, "u", ""),
        (7, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08" + "y" * 200), (None, None, None),
        (None, "u", "z" * 300), (None, "u", "z" * 300), (8, "u", "\x00\U0001f600" * 100),
        (10, "u", "".join(rng.choices("abcdef <>", k=700_000))),
    ]
    rows += [(i, f"http://h/{i}", "".join(rng.choices("xyz\n", k=rng.randint(0, 400)))) for i in range(20, 90)]
    return rows


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    found = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = first.get(html) if html in first and first[html] != i else None
        kind = "response" if to is None else "revisit"
        found.append((i, len(body), hashlib.sha256(body).hexdigest(), kind, to))
    return sorted(found, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", "f", "d") for r in rows], SCHEMA)


def test_archives_round_trip(spark):
    assert rows_of(warc.write_and_read(table(spark, pages())), *COLUMNS) == brute(pages())
    assert warc.write_and_read(table(spark, [])).count() == 0


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 30])
def test_any_split_gives_each_record_once(split):
    members = [
        warc.member(str(i), "u", body, "d", None)
        for i, body in enumerate([b"", b"abc" * 50, b"\x1f\x8b\x08" * 40, bytes(range(256)) * 3])
    ]
    data = b"junk\x1f\x8b\x08junk" + members[0] + members[1] + b"\x1f\x8b\x08" + members[2] + members[3]
    found = []
    for start in range(0, len(data), split):
        end = min(start + split, len(data))
        found += [r.fields["warc-record-id"] for r in warc.records_in(io.BytesIO(data), len(data), start, end)]
    assert found == [warc.record_urn(str(i)) for i in range(4)]


def test_split_reading_like_whole_reading(spark, tmp_path):
    files = warc.write(table(spark, pages()), str(tmp_path))
    columns = ("id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    whole = rows_of(warc.read(files, 1 << 40), *columns)
    assert whole == rows_of(warc.read(files, 500), *columns)
    bodies = {r.id: r.payload for r in warc.read(files, 4096, payload=True).collect() if r.id == "10"}
    assert bodies["10"].decode() == [r[2] for r in pages() if r[0] == 10][0]


def test_files_are_plain_gzip(spark, tmp_path):
    files = warc.write(table(spark, pages()).coalesce(1), str(tmp_path)).collect()
    text = gzip.decompress(open(files[0].path, "rb").read())
    assert text.count(b"WARC-Type: ") == len(pages()) == files[0].records
    assert b"WARC-Target-URI: http://a/%20b%0D%0Ac\r\n" in text


def test_broken_member_is_skipped():
    good = warc.member("1", "u", b"body", "d", None)
    data = good[: len(good) // 2] + good
    found = list(warc.records_in(io.BytesIO(data), len(data), 0, len(data)))
    assert [r.start for r in found] == [len(good) // 2]


def test_ids():
    for i in ("1", "a b<>/é", "null"):
        assert warc.id_of(warc.record_urn(i)) == i
    assert warc.id_of(warc.record_urn(None)) is None and warc.id_of(None) is None


def test_archives_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGES_A_TASK", 2)
    pages = spark.createDataFrame(
        [(i, f"http://x/{i}", f"{i} " * 400) for i in range(300)], "page_id long, url string, html string"
    )
    files = warc.write(pages, str(tmp_path / "warc"))
    read = warc.read(files, split_bytes=512)
    assert read.rdd.getNumPartitions() >= files.agg({"bytes": "sum"}).first()[0] / 1024 > 8
    assert read.count() == 300
