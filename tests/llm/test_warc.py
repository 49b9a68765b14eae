import hashlib
import io
import os
import time

import pytest

from gridmill.llm import warc


def test_every_split_size_owns_each_record_once():
    magic = warc.MAGIC + b"\x00" * 7
    parts = [warc._member(warc.record(i, "http://x/" + str(i), magic * i + b"p" * (i * 37), f"{i:040x}", "response", None), 1) for i in range(12)]
    parts.insert(5, magic + b"not a member")
    stored = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)  # payload bytes stay visible in the file
    parts.append(stored.compress(warc.record(99, None, magic + b"z", "0" * 40, "response", None)) + stored.flush())
    raw = b"".join(parts)
    every = list(warc.read_range(io.BytesIO(raw), 0, len(raw), len(raw)))
    assert [o for o, h, _ in every if h is None] == [sum(map(len, parts[:5]))]  # the stray bytes between two records
    whole = [h["warc-record-id"] for _, h, _ in every if h]
    assert whole == [f"<urn:page:{i}>" for i in [*range(12), 99]]
    for size in (1, 7, 64, 1000, len(raw)):
        got = [(o, h["warc-record-id"]) for a in range(0, len(raw), size) for o, h, _ in warc.read_range(io.BytesIO(raw), a, min(a + size, len(raw)), len(raw)) if h]
        assert [i for _, i in got] == whole and got == sorted(got), size


def test_bodies_survive():
    body = "é\r\n\r\nWARC/1.1\r\n".encode() * 3
    raw = warc._member(warc.record(1, "u v", body, "d", "response", None), 6)
    ((offset, h, got),) = warc.read_range(io.BytesIO(raw), 0, len(raw), len(raw))
    assert offset == 0 and got == body and h["warc-target-uri"] == "u v"


def test_pages(spark, tmp_path):
    big = "b" * 1000
    rows = [(1, "u", big, "c"), (5, None, big, "c"), (3, "u", big, "c"), (2, "u", "small", "c"), (4, "u", "small", "c"), (6, "u", None, "c"), (7, "u", "", "c"), (5, None, big, "c"), (None, "n", "x", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    got = warc.archive_pages(pages, folder=str(tmp_path / "w")).collect()
    key = lambda r: (r.record_id, r.type, r.payload_length, r.refers_to, len(r.body))
    want = [("urn:page:1", "revisit", 1000, "urn:page:5", 0), ("urn:page:5", "response", 1000, None, 1000), ("urn:page:5", "response", 1000, None, 1000), ("urn:page:3", "revisit", 1000, "urn:page:5", 0)]
    want += [(f"urn:page:{i}", "response", n, None, n) for i, n in (("2", 5), ("4", 5), ("6", 0), ("7", 0), ("", 1))]
    assert sorted(map(key, got), key=str) == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0), folder=str(tmp_path / "e")).count() == 0


def test_splits_of_one_byte_on_spark(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    rows = warc.plan_revisits(pages, "page_id", "html")
    m = warc.write_archives(rows.coalesce(1), str(tmp_path / "w"), "page_id", "url", "html")
    m = spark.createDataFrame(m.collect())
    for size in (200, 10_000):
        assert sorted(int(r.record_id.split(":")[-1]) for r in warc.read_archives(m, size).collect()) == list(range(20))


def _good(i, body=b"x" * 300):
    return warc._member(warc.record(i, "u", body, hashlib.sha1(body).hexdigest(), "response", None), 3)


def test_damage_is_told(spark, tmp_path):
    """Cut, bent and foreign members become rows; the records around them are read."""
    bent = bytearray(_good(2, os.urandom(2000)))
    bent[-40] ^= 255  # the check sum no longer fits
    odd = [b"WARC/1.0\r\nContent-Length: x1\r\nWARC-Type: response\r\n\r\nab", b"WARC/1.0\r\nContent-Length: 99\r\nWARC-Type: response\r\n\r\nab", b"WARC/1.0\r\nno end of headers", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab"]
    lies = warc._member(warc.record(7, "u", b"body", "0" * 40, "response", None), 3)
    foreign = warc._member(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", 3)
    parts = [_good(1), bytes(bent), _good(3), *(warc._member(x, 3) for x in odd), lies, foreign, _good(4), _good(5, os.urandom(3000))[:1500]]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    for size in (97, 1 << 20):
        got = [(r.type, r.record_id) for r in warc.read_archives(files, size).orderBy("offset").collect()]
        assert [i for t, i in got if t == "response"] == [f"urn:page:{i}" for i in (1, 3, 4)]
        assert [t for t, _ in got].count("damaged") == 7, got
        assert [t for t, _ in got].count("warcinfo") == 1


def test_own_archives_must_be_whole(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    got = warc.archive_pages(pages.coalesce(1), folder=str(tmp_path / "w"))
    (name,) = (f for f in (tmp_path / "w").iterdir() if f.suffix == ".warc")
    raw = bytearray(name.read_bytes())
    raw[raw.index(warc.MAGIC, len(raw) // 2) + 14] ^= 255
    name.write_bytes(raw)
    with pytest.raises(Exception, match="damaged record"):
        got.collect()


def test_long_records(spark, tmp_path):
    """A payload of 40 MB and a very long address cost their own size."""
    body, start = os.urandom(40 << 20), time.perf_counter()
    raw = warc._member(warc.record(1, "u" * 200_000, body, "d", "response", None), 1)
    ((_, h, got),) = warc.read_range(io.BytesIO(raw), 0, len(raw), len(raw))
    assert got == body and len(h["warc-target-uri"]) == 200_000 and time.perf_counter() - start < 20
    pages = spark.createDataFrame([(1, "u" * 70_000, "é" * 3_000_000), (2, None, "é" * 3_000_000)], "page_id long, url string, html string")
    got = {r.record_id: (r.type, r.payload_length) for r in warc.archive_pages(pages, folder=str(tmp_path / "w")).select("record_id", "type", "payload_length").collect()}
    assert got == {"urn:page:1": ("revisit", 6_000_000), "urn:page:2": ("response", 6_000_000)}


def test_names_may_clash(spark, tmp_path):
    names = ["path", "offset", "record_id", "type", "digest", "payload_bytes", "refers_to", "_keeper", "_n", "id", "payload"]
    pages = spark.createDataFrame([(1, "u", "b" * 1200, *"abcdefghijk"), (2, "u", "b" * 1200, *"abcdefghijk")], ", ".join(["page_id long", "url string", "html string", *(f"{n} string" for n in names)]))
    assert sorted((r.record_id, r.type) for r in warc.archive_pages(pages, folder=str(tmp_path / "w")).collect()) == [("urn:page:1", "revisit"), ("urn:page:2", "response")]
