"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip files of one member a record. The reader cuts every file into
byte ranges. A task looks for gzip magic inside its range, inflates the head of
each candidate member and accepts it only if the headers of a WARC record stand there;
it owns the records whose member starts inside its range and reads the last one to
its end beyond the range. After an accepted member the next one begins where it
ended, so magic bytes inside compressed data are never taken for a record.

A member that begins like a record but does not inflate to its end, lacks its headers or
whose payload is not the one its digest names is returned as a row of type ``damaged``
and the scan goes on behind its magic. So is the place behind a record where neither
the file ends nor another record begins: nothing is lost without a trace.

Defined cases: a null payload is an empty one; of records with equal payloads of at
least ``min_revisit`` bytes that with the largest id is the response and the others
revisit it (repeated rows with that id are all responses); null ids sort lowest; columns
other than id, url and payload are not read, whatever their names; an empty table makes
no archive. Bytes are kept once, so a very long record costs its own size.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, shared_dir, small_batches, spread

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
_CHUNK = 1 << 20


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str, min_revisit: int = 1000) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to.

    Only digests are grouped: the payloads meet the (few) digests that occur
    more than once in a join that adaptive execution broadcasts or splits by size.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha1(payload)})
    seen = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.max(id_col).alias("_keeper"), F.count("*").alias("_n")).where("_n > 1").select("payload_digest", "_keeper")
    rows = rows.join(seen, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_revisit) & F.col("_keeper").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_keeper"))
    return rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_keeper"))}).drop("_keeper")


def _urn(x) -> str:
    return f"urn:page:{'' if x is None else x}"


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has headers only."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head.append("WARC-Target-URI: " + " ".join((url or "").split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(rows: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, level: int = 3) -> DataFrame:
    """Write one archive a partition; returns the manifest (path, bytes, records).

    A task streams into a private file and renames it at its end, so a retry
    replaces the whole archive.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), "payload_digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc"
        fs, path = filesystem(name)
        part, out, n, size = f"{path}.{uuid.uuid4().hex}.part", None, 0, 0
        for b in it:
            if b.num_rows and out is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(part, compression=None)
            for i, url, payload, digest, kind, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = _member(record(i, url, (payload or "").encode(), digest, kind, to), level)
                out.write(m)
                n, size = n + 1, size + len(m)
        if out is not None:
            out.close()
            fs.move(part, path)
            yield pa.RecordBatch.from_pylist([{"path": name, "bytes": size, "records": n}], schema=schema)

    return rows.mapInArrow(run, "path string, bytes long, records long")


class _Range:
    """Forward reader over a file from an offset, keeping what has not been used."""

    def __init__(self, f, offset: int, size: int):
        self.f, self.at, self.size, self.buf = f, offset, size, bytearray()

    def more(self) -> bool:
        end = self.at + len(self.buf)
        if end >= self.size:
            return False
        self.f.seek(end)
        got = self.f.read(min(_CHUNK, self.size - end))
        self.buf += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.buf[:n]
        self.at += n


def _headers(raw: bytearray) -> tuple[dict[str, str], int] | None:
    """The headers of a record and where its body starts; None if they are none."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16 and "warc-type" in headers):
        return None
    return headers, end + 4


def _inflate(r: _Range) -> tuple[bool, dict[str, str], bytes, int]:
    """The member at the reader's position: (like a record, headers, body, length); length 0 if it is not whole."""
    z, out, used, likely = zlib.decompressobj(31), bytearray(), 0, False
    try:
        while not z.eof:
            if used >= len(r.buf) and not r.more():
                return likely, {}, b"", 0
            piece = bytes(r.buf[used : used + (_CHUNK if likely else 512)])
            out += z.decompress(piece)
            used += len(piece) - len(z.unused_data)
            if not likely and (len(out) >= 7 or z.eof):
                if not out.startswith(b"WARC/1."):
                    return False, {}, b"", 0
                likely = True
    except zlib.error:
        return likely, {}, b"", 0
    found = _headers(out)
    if found is None:
        return True, {}, b"", 0
    headers, start = found
    length = int(headers["content-length"])
    if start + length > len(out):
        return True, {}, b"", 0
    return True, headers, bytes(memoryview(out)[start : start + length]), used


def _follows(r: _Range) -> bool:
    """Whether the file ends here or a member with a record's first bytes stands here."""
    while len(r.buf) < 512 and r.more():
        pass
    if not r.buf:
        return True
    try:
        return zlib.decompressobj(31).decompress(bytes(r.buf[:512]), 7) == b"WARC/1."
    except zlib.error:
        return False


def read_range(f, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """(offset, headers, body) of the records whose member starts in [start, end); headers None of a damaged one."""
    r = _Range(f, start, size)
    while r.at < end:
        if len(r.buf) < len(MAGIC) and not r.more() and len(r.buf) < len(MAGIC):
            return
        at = r.buf.find(MAGIC)
        if at < 0:
            r.skip(max(0, len(r.buf) - 2))  # magic may straddle two reads
            if not r.more():
                return
            continue
        r.skip(at)
        if r.at >= end:
            return
        likely, headers, body, used = _inflate(r)
        if used:
            yield r.at, headers, body
        elif likely:
            yield r.at, None, b""
        r.skip(used or 1)
        if used and not _follows(r):
            yield r.at, None, b""


_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()), ("body", pa.binary())])


def _row(path: str, offset: int, h: dict[str, str] | None, body: bytes) -> tuple:
    """A record as a row. Length and digest of a payload are measured; a revisit has only its headers' word."""
    if h is None:
        return path, offset, None, "damaged", None, None, None, None, b""
    kind, digest, declared = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("warc-payload-length", "")
    length = int(declared) if declared.isascii() and declared.isdigit() and len(declared) < 16 else None
    if kind != "revisit":
        found = hashlib.sha1(body).hexdigest()
        if digest and digest != found or length is not None and length != len(body):
            return path, offset, h.get("warc-record-id", "").strip("<>"), "damaged", None, None, None, None, b""
        digest, length = found, len(body)
    refers = h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None
    return path, offset, h.get("warc-record-id", "").strip("<>"), kind, h.get("warc-target-uri"), digest, length, refers, body


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives (path, bytes), one task a byte range; the list of ranges is made on executors.

    Columns: path, offset, record_id, type, target_uri, digest, payload_length,
    refers_to, body.
    """
    small_batches(files.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))

    def run(it):
        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

        for b in it:
            for s in b.to_pylist():
                fs, inner = filesystem(s["path"])
                with fs.open_input_file(inner) as f:
                    rows, held = [], 0
                    for offset, h, body in read_range(f, s["start"], min(s["start"] + split_bytes, s["bytes"]), s["bytes"]):
                        rows.append(_row(s["path"], offset, h, body))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 1000:
                            yield done(rows)
                            rows, held = [], 0
                    if rows:
                        yield done(rows)

    return spread(splits, "path", "start").mapInArrow(run, "path string, offset long, record_id string, type string, target_uri string, digest string, payload_length long, refers_to string, body binary")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, min_revisit: int = 1000) -> DataFrame:
    """Write ``pages`` as archives below ``folder`` (shared storage), then read them back; a damaged record is an error."""
    folder = folder or shared_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    manifest = materialize(write_archives(plan_revisits(rows, "id", "payload", min_revisit), folder, "id", "url", "payload"))  # one row a file
    damaged = F.raise_error(F.concat(F.lit("damaged record in "), "path", F.lit(" at "), F.col("offset").cast("string")))
    return read_archives(manifest).withColumn("type", F.when(F.col("type") == "damaged", damaged).otherwise(F.col("type")))
