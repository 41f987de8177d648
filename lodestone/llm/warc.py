"""WARC: archives with revisit records, and a reader that salvages damaged ones.

**Writer.** Rows become WARC/1.1 records, each its own gzip member. Of payloads that are
equal (by SHA-256; the standard's SHA-1 goes in the header only) and large enough, the row with the largest identifier is written as a response, the
others as `revisit` records that refer to it. Which row that is comes from one aggregate
by digest (combined in the map tasks, so a payload that a third of the rows share is no
hot key). Archives are files of a bounded size in a shared folder; a task writes under a
name of its own attempt and the manifest, written by Spark's committer, names the files
that count, so retried or speculative tasks do no harm.

**Reader.** `read_archives` loads archives through Spark (any store it knows) and walks
them record by record, with checks: the member inflates and its CRC holds, the version
line is there, the header has a length, the block has that length, and payload digests
hold. After a failed check the reader searches for the next valid gzip member (or, in
plain archives, the next version line at which a whole record parses), goes on from
there, and returns the bytes in between as a row of kind `gap`.

Edge cases: null and empty payloads are written as empty; a null identifier is kept as
null; repeated rows each become a record; of ties in the identifier one row is the
response; an empty table gives an empty manifest and no records; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, number_rows, scratch, table

#: Fixed values of the WARC 1.1 standard.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION_LINE = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"
MOST_HEADER = 1 << 20  # bytes of a record's header; a longer one is damage
DATE = "2024-01-01T00:00:00Z"

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
MOST_STRAYS = 10_000  # files of failed attempts that may be broadcast; more are joined by a shuffle
_NULL_ID = 1 << 64


def record_id(row_id: int | None) -> str:
    """A reversible record id: the row's identifier in the low 65 bits of a UUID."""
    return f"urn:uuid:{uuid.UUID(int=(8 << 76) | (2 << 62 << 16) | (_NULL_ID if row_id is None else row_id % (1 << 64)))}"


def row_id(urn: str | None) -> int | None:
    """What `record_id` was made from; None for a null one and for foreign ids."""
    if not urn:
        return None
    try:
        n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    low = n & (_NULL_ID - 1)
    if n & _NULL_ID:
        return None
    return low - (1 << 64) if low >> 63 else low


def response(ident: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed; a revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC-Type: " + ("revisit" if revisit else "response"),
        f"WARC-Record-ID: <{record_id(ident)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + CRLF + "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """id, url, payload, digest and, for rows to be written as revisits, refers_to."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = number_rows(pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                                    payload.alias("payload"), F.sha1(payload).alias("digest")), "row")
    large = rows.where(F.octet_length("payload") >= min_bytes).select("id", "row", F.sha2("payload", 256).alias("digest"))
    first = large.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = cut(large.select("digest", "id", "row").join(first, "digest").where(F.col("row") != F.col("best.row"))
                .select("row", F.col("best.id").alias("refers_to"), F.lit(True).alias("revisit")))
    return rows.join(later, "row", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` to archives below ``path``; returns the manifest (file, bytes, records)."""
    planned = plan_records(pages, id_col, url_col, payload_col, min_bytes)

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{folder}/archives", recursive=True)
        out, name, size, records = None, "", 0, 0
        for batch in batches:
            for row in batch.select(["id", "url", "payload", "digest", "refers_to", "revisit"]).to_pylist():
                data = member(response(row["id"], row["url"], row["payload"].encode(), row["digest"], row["refers_to"], row["revisit"]))
                if out is not None and size + len(data) > archive_bytes:
                    out.close()
                    yield _manifest(name, size, records)
                    out, size, records = None, 0, 0
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/archives/{name}", compression=None)
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield _manifest(name, size, records)

    planned.select("id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, "file string, bytes long, records long").write.mode("overwrite").parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema("file string, bytes long, records long").parquet(f"{path}/manifest")


def _manifest(name: str, size: int, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})


# reading


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | None:
    """The record at ``at``: (header, block, end), or None where a check fails.

    A header is read line by line up to its empty line and given up at the first line that is no
    field, such as another version line: what is read twice is at most one header."""
    m = VERSION_LINE.match(data, at)
    if not m:
        return None
    head: dict[str, str] = {}
    line_at = m.end()
    while True:
        stop = data.find(CRLF, line_at, at + MOST_HEADER)
        if stop < 0:
            return None
        if stop == line_at:
            break
        name, colon, value = data[line_at:stop].partition(b":")
        line_at = stop + 2
        if not colon:
            return None
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not length.isdigit() or "warc-type" not in head:
        return None
    start, end = stop + 2, stop + 2 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    return head, data[start:end], end + 4


def inflate(data: bytes, at: int, slice_bytes: int = 1 << 14) -> tuple[bytes, int] | None:
    """The gzip member at ``at`` and its end, or None if it is cut short or its CRC fails."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + slice_bytes]))
            at += slice_bytes
    except zlib.error:
        return None
    return (b"".join(out), min(at, len(data)) - len(z.unused_data)) if z.eof else None


def _payload(head: dict, block: bytes) -> tuple[bytes, int, str | None]:
    """(payload, its full length, its SHA-1 or None if a stated one fails) of a record's block."""
    http, _, body = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    said = re.search(rb"(?i)^content-length:\s*([0-9]+)\s*$", http, re.M)
    full = int(said[1]) if said and head["warc-type"] == "revisit" else len(body)
    said_digest = head.get("warc-payload-digest", "").lower()
    if head["warc-type"] == "revisit":
        return body, full, said_digest.removeprefix("sha1:")
    digest = hashlib.sha1(body).hexdigest()
    return body, full, digest if not re.fullmatch("sha1:[0-9a-f]{40}", said_digest) or said_digest == f"sha1:{digest}" else None


def _walk(data: bytes):
    """Records and gaps of plain bytes: ("record", start, end, header, content) and ("gap", start, end, None, None)."""
    at, bad_from = 0, None
    while at < len(data):
        found = parse(data, at)
        content = _payload(found[0], found[1]) if found else None
        if content and content[2] is not None:
            if bad_from is not None:
                yield "gap", bad_from, at, None, None
                bad_from = None
            yield "record", at, found[2], found[0], content
            at = found[2]
            continue
        bad_from = at if bad_from is None else bad_from
        m = VERSION_LINE.search(data, at + 1)
        at = m.start() if m else len(data)
    if bad_from is not None:
        yield "gap", bad_from, len(data), None, None


def salvage(data: bytes):
    """Yields (kind, start, end, inside, header, (payload, length, digest)): kind "record" or "gap" (no header).

    start and end are bytes of the file. A gzip member that holds anything but one whole record
    is walked in turn: its records and gaps have the member's start and end, and ``inside`` their
    own (start, end) in the inflated member."""
    if not (data[:2] == GZIP_MAGIC[:2] or GZIP_MAGIC in data and VERSION_LINE.search(data) is None):
        yield from ((kind, start, end, None, head, content) for kind, start, end, head, content in _walk(data))
        return
    at, bad_from = 0, None
    while at < len(data):
        got = inflate(data, at) if data[at : at + 3] == GZIP_MAGIC else None
        inner = list(_walk(got[0])) if got else []
        if any(kind == "record" for kind, *_ in inner):
            if bad_from is not None:
                yield "gap", bad_from, at, None, None, None
                bad_from = None
            for kind, start, end, head, content in inner:
                yield kind, at, got[1], None if len(inner) == 1 else (start, end), head, content
            at = got[1]
            continue
        bad_from = at if bad_from is None else bad_from
        at = data.find(GZIP_MAGIC, at + 1)
        at = len(data) if at < 0 else at
    if bad_from is not None:
        yield "gap", bad_from, len(data), None, None, None


RECORDS = ("file string, kind string, start long, end long, inside_start long, inside_end long, record_type string, id long, refers_to long, url string, "
           "payload_bytes long, payload_digest string, payload binary")


def read_archives(spark: SparkSession, path: str, files: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives in folder ``path`` (only of ``files``, if given).

    payload_bytes and payload_digest (lower-case hex SHA-1) are of the full payload, for
    revisits as their headers state them; rows of kind `gap` have only their places: the file's
    bytes from start to end or, where inside_start is given, those of the inflated member there."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    raw = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files is not None:  # what failed attempts left behind is rare: those are left out, by name, so that contents stay in place
        strays = cut(raw.select("file").join(files.select("file"), "file", "left_anti"))
        n = strays.count()
        if n:
            raw = raw.join(F.broadcast(strays) if n <= MOST_STRAYS else strays, "file", "left_anti")

    def run(batches):
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, start, end, inside, head, found in salvage(content.as_py()):
                    place = (file, kind, start, end, *(inside or (None, None)))
                    if kind == "gap":
                        rows.append((*place, *[None] * 7))
                    else:
                        (body, full, digest), revisit = found, head["warc-type"] == "revisit"
                        rows.append((*place, head["warc-type"], row_id(head.get("warc-record-id")),
                                     row_id(head.get("warc-refers-to")) if revisit else None, head.get("warc-target-uri"), full, digest,
                                     body if payloads else None))
                        size += len(body) if payloads else 0
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return raw.select("file", "content").mapInArrow(run, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record, read back from the archives, says; a gap in them is an error."""
    with scratch(spark) as path:
        files = write_archives(table(spark, sf_dir, "pages"), path)
        found = cut(read_archives(spark, f"{path}/archives", files, payloads=False).select(
            "kind", "file", "start", "end", F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))
        gaps = found.where("kind = 'gap'").select("file", "start", "end").take(5)
        if gaps:
            raise RuntimeError(f"archives just written have damaged parts, of which {gaps}")
        return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
             max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM d
"""
