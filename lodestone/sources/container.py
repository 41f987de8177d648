"""Binary containers: tables of contents, chained blocks, raw deflate, nesting.

The reader works on a memory view and yields (path, bytes); `read_containers` runs it in
tasks over Spark's ``binaryFile`` source, so files come from any store Spark can read and
each file is one row's work.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import DataError

#: The mark at the head of a 32-bit container.
MAGIC = b"\xff\xff\xff\x7f"
MAGIC64 = b"\xff" * 8


@dataclass(frozen=True)
class Layout:
    """Fixed values of a container's variant."""

    end: int  # "no next block"
    header: int  # bytes in front of the first block
    digits: int  # hex digits of a number in a block's head
    entry: str  # struct format of a pair of offsets


SMALL = Layout(0x7FFFFFFF, 16, 8, "<2i")
LARGE = Layout(0xFFFFFFFFFFFFFFFF, 20, 16, "<2Q")


def layout_of(data) -> Layout:
    return LARGE if bytes(data[:8]) == MAGIC64 else SMALL


def _block(data: memoryview, at: int, kind: Layout) -> tuple[int, int, int, int]:
    """(document size, block size, next block, first byte) of the block at ``at``.

    A head is CRLF, three hex numbers with a blank behind each, CRLF."""
    step, n = kind.digits + 1, kind.digits
    length = 2 + 3 * step + 2
    head = bytes(data[at : at + length])
    if len(head) < length or head[:2] != b"\r\n" or head[-2:] != b"\r\n":
        raise DataError(f"no block at {at}")
    try:
        size, block, following = (int(head[2 + i * step : 2 + i * step + n], 16) for i in range(3))
    except ValueError as e:
        raise DataError(f"bad block head at {at}") from e
    return size, block, following, at + length


def document(data: memoryview, at: int, kind: Layout) -> bytes:
    """A document: its blocks' payloads up to its size."""
    size, block, following, first = _block(data, at, kind)
    parts, left, seen = [], size, {at}
    while True:
        take = min(block, left)
        parts.append(bytes(data[first : first + take]))
        left -= take
        if left <= 0 or following == kind.end:
            return b"".join(parts)
        if following in seen:
            raise DataError(f"blocks run in a circle at {following}")
        seen.add(following)
        _, block, following, first = _block(data, following, kind)


def entries(data: memoryview, kind: Layout | None = None) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the files in a container, in the order of its table of contents."""
    kind = kind or layout_of(data)
    pair = struct.calcsize(kind.entry)
    record = pair + struct.calcsize(kind.entry) // 2
    toc = document(data, kind.header, kind)
    for at in range(0, len(toc) - pair + 1, record):
        about, body = struct.unpack_from(kind.entry, toc, at)
        if about in (0, kind.end):
            continue
        name = document(data, about, kind)[20:].decode("utf-16-le", "replace").partition("\0")[0]
        yield name, document(data, body, kind) if body != kind.end else b""


def inflate(data: bytes) -> bytes:
    """Raw deflate; data that is none stays as it is."""
    try:
        z = zlib.decompressobj(-15)
        return z.decompress(data) + z.flush()
    except zlib.error:
        return data


def unpack(data: bytes, deflate: bool = True, path: str = "", depth: int = 64) -> Iterator[tuple[str, bytes]]:
    """All files of a container with their paths; containers inside are opened, ``depth`` levels at most."""
    for name, body in entries(memoryview(data)):
        body = inflate(body) if deflate else body
        where = f"{path}/{name}" if path else name
        if body[:4] == MAGIC:
            if not depth:
                raise DataError(f"containers inside containers without end at {where}")
            yield from unpack(body, False, where, depth - 1)
        else:
            yield where, body


def read_containers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, name, content and error: the files of all containers below ``path``.

    A container that cannot be read is one row with its error; the others go on."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    rows += ((file, n, b, None) for n, b in unpack(content.as_py()))
                except DataError as e:
                    rows = [(file, None, None, str(e))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], ["file", "name", "content", "error"])

    return raw.mapInArrow(run, "file string, name string, content binary, error string")


def pack_small(files: dict[str, bytes], block: int = 512, deflate: bool = True) -> bytes:
    """A 32-bit container with ``files``, for tests and exports."""
    def chain(body: bytes, at: int, least: int) -> bytes:
        size = max(len(body), least)
        return b"\r\n%08x %08x %08x \r\n" % (len(body), size, SMALL.end) + body.ljust(size, b"\0")

    toc_size = max(block, 12 * len(files))
    out, offsets = bytearray(), []
    at = SMALL.header + 31 + toc_size
    for name, body in files.items():
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        data = z.compress(body) + z.flush() if deflate else body
        about = chain(struct.pack("<QQi", 0, 0, 0) + name.encode("utf-16-le") + b"\0\0\0\0", at, 0)
        held = chain(data, at + len(about), block)
        offsets.append((at, at + len(about)))
        out += about + held
        at += len(about) + len(held)
    toc = b"".join(struct.pack("<3i", a, b, SMALL.end) for a, b in offsets)
    return struct.pack("<4i", SMALL.end, block, len(files), 0) + chain(toc, SMALL.header, toc_size) + bytes(out)
