"""Compressed streams embedded in files: gzip, zip, PNG, cabinets and bare zlib, found, inflated and verified.

One compiled pattern finds where a stream may begin; what is found is inflated in
bounded pieces from a view of the file, so neither many candidates nor large streams copy it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Found = tuple[str, str, int, int, int, bool]  # kind, entry, offset, compressed size, plain size, verified

#: Fixed values, the formats' signatures.
ZIP_LOCAL, ZIP_CENTRAL, ZIP_END, ZIP64_END, ZIP64_AT = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
PNG, CABINET, GZIP = b"\x89PNG\r\n\x1a\n", b"MSCF\0\0\0\0", b"\x1f\x8b\x08"
#: Two bytes of zlib: deflate with a window up to 32 KB, no dictionary, a multiple of 31.
ZLIB = [bytes((m, f)) for m in range(0x08, 0x79, 0x10) for f in range(256) if (m << 8 | f) % 31 == 0 and not f & 32]
BEGIN = re.compile(b"|".join(map(re.escape, [ZIP_LOCAL, PNG, CABINET, GZIP, *ZLIB])), re.DOTALL)
PIECE, MOST = 1 << 16, 1 << 20


def inflate(data: memoryview | bytes, at: int, wbits: int, before: bytes = b"") -> tuple[int, int, int, bool]:
    """Compressed size, plain size and plain CRC-32 of the stream at ``at``, and whether it ends well; ``before`` is a raw stream's earlier text."""
    view, here = memoryview(data), at
    d = zlib.decompressobj(wbits, zdict=before) if before else zlib.decompressobj(wbits)
    plain = crc = 0
    try:
        while not d.eof:
            piece = d.unconsumed_tail
            if not piece:
                piece = view[here : here + PIECE]
                here += len(piece)
            out = d.decompress(piece, MOST)
            if not out and not len(piece) and not d.eof:
                return 0, 0, 0, False  # the file ends first
            plain += len(out)
            crc = zlib.crc32(out, crc)
    except zlib.error:
        return 0, 0, 0, False
    return here - at - len(d.unused_data), plain, crc, True


def zip_directory(data: bytes, start: int) -> tuple[list[tuple[str, int, int, int, int, int]], int] | None:
    """Entries (name, method, CRC, compressed and plain size, place of the local header) of the archive that begins at ``start``, and its end.

    By the first end record whose directory fits an archive that begins there; 64-bit fields are read where the 32-bit ones say so.
    """
    end = start
    while (end := data.find(ZIP_END, end + 1)) >= 0:
        if end + 22 > len(data):
            return None
        entries, size, offset, comment = struct.unpack("<10xHIIH", data[end : end + 22])
        top, locator = end, end - 20
        if data[locator : locator + 4] == ZIP64_AT and 0xFFFFFFFF in (size, offset) or entries == 0xFFFF:
            top = start + struct.unpack("<Q", data[locator + 8 : locator + 16])[0]
            if data[top : top + 4] != ZIP64_END:
                continue
            entries, size, offset = struct.unpack("<QQQ", data[top + 32 : top + 56])
        if start + offset + size != top:
            continue
        found, p = [], start + offset
        for _ in range(entries):
            if data[p : p + 4] != ZIP_CENTRAL or p + 46 > top:
                return None
            method, crc, packed, plain, name, extra, note, local = struct.unpack("<10xH4xIIIHHH8xI", data[p : p + 46])
            more, q = data[p + 46 + name : p + 46 + name + extra], 0
            while q + 4 <= len(more):
                kind, length = struct.unpack("<HH", more[q : q + 4])
                if kind == 1:  # 64-bit values, only those that don't fit
                    wide = iter(struct.unpack(f"<{length // 8}Q", more[q + 4 : q + 4 + length // 8 * 8]))
                    plain, packed, local = (next(wide, x) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
                q += 4 + length
            found.append((data[p + 46 : p + 46 + name].decode("utf-8", "replace"), method, crc, packed, plain, start + local))
            p += 46 + name + extra + note
        return found, end + 22 + comment
    return None


def zip_streams(data: bytes, at: int) -> tuple[list[Found], int]:
    """The entries of the archive at ``at`` by its central directory, or, where it has none, the one entry whose local header is there."""
    directory = zip_directory(data, at)
    if directory is None:
        method, crc, size, plain, name, extra = struct.unpack("<8xH4xIIIHH", data[at : at + 30])
        entries, end = [(data[at + 30 : at + 30 + name].decode("utf-8", "replace"), method, crc, size, plain, at)], 0
    else:
        entries, end = directory
    found: list[Found] = []
    for name, method, crc, size, plain, local in entries:
        if data[local : local + 4] != ZIP_LOCAL:
            found.append(("zip", name, local, size, plain, False))
            continue
        body = local + 30 + sum(struct.unpack("<26xHH", data[local : local + 30]))
        if method == 8:
            used, got, sum_, ok = inflate(data, body, -15)
            # a lone entry may have its sizes and sum behind the data only
            ok = ok and (directory is None and not crc or (sum_ == crc and got == plain and used == size))
            size, plain = used or size, got
        else:
            ok = method == 0 and zlib.crc32(data[body : body + size]) == crc
        found.append(("zip", name, body, size, plain, ok))
        end = max(end, body + max(size, 1))
    return found, end


def png_stream(data: bytes, at: int) -> tuple[Found, int]:
    body, p, end = bytearray(), at + 8, False
    while p + 12 <= len(data) and not end:
        size, kind = struct.unpack(">I4s", data[p : p + 8])
        if kind == b"IDAT":
            body += data[p + 8 : p + 8 + size]
        end = kind == b"IEND"
        p += 12 + size
    size, plain, _, ok = inflate(bytes(body), 0, 15)
    return ("png", "IDAT", at, size, plain, ok and end), p


def cabinet_streams(data: bytes, at: int) -> tuple[list[Found], int]:
    """A cabinet's folders: blocks of deflate, each of which may refer to the text of the one before. One without reserved fields or neighbours is read."""
    if at + 36 > len(data):
        return [], at + 1
    total, folders, flags = struct.unpack("<8xI14xH2xH4x", data[at : at + 36])
    if flags or total < 36 or at + total > len(data):
        return [], at + 1
    found: list[Found] = []
    for k in range(folders):
        place, blocks, method = struct.unpack("<IHH", data[at + 36 + 8 * k : at + 44 + 8 * k])
        p, packed, plain, ok, before = at + place, 0, 0, method & 15 == 1, b""
        for _ in range(blocks):
            if p + 8 > len(data):
                ok = False
                break
            size, want = struct.unpack("<4xHH", data[p : p + 8])
            if ok:
                d = zlib.decompressobj(-15, zdict=before) if before else zlib.decompressobj(-15)
                try:
                    before = d.decompress(data[p + 10 : p + 8 + size], 1 << 15)
                    ok = data[p + 8 : p + 10] == b"CK" and len(before) == want
                except zlib.error:
                    ok = False
            packed, plain, p = packed + size, plain + want, p + 8 + size
        found.append(("cab", f"folder {k}", at + place, packed, plain, ok))
    return found, at + total


def streams(data: bytes) -> list[Found]:
    """kind, entry, offset, compressed size, plain size, verified; in order, none inside another."""
    found: list[Found] = []
    view, at = memoryview(data), 0
    while m := BEGIN.search(data, at):
        at = m.start()
        own: list[Found] = []
        if m.group() == ZIP_LOCAL and at + 30 <= len(data):
            own, end = zip_streams(data, at)
        elif m.group() == PNG:
            one, end = png_stream(data, at)
            own = [one]
        elif m.group() == CABINET:
            own, end = cabinet_streams(data, at)
        else:
            kind, wbits = ("gzip", 31) if m.group() == GZIP else ("zlib", 15)
            size, plain, _, ok = inflate(view, at, wbits)
            own, end = ([(kind, "", at, size, plain, True)], at + size) if ok and (plain or kind == "gzip") else ([], at + 1)
        found += own
        at = max(end, at + 1)
    return found


STRATEGIES = (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_HUFFMAN_ONLY, zlib.Z_RLE, zlib.Z_FIXED)
#: The levels that may write each value of a zlib header's level field.
LEVELS = ((1, 0), (5, 4, 3, 2), (6,), (9, 8, 7))


def replay(stream: bytes) -> tuple[int, int, int, int] | None:
    """Level, window bits, memory level and strategy at which zlib writes exactly this zlib stream, so that the plain text can stand for it.

    The header names the window and a class of levels, which are tried first.
    """
    plain = zlib.decompress(stream)
    window, named = (stream[0] >> 4) + 8, stream[1] >> 6
    for strategy in STRATEGIES:
        for levels in (LEVELS[named], *(x for k, x in enumerate(LEVELS) if k != named)):
            for level in levels:
                for memory in (8, 9, *range(1, 8)):
                    c = zlib.compressobj(level, zlib.DEFLATED, max(window, 9), memory, strategy)
                    if c.compress(plain) + c.flush() == stream:
                        return level, window, memory, strategy
    return None


def census(files: DataFrame, file_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row per embedded stream of each file."""
    names = ["kind", "entry", "offset", "size", "plain_size", "verified"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, content in enumerate(batch.column(1).to_pylist()):
                own = streams(content or b"")
                at += [i] * len(own)
                rows += own
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[file_col, *names])

    kind = files.schema[file_col].dataType.simpleString()
    return files.select(file_col, content_col).mapInArrow(run, f"`{file_col}` {kind}, kind string, entry string, offset bigint, size bigint, plain_size bigint, verified boolean")


def summary(found: DataFrame) -> DataFrame:
    """Streams and bytes by kind."""
    return found.groupBy("kind").agg(F.count("*").alias("streams"), F.count_if("verified").alias("verified"), F.sum(F.when(F.col("verified"), F.col("plain_size"))).alias("plain_bytes"), F.sum("size").alias("bytes"))
