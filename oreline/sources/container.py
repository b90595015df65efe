"""A framed container of independently coded blocks: writer, strict reader and inspection.

Layout: the magic ``ORL1``, block size and total size as LEB128; then for each
block its size, codec number, payload size (LEB128), the CRC-32 of its plain bytes
(four bytes, little-endian) and the payload. Nothing may follow the last block.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.operators.codecs.bits import Corrupt, get_uvar, put_uvar
from oreline.operators.codecs.registry import REGISTRY, choose, choose_all, codec, decode

MAGIC = b"ORL1"
LARGEST_BLOCK = 1 << 27


@dataclasses.dataclass(frozen=True)
class Frame:
    block_id: int
    offset: int  # of the payload
    size: int
    codec: int
    payload_size: int
    crc: int


def header(block_size: int, total: int) -> bytes:
    return MAGIC + put_uvar(block_size) + put_uvar(total)


def frame(data: bytes, number: int, payload: bytes) -> bytes:
    return put_uvar(len(data)) + put_uvar(number) + put_uvar(len(payload)) + zlib.crc32(data).to_bytes(4, "little") + payload


def write(data: bytes, block_size: int = 1 << 18, codecs: tuple[int, ...] = (2, 9, 32)) -> bytes:
    out = [header(block_size, len(data))]
    for at in range(0, len(data), block_size):
        block = data[at : at + block_size]
        out.append(frame(block, *choose(block, codecs)))
    return b"".join(out)


def frames(data: bytes) -> Iterator[Frame]:
    """The blocks' frames, every bound checked; raises on anything a writer doesn't write."""
    if data[:4] != MAGIC:
        raise Corrupt("not a container")
    block_size, at = get_uvar(data, 4)
    total, at = get_uvar(data, at)
    if not 0 < block_size <= LARGEST_BLOCK:
        raise Corrupt("no such block size")
    seen = block = 0
    while seen < total:
        size, at = get_uvar(data, at)
        number, at = get_uvar(data, at)
        payload, at = get_uvar(data, at)
        if size != min(block_size, total - seen):
            raise Corrupt(f"block {block} has another size")
        codec(number)
        if at + 4 + payload > len(data):
            raise Corrupt(f"block {block} is cut short")
        yield Frame(block, at + 4, size, number, payload, int.from_bytes(data[at : at + 4], "little"))
        at += 4 + payload
        seen += size
        block += 1
    if at != len(data):
        raise Corrupt("bytes follow the last block")


def block_of(data: bytes, f: Frame) -> bytes:
    plain = decode(f.codec, data[f.offset : f.offset + f.payload_size])
    if len(plain) != f.size or zlib.crc32(plain) != f.crc:
        raise Corrupt(f"block {f.block_id} doesn't decode to what was written")
    return plain


def read(data: bytes) -> bytes:
    return b"".join(block_of(data, f) for f in frames(data))


def encode_blocks(blocks: DataFrame, keys: list[str], data_col: str, codecs: tuple[int, ...] = (2, 9, 32), rate: float = 0.0) -> DataFrame:
    """keys, size, codec, payload_size, crc, frame of each block: map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            plain = [x or b"" for x in batch.column(len(keys)).to_pylist()]
            for data, (number, payload) in zip(plain, choose_all(plain, codecs, rate), strict=True):
                rows.append((len(data), number, len(payload), zlib.crc32(data), frame(data, number, payload)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[*keys, "size", "codec", "payload_size", "crc", "frame"])

    own = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return blocks.select(*keys, data_col).mapInArrow(run, f"{own}, size bigint, codec int, payload_size bigint, crc bigint, frame binary")


def assemble(encoded: DataFrame, file_col: str, block_col: str, block_size: int) -> DataFrame:
    """file_col and content: a file's frames in order after its header. A file is one value, so it must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(block_col)
        return pd.DataFrame({file_col: [pdf[file_col].iloc[0]], "content": [header(block_size, int(pdf["size"].sum())) + b"".join(pdf["frame"])]})

    return encoded.groupBy(file_col).applyInPandas(run, f"`{file_col}` {encoded.schema[file_col].dataType.simpleString()}, content binary")


def scan(files: DataFrame, file_col: str = "path", content_col: str = "content", with_data: bool = False) -> DataFrame:
    """One row per block of each container: block_id, offset, size, codec, payload_size, crc, and data if asked for. A corrupt file raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in dataclasses.fields(Frame)]
        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                found = list(frames(content))
                columns = [pa.array([getattr(f, n) for f in found], pa.int64()) for n in names]
                if with_data:
                    columns.append(pa.array([block_of(content, f) for f in found], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), *columns], names=[file_col, *names, *["data"] * with_data])

    kind = files.schema[file_col].dataType.simpleString()
    return files.select(file_col, content_col).mapInArrow(run, f"`{file_col}` {kind}, block_id bigint, offset bigint, size bigint, codec bigint, payload_size bigint, crc bigint" + ", data binary" * with_data)


def inspect(scanned: DataFrame, file_col: str = "path") -> DataFrame:
    """Which codecs each container uses, and its sizes."""
    names = F.create_map(*[F.lit(x) for n, c in REGISTRY.items() for x in (n, c.name)])
    return scanned.groupBy(file_col).agg(
        F.count("*").alias("blocks"), F.sum("size").alias("size"), F.sum("payload_size").alias("payload_size"), F.array_join(F.array_sort(F.collect_set(F.element_at(names, F.col("codec").cast("int")))), ",").alias("codecs")
    )
