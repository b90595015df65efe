"""Deterministic corpora for tests and trials, as tables of records.

Every record is a function of its number and a seed, so any range of records can be
made anywhere. ``records`` gives (i, data); joined in order of i they are a corpus.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _noise(i: int, seed: int, most: int) -> int:
    """A number below ``most`` that depends on i and the seed alone."""
    x = (i * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 27) % most


def timeseries(i: int, seed: int) -> bytes:
    return struct.pack("<QfH", 1_700_000_000_000 + 250 * i + _noise(i, seed, 3), 20 + 5 * np.sin(i / 50) + _noise(i, seed + 1, 100) / 200, i % 7)


def arithmetic(i: int, seed: int) -> bytes:
    return struct.pack("<8I", *[(c * 1000 + i * (3 + c)) & 0xFFFFFFFF for c in range(8)])


def jitter(i: int, seed: int) -> bytes:
    return bytes((k * 7 + i % 5) & 255 for k in range(64)) + bytes(_noise(i, seed, 3))


def aligned_columns(i: int, seed: int) -> bytes:
    body = struct.pack("<HIQIHB", i & 0xFFFF, i * 12, 1_700_000_000 + i, _noise(i, seed, 1 << 16), i % 100, i % 3) + bytes([i & 15])
    return body + bytes([sum(body) & 255])


def drifting_stride(i: int, seed: int) -> bytes:
    return struct.pack("<5Q", i, i * 3, i * i & 0xFFFFFFFF, _noise(i, seed, 1 << 20), 42) + bytes((i // 96) % 9)


def counters(i: int, seed: int) -> bytes:
    return f"2024-01-{1 + i // 86400 % 28:02d}T{i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z mod={i % 8} seq={i} tick={i * 40} addr=0x{0x1000 + 64 * i:08x} lat={_noise(i, seed, 900)} qd={i % 32}\n".encode()


def telemetry(i: int, seed: int) -> bytes:
    return struct.pack("<Qd", 1_700_000_000_000 + 100 * i, 100 + np.cos(i / 90) * 3 + _noise(i, seed, 1000) / 1e4)


def json_lines(i: int, seed: int) -> bytes:
    row = {"seq": i, "ts": 1_700_000_000 + i, "sensor": f"s{i % 12}", "unit": "C", "reading": _noise(i, seed, 5000) / 100, "status": "ok" if i % 97 else "fault"}
    return json.dumps(row).encode() + b"\n"


def varied_lines(i: int, seed: int) -> bytes:
    row = {"id": i, "kind": "abc"[i % 3], "active": i % 2 == 0, "score": _noise(i, seed, 1000), "path": f"/a/{i % 40}/b", "tags": [f"t{i % 5}", f"u{i % 7}"]}
    return json.dumps(row | ({"extra": i} if i % 200 == 0 else {})).encode() + b"\n"


def repeated_lines(i: int, seed: int) -> bytes:
    return varied_lines(1, seed)


CORPORA: dict[str, Callable[[int, int], bytes]] = {
    f.__name__: f for f in (timeseries, arithmetic, jitter, aligned_columns, drifting_stride, counters, telemetry, json_lines, varied_lines, repeated_lines)
}


def records(spark: SparkSession, corpus: str, n: int, seed: int = 20260101, partitions: int | None = None) -> DataFrame:
    """i and data of the first n records of a corpus."""
    make = CORPORA[corpus]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(i, seed) for i in batch.column(0).to_pylist()], pa.binary())], names=["i", "data"])

    return spark.range(0, n, 1, partitions).toDF("i").mapInArrow(run, "i bigint, data binary")


def content(spark: SparkSession, corpus: str, n: int, seed: int = 20260101) -> bytes:
    """A whole small corpus on the driver; for tests."""
    return b"".join(bytes(r["data"]) for r in records(spark, corpus, n, seed).orderBy("i").collect())
