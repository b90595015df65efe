"""Statistics of byte strings: one Arrow pass over the text, no byte ever becomes a row.

A text of any length is a task's own work; what leaves a task is a row per
text, or 256 rows per task where the whole corpus is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(counts: np.ndarray) -> float:
    """Bits per symbol of a histogram."""
    counts = counts[counts > 0].astype(np.float64)
    n = counts.sum()
    return float(-(counts * np.log2(counts / n)).sum() / n) if len(counts) else 0.0


def conditional_entropy(data: np.ndarray) -> float:
    """Bits per byte given the byte before, over all bytes but the first."""
    if len(data) < 2:
        return 0.0
    pairs = data[:-1].astype(np.int32) * 256 + data[1:]
    kinds, joint = np.unique(pairs, return_counts=True)
    context = np.bincount(data[:-1], minlength=256)[kinds >> 8]
    return float(-(joint * np.log2(joint / context)).sum() / (len(data) - 1))


def scaled_entropy(counts: np.ndarray) -> int:
    """Whole-number entropy surface: sum of 256 n (ceil log2 N - floor log2 n)."""
    total = int(counts.sum())
    ceiling = (total - 1).bit_length() if total else 0
    return sum(256 * n * (ceiling - (n.bit_length() - 1)) for n in counts[counts > 0].tolist())


def record_xor(data: bytes) -> tuple[int, int, int, int]:
    """Records, the longest one, cells of the padded matrix, and cells equal to the record before (zeros before the first)."""
    records = data.split(b"\n")
    tail = records.pop()
    rows = [r + b"\n" for r in records] + ([tail] if tail else [])
    stride = max(map(len, rows), default=0)
    zero = 0
    before = np.zeros(stride, dtype=np.uint8)
    for r in rows:
        row = np.zeros(stride, dtype=np.uint8)
        row[: len(r)] = np.frombuffer(r, dtype=np.uint8)
        zero += int((row == before).sum())
        before = row
    return len(rows), stride, len(rows) * stride, zero


def sampled_repeats(data: np.ndarray, samples: int = 1024) -> int:
    """How many of up to ``samples`` four-byte windows at an even stride occur more than once, but for the first of each."""
    if len(data) < 4:
        return 0
    at = np.arange(0, len(data) - 3, max(1, len(data) // samples))[:samples]
    windows = sum(data[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    return len(at) - len(np.unique(windows))


def looks_incompressible(repeats: Column, n: Column, samples: int = 1024, least: int = 512) -> Column:
    """At most 1 % of the sampled windows repeat one before them; short texts never."""
    return (n >= least) & (repeats * 100 <= samples)


PRINTABLE = np.zeros(256, dtype=bool)
PRINTABLE[[9, 10, 11, 12, 13, *range(32, 127)]] = True

#: What each group of statistics is called, and how it comes from a text's bytes and their histogram.
STATISTICS = {
    ("n_bytes",): lambda raw, data, hist: (len(raw),),
    ("distinct_bytes",): lambda raw, data, hist: (int((hist > 0).sum()),),
    ("printable",): lambda raw, data, hist: (int(hist[PRINTABLE].sum()),),
    ("entropy",): lambda raw, data, hist: (entropy(hist),),
    ("order1_entropy",): lambda raw, data, hist: (conditional_entropy(data),),
    ("h0_scaled",): lambda raw, data, hist: (scaled_entropy(hist),),
    ("repeats",): lambda raw, data, hist: (sampled_repeats(data),),
    ("records", "stride", "matrix_bytes", "xor_zeros"): lambda raw, data, hist: record_xor(raw),
}
FRACTIONS = ("entropy", "order1_entropy")


def byte_statistics(texts: DataFrame, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    """id_col and the ``wanted`` statistics, names of ``STATISTICS``; only those are computed. A null text is empty."""
    groups = {names: f for names, f in STATISTICS.items() if set(names) & set(wanted)}
    names = [n for group in groups for n in group]
    kinds = [pa.float64() if n in FRACTIONS else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                hist = np.bincount(data, minlength=256)
                rows.append([x for f in groups.values() for x in f(raw, data, hist)])
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[id_col, *names])

    kind = texts.schema[id_col].dataType.simpleString()
    spec = ", ".join(f"{n} {'double' if n in FRACTIONS else 'bigint'}" for n in names)
    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {spec}").select(id_col, *wanted)


def context_sizes(texts: DataFrame, text_col: str) -> DataFrame:
    """context (the byte before, 0 at a start) and n, how many bytes of the corpus it routes; summed map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                if len(data):
                    total += np.bincount(data[:-1], minlength=256)
                    total[0] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["context", "n"])

    return texts.select(text_col).mapInArrow(run, "context int, n bigint").groupBy("context").agg(F.sum("n").alias("n"))


def text_like(printable: Column, n: Column, num: int, den: int) -> Column:
    """Whether printable / n is num / den at least, in whole numbers; nothing is text."""
    return (n == 0) | (printable * den >= n * num)
