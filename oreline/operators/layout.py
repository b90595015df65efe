"""Record layout of byte strings: periods, fields and lanes, in one Arrow pass per text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oreline.operators.bytestats import entropy


def counts_of(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_counts=True)[1]


def match_counts(b: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes at each lag from 1 on."""
    n = len(b)
    most = min(most, n - 1)
    free = np.flatnonzero(np.bincount(b, minlength=256) == 0).astype(np.uint8)
    if most < 1 or len(free) < 2:
        return np.array([np.count_nonzero(b[p:] == b[:-p]) for p in range(1, most + 1)], dtype=np.int64)
    # both sides are filled up with bytes that equal nothing, so that lags are rows of whole words of bits
    m = -(-n // 64) * 64
    left, right = np.full(m, free[0]), np.full(m + most, free[1])
    left[:n] = right[:n] = b
    rows = np.lib.stride_tricks.sliding_window_view(right, m)[1:]
    step = max(1, (1 << 16) // m)
    same = [np.bitwise_count(np.packbits(rows[i : i + step] == left, axis=1).view(np.uint64)).sum(axis=1, dtype=np.int64) for i in range(0, most, step)]
    return np.concatenate(same)


def match_fractions(b: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Of each lag: lag, equal bytes and compared bytes."""
    return [(p, same, len(b) - p) for p, same in enumerate(match_counts(b, most).tolist(), 1)]


def period_cost(b: np.ndarray, p: int, column_bits: float = 64.0) -> float:
    """Bits of the text as records of ``p`` bytes, each byte a difference from the record before."""
    n = len(b) // p
    if n < 4:
        return math.inf
    d = np.diff(b[: n * p].reshape(n, p).astype(np.int32), axis=0) & 0xFF
    d += np.arange(p, dtype=np.int32) << 8
    keys = np.sort(d, axis=None)
    c = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])))
    return float((c * np.log2((n - 1) / c)).sum()) + column_bits * p + 8.0 * (len(b) - n * p)


def discover_period(b: np.ndarray, most: int = 1024, candidates: int = 24) -> tuple[int, float] | None:
    """The cheapest of the lags that match best and, against aliases, the divisors of the first of them."""
    same = match_counts(b, most)
    lags = np.argsort(-same / (len(b) - np.arange(1, len(same) + 1)), kind="stable") + 1
    tried = [p for p in lags[: candidates // 2 + 1].tolist() if p >= 2][: candidates // 2]
    for p in tried[:4]:
        tried += [q for q in range(2, p) if p % q == 0 and q not in tried][: max(0, candidates - len(tried))]
    costs = [(period_cost(b, p), p) for p in tried]
    best = min(costs, default=(math.inf, 0))
    return (best[1], best[0]) if best[0] < math.inf else None


FIELD_KINDS = ("const", "posmod", "prev", "delta")


def field_costs(columns: np.ndarray, number: np.ndarray) -> dict[str, float]:
    """Bits for all records of a field (records x width bytes) under each class; each class charged in one unit, total bits."""
    n, width = columns.shape
    value = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, 8)):
        value |= columns[:, k].astype(np.uint64) << np.uint64(8 * k)
    costs = {}
    if (columns == columns[0]).all():
        costs["const"] = 8.0 * width
    step = np.diff(value)
    modulus = 0
    if len(step):
        wrapped = np.unique(step)
        if len(wrapped) == 2:  # an affine count that wraps by one modulus
            modulus = int(wrapped[1] - wrapped[0])
        if len(wrapped) == 1 or (modulus and np.array_equal(value, (value[0] + number.astype(np.uint64) * step.min()) % np.uint64(modulus))):
            costs["posmod"] = 8.0 * (3 * width)
    same = (columns[1:] == columns[:-1]).all(axis=1)
    costs["prev"] = 8.0 * width + n + 8.0 * width * int((~same).sum())
    costs["delta"] = 8.0 * width + entropy(counts_of(step)) * len(step) + 8.0 * width * len(np.unique(step))
    return costs


def partition_record(b: np.ndarray, period: int, widest: int = 8, field_bits: float = 24.0) -> list[tuple[int, int, str, float]]:
    """The cheapest cut of a record of ``period`` bytes into fields: offset, width, class and bits of each, by dynamic programming."""
    n = len(b) // period
    rows = b[: n * period].reshape(n, period)
    number = np.arange(n)
    best: list[tuple[float, tuple | None]] = [(0.0, None)] + [(math.inf, None)] * period
    for end in range(1, period + 1):
        for width in range(1, min(widest, end) + 1):
            kind, cost = min(field_costs(rows[:, end - width : end], number).items(), key=lambda x: (x[1], FIELD_KINDS.index(x[0])))
            total = best[end - width][0] + cost + field_bits
            if total < best[end][0]:
                best[end] = (total, (end - width, width, kind, cost))
    fields, at = [], period
    while at:
        fields.append(best[at][1])
        at = fields[-1][0]
    return fields[::-1]


def lane(b: np.ndarray, offset: int, stride: int, width: int) -> np.ndarray:
    """Little-endian words of ``width`` bytes from ``offset`` on, ``stride`` apart."""
    at = np.arange(offset, len(b) - width + 1, stride)
    value = np.zeros(len(at), dtype=np.int64)
    for k in range(width):
        value |= b[at + k].astype(np.int64) << (8 * k)
    return value


def tiling_cost(b: np.ndarray, stride: int, width: int, order: int, seed_bits: int = 32, framing_bits: int = 64) -> float | None:
    """Bits of a tiling of all lanes of ``width`` in ``stride``, differenced ``order`` times, with seeds and framing."""
    n = len(b)
    if stride % width or n < width:
        return None
    total, lanes = 0.0, 0
    for offset in range(0, stride, width):
        v = lane(b, offset, stride, width)
        if len(v) < 8:
            continue
        if len(v) <= order + 1:
            return None
        d = np.diff(v, n=order)
        total += entropy(counts_of(d)) * len(d) + (order + 1) * seed_bits
        lanes += 1
    if not lanes:
        return None
    covered = stride // width * ((n - width) // stride + 1) * width
    return total + 8.0 * (n - covered) + framing_bits


def lane_rates(b: np.ndarray, strides: range, widths: tuple[int, ...] = (1,), orders: tuple[int, ...] = (0, 1, 2), least: int = 64) -> list[tuple]:
    """Of each lane with ``least`` words: width, offset, stride, order, words, bits per covered byte (9 places)."""
    found = []
    for width in widths:
        for stride in strides:
            if stride < width:
                continue
            for offset in range(width):
                v = lane(b, offset, stride, width)
                if len(v) < least:
                    continue
                for k in orders:
                    d = np.diff(v, n=k)
                    found.append((width, offset, stride, k, len(v), round(entropy(counts_of(d)) * len(d) / (len(v) * stride), 9)))
    return found


def least_bits(b: np.ndarray, offsets: int, stride: int, words: int, orders: tuple[int, ...], logs: np.ndarray) -> np.ndarray:
    """orders x offsets: bits that the first ``words`` words take at least, whatever their width: those of their low bytes' differences.

    Neither merging values nor leaving words out adds bits; ``logs`` holds c log2 c.
    """
    x = b[np.arange(offsets)[:, None] + stride * np.arange(words)].astype(np.int16)
    bits = np.zeros((len(orders), offsets))
    for i, k in enumerate(orders):
        if words > k:
            d = (np.diff(x, n=k, axis=1) & 0xFF) + (np.arange(offsets, dtype=np.int16)[:, None] << 8)
            c = np.bincount(d.ravel(), minlength=offsets << 8).reshape(offsets, 256)
            bits[i] = logs[words - k] - logs[c].sum(axis=1)
    return bits


def best_lanes(b: np.ndarray, most: int, strides: range = range(1, 65), widths: tuple[int, ...] = (1, 2, 4, 8), orders: tuple[int, ...] = (0, 1, 2), least: int = 64) -> list[tuple]:
    """The ``most`` lanes of lane_rates with the lowest rates, equal ones in order of width, offset, stride and order of differences.

    Lanes are rated in order of a bound on their rate until the bound proves the rest out.
    """
    n = len(b)
    logs = np.arange(n + 1) * np.log2(np.maximum(np.arange(n + 1), 1))
    lanes, bounds = [], []
    for stride in strides:
        pairs = np.array([(w, o) for w in widths if w <= stride for o in range(w)], dtype=np.int64).reshape(-1, 2)
        words = (n - pairs.sum(axis=1)) // stride + 1
        pairs, words = pairs[words >= least], words[words >= least]
        if not len(pairs):
            continue
        bits = least_bits(b, int(pairs[:, 1].max()) + 1, stride, int(words.min()), orders, logs)
        bounds.append((bits[:, pairs[:, 1]] / (words * stride)).ravel())
        lanes += [(w, o, stride, k) for k in orders for w, o in pairs.tolist()]
    if not lanes:
        return []
    bound = np.concatenate(bounds)
    best: list[tuple] = []
    for i in np.argsort(bound, kind="stable").tolist():
        if len(best) == most and bound[i] > best[-1][0] + 2e-9:
            break
        w, o, stride, k = lanes[i]
        v = lane(b, o, stride, w)
        d = np.diff(v, n=k)
        rate = round(entropy(counts_of(d)) * len(d) / (len(v) * stride), 9)
        best = sorted([*best, (rate, w, o, stride, k, len(v))])[:most]
    return [(w, o, stride, k, m, rate) for rate, w, o, stride, k, m in best]


def per_text(texts: DataFrame, id_col: str, text_col: str, kernel: Callable[[np.ndarray], list[tuple]], fields: str, most_rows: int = 65_536) -> DataFrame:
    """The rows that ``kernel`` gives for each text's bytes; ``fields`` names their columns (bigint, double or string)."""
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    names, types = zip(*[(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in fields.split(", ")], strict=True)

    def out(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[id_col, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = kernel(np.frombuffer((text or "").encode(), dtype=np.uint8))
                at += [i] * len(own)
                rows += own
                if len(rows) >= most_rows:
                    yield out(batch, at, rows)
                    at, rows = [], []
            yield out(batch, at, rows)

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, {fields}")
