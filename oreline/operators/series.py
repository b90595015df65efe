"""Numeric series: looks back along an order, blocks of words, and what models of a block cost.

Blocks hold a bounded number of words, so a block's models are one Arrow
function over one row. Words are taken modulo 2^32; differences are signed
ring values. Sizes charge every byte of the wire form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32


def uvar(n: int) -> int:
    return max(1, (int(n).bit_length() + 6) // 7)


def difference(value: str, keys: list[str], order: list[str], k: int = 1) -> Column:
    """The k-th difference along the order, null for the first k rows: a binomial sum over lags."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total, c = F.col(value), 1
    for i in range(1, k + 1):
        c = c * (k - i + 1) // i
        total = total + (-c if i % 2 else c) * F.lag(value, i).over(w)
    return total


def xor_previous(value: str, keys: list[str], order: list[str]) -> Column:
    """XOR with the value before; null for the first row."""
    return F.col(value).bitwiseXOR(F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def leading_zeros(x: Column, bits: int = 64) -> Column:
    return F.when(x == 0, bits).otherwise(bits - F.length(F.bin(x)))


def series_blocks(rows: DataFrame, keys: list[str], order: list[str], value: str, words: int = 1024) -> DataFrame:
    """keys, block, words: consecutive values of each ordered series, ``words`` of them at most."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = rows.select(*keys, i.alias("_i"), F.col(value).cast("bigint").alias("_v")).withColumn("block", F.floor(F.col("_i") / words))
    held = numbered.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_a"))
    return held.select(*keys, "block", F.col("_a._v").alias("words"))


def signed(x: np.ndarray) -> np.ndarray:
    return (x + RING // 2) % RING - RING // 2


def zig(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 2 * x, -2 * x - 1)


def upper_median(x: np.ndarray) -> int:
    return int(np.partition(x, len(x) // 2)[len(x) // 2])


def mode(x: np.ndarray) -> tuple[int, int]:
    """The commonest value and its count; ties to the smaller value."""
    values, counts = np.unique(x, return_counts=True)
    k = int(np.argmax(counts))
    return int(values[k]), int(counts[k])


def bits_of(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def fitted(v: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Step and base of the median line, the zigzag residuals around it, and the local innovations."""
    step = upper_median(signed((v[1:] - v[:-1]) % RING))
    i = np.arange(len(v))
    base = (int(v[0]) + upper_median(signed((v - v[0] - i * step) % RING))) % RING
    around = zig(signed((v - base - i * step) % RING))
    local = zig(signed((v[1:] - v[:-1] - step) % RING))
    return step, base, around, local


def tiled(residuals: np.ndarray, tile: int = 16) -> int | None:
    """Bytes of residuals in tiles with a width each, with tag, base and step; None if one needs 32 bits."""
    size = 9
    for lo in range(0, len(residuals), tile):
        part = residuals[lo : lo + tile]
        bits = bits_of(part)
        if bits >= 32:
            return None
        size += 1 + (len(part) * bits + 7) // 8
    return size


def modal_affine(v: np.ndarray) -> tuple[int, int, int, int] | None:
    """Step, base, exceptions and bytes of the commonest line with its exceptions; None if too few words lie on it."""
    count = len(v)
    if count < 2:
        return None
    raw = 1 + uvar(4 * count) + 4 * count
    step, support = mode((v[1:] - v[:-1]) % RING)
    if support * 2 < count - 1:
        return None
    base, on = mode((v - np.arange(count) * step) % RING)
    if count - on > min(count // 4, raw // 5):
        return None
    off = np.flatnonzero((v - np.arange(count) * step - base) % RING)
    size = 2 + uvar(count) + 8
    if len(off):
        size += uvar(len(off)) + 4 * len(off) + sum(map(uvar, np.diff(off, prepend=-1) - 1))
    return step, base, len(off), size


def strided(v: np.ndarray) -> list[tuple[int, int, int]]:
    """Of each stride from 2 to 12: stride, modelled lanes and bytes."""
    found = []
    for stride in range(2, 13):
        records = len(v) // stride
        if records < 3:
            break
        size, modelled = 2 + uvar(4 * len(v)) + 4 * (len(v) - records * stride), 0
        for lane in range(stride):
            raw = 1 + 4 * records
            bits = bits_of(fitted(v[lane : records * stride : stride])[2])
            model = 10 + (records * bits + 7) // 8
            if bits < 32 and model < raw:
                modelled += 1
                raw = model
            size += raw
        found.append((stride, modelled, size))
    return found


#: Fixed values of the probe: fewest words; strides and lanes looked at; steps of a lane that are looked at, and how many more words
#: it needs; what a small step is; and the share of them that must be small, in eighths.
PROBE_WORDS, PROBE_STRIDES, PROBE_LANES, PROBE_STEPS, PROBE_REACH, PROBE_SMALL, PROBE_EIGHTHS = 128, 12, 4, 32, 24, 4096, 7


def numeric_probe(v: np.ndarray) -> bool:
    """Whether some lane of words moves by small steps, over all strides and lanes at once.

    For every stride the differences of words that far apart are one array; a lane's first steps
    are a slice of a running count of the small ones.
    """
    n = len(v)
    if n < PROBE_WORDS:
        return False
    v = np.asarray(v, dtype=np.int64)
    for stride in range(1, PROBE_STRIDES + 1):
        lanes = np.arange(min(stride, PROBE_LANES))
        lanes = lanes[n > lanes + PROBE_REACH * stride]
        steps = np.minimum(PROBE_STEPS, (n - 1 - lanes) // stride)
        # rows are steps and columns are lanes; what is past a lane's steps never counts
        at = lanes + stride * np.arange(PROBE_STEPS)[:, None]
        inside = np.arange(PROBE_STEPS)[:, None] < steps
        step = signed((v[np.where(inside, at + stride, 0)] - v[np.where(inside, at, 0)]) % RING)
        if ((inside & (np.abs(step) <= PROBE_SMALL)).sum(axis=0) * 8 >= steps * PROBE_EIGHTHS).any():
            return True
    return False


MODEL_FIELDS = (
    "n_words bigint, raw_size bigint, step bigint, base bigint, median_bits bigint, median_size bigint, local_bits bigint, local_size bigint, tiled_size bigint, tiled_local_size bigint, "
    "modal_step bigint, modal_base bigint, exceptions bigint, modal_size bigint, stride bigint, stride_lanes bigint, stride_size bigint, regular boolean, model string, model_size bigint"
)
#: Models in order of preference among equal sizes; raw wins all ties.
MODELS = ("raw", "median", "local", "tiled", "tiled_local", "modal", "stride")


def block_models(v: np.ndarray) -> dict:
    n = len(v)
    out: dict = {"n_words": n, "raw_size": 1 + uvar(4 * n) + 4 * n, "regular": numeric_probe(v)}
    if n >= 3:
        step, base, around, local = fitted(v)
        head = 11 + uvar(n)
        out |= {"step": step, "base": base, "median_bits": bits_of(around), "local_bits": bits_of(local)}
        out["median_size"] = head + (n * out["median_bits"] + 7) // 8 if out["median_bits"] < 32 else None
        out["local_size"] = head + ((n - 1) * out["local_bits"] + 7) // 8 if out["local_bits"] < 32 else None
        out |= {"tiled_size": tiled(around), "tiled_local_size": tiled(local)}
        if lanes := strided(v):
            out |= dict(zip(("stride", "stride_lanes", "stride_size"), min(lanes, key=lambda x: (x[2], x[0])), strict=True))
    if (modal := modal_affine(v)) is not None:
        out |= dict(zip(("modal_step", "modal_base", "exceptions", "modal_size"), modal, strict=True))
    sizes = [(out.get(f"{m}_size"), k, m) for k, m in enumerate(MODELS)]
    out["model_size"], _, out["model"] = min((s, k, m) for s, k, m in sizes if s is not None)
    return out


def model_sizes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block and, of each block, every model's parameters and size and the cheapest model."""
    names = [f.split(" ")[0] for f in MODEL_FIELDS.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[f.split(" ")[1]] for f in MODEL_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [block_models(np.array(v, dtype=np.int64) % RING) for v in batch.column(len(keys) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)]], names=[*batch.schema.names[:-1], *names])

    own = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in [*keys, "block"])
    return blocks.select(*keys, "block", "words").mapInArrow(run, f"{own}, {MODEL_FIELDS}")


def payoff_rows(seed_cost: Column, k: int, entropy: Column, rival: Column) -> Column:
    """From how many values on a model pays; null if it never does."""
    return F.when(rival > entropy, F.floor((seed_cost - k * entropy) / (rival - entropy)) + 1)
