"""Robust statistics of repeated measurements, and paired bootstrap intervals."""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def noise(value: str) -> dict[str, Column]:
    """Mean, sample deviation and CV in percent; one value has deviation 0."""
    mean, deviation = F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return {"mean": mean, "stddev": deviation, "cv_pct": F.coalesce(F.try_divide(deviation * 100.0, mean), F.lit(0.0))}


def robust_cv(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, med, mad, robust_cv = 1.4826 mad / median, infinite where the median isn't positive."""
    med = F.median(F.col(value)).over(Window.partitionBy(*keys))
    off = rows.select(*keys, F.col(value).alias("_v"), med.alias("med"))
    stats = off.groupBy(*keys, "med").agg(F.count("*").alias("n"), F.median(F.abs(F.col("_v") - F.col("med"))).alias("mad"))
    return stats.withColumn("robust_cv", F.when(F.col("med") > 0, F.lit(1.4826) * F.col("mad") / F.col("med")).otherwise(F.lit(float("inf"))))


def ordered_pick(keys: list[str], value: str, rank: Column, name: str):
    """For ``agg``: the value whose place in its group's order is ``rank`` (from 1)."""
    return F.max(F.when(F.col("_r") == rank, F.col(value))).alias(name)


def with_places(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with their place ``_r`` by value and their group's size ``_n``."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))




def harmonic_rate(n_bytes: str, rate: str) -> Column:
    """MB/s over all rows: megabytes by the sum of seconds."""
    return (F.sum(n_bytes) / 1e6) / F.sum((F.col(n_bytes) / 1e6) / F.greatest(F.col(rate), F.lit(1e-12)))


def stream_draws(seed: int, n: int, size: int) -> Iterator[np.ndarray]:
    """Rows of ``size`` numbers below ``n``, as ``random.Random(seed).randrange(n)`` gives them one after the other."""
    _, state, _ = random.Random(seed).getstate()
    words = np.random.RandomState()
    words.set_state(("MT19937", np.array(state[:-1], dtype=np.uint32), state[-1]))
    shift = np.uint32(32 - n.bit_length())
    rest = np.zeros(0, dtype=np.uint32)
    while True:
        drawn = words.randint(0, 1 << 32, max(1 << 18, 2 * size), dtype=np.uint32) >> shift
        rest = np.concatenate([rest, drawn[drawn < n]])
        rows = len(rest) // size
        yield rest[: rows * size].reshape(rows, size)
        rest = rest[rows * size :]


#: Numbers drawn for one size of group that are counted and kept, so that all groups of that size share them.
SHARED_DRAWS = 1 << 25


@functools.lru_cache(maxsize=1)
def draw_counts(seed: int, n: int, samples: int) -> list[np.ndarray]:
    """How often each of n places (rows) is drawn in each sample (columns), a few samples at a time."""
    kind, out, done = np.min_scalar_type(n), [], 0
    for rows in stream_draws(seed, n, n):
        rows = rows[: samples - done]
        flat = (rows * np.uint32(len(rows)) + np.arange(len(rows), dtype=np.uint32)[:, None]).reshape(-1)
        out.append(np.bincount(flat, minlength=n * len(rows)).astype(kind).reshape(n, -1))
        done += len(rows)
        if done == samples:
            break
    each = max(1, (1 << 22) // (n * out[0].shape[1]))  # wide enough that a step over all samples outweighs its call
    return [np.concatenate(out[i : i + each], axis=1) for i in range(0, len(out), each)]


def middle_places(counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, in ``order``, of each sample's two middle members.

    Members up to a place are counted for all samples at once, from below the least median on to beyond the greatest.
    """
    n = len(order)
    below, above = (n - 1) // 2, n // 2
    p = max(0, n // 2 - int(2.5 * math.sqrt(n)) - 1)
    while True:
        upto = counts[order[:p]].sum(axis=0, dtype=counts.dtype)
        if p == 0 or int(upto.max()) <= below:
            break
        p //= 2
    low = np.full(counts.shape[1], p, dtype=counts.dtype)
    high = low.copy()
    for i in order[p:].tolist():
        upto += counts[i]
        short = upto <= above
        if not short.any():
            low += upto <= below
            break
        high += short
        low += upto <= below
    return low, high


def bootstrap_ratio(log_ratios: list[float], seed: int, samples: int) -> tuple[float, float, float]:
    """The median ratio and its 95 % bootstrap interval, drawn from the stream of Python's generator, which defines the result."""
    n = len(log_ratios)
    value = np.array(log_ratios, dtype=np.float64)
    order = np.argsort(value, kind="stable")
    value_at = value[order]
    medians, done = np.empty(samples), 0
    if n * samples <= SHARED_DRAWS:
        for counts in draw_counts(seed, n, samples):
            low, high = middle_places(counts, order)
            medians[done : done + len(low)] = (value_at[low] + value_at[high]) / 2
            done += len(low)
    else:
        place = np.empty(n, dtype=np.min_scalar_type(n))
        place[order] = np.arange(n)
        middle = sorted({(n - 1) // 2, n // 2})
        for rows in stream_draws(seed, n, n):
            places = np.partition(place[rows[: samples - done]], middle, axis=1)
            medians[done : done + len(places)] = (value_at[places[:, middle[0]]] + value_at[places[:, middle[-1]]]) / 2
            done += len(places)
            if done == samples:
                break
    medians.sort()
    return math.exp(median(log_ratios)), math.exp(medians[max(0, int(0.025 * samples))]), math.exp(medians[min(samples - 1, int(0.975 * samples))])


def paired_bootstrap(pairs: DataFrame, keys: list[str], order: str, control: str, candidate: str, seed: int = 1, samples: int = 20_000) -> DataFrame:
    """keys, n, ratio, ci_low, ci_high of candidate over control; a group's pairs are a bounded set of timings. Fewer than 1,000 samples are refused.

    Groups of one size draw the same numbers, so they are brought together and draw once.
    """
    if samples < 1000:
        raise ValueError("at least 1000 samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                logs = [math.nan if x is None or y is None else math.log(y / x) for x, y in zip(a, b, strict=True)]
                rows.append((len(logs), *bootstrap_ratio(logs, seed, samples)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*keys, "n", "ratio", "ci_low", "ci_high"])

    spark = pairs.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # null places last, as a sort in pandas has them
    own = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.col(control).alias("a"), F.col(candidate).alias("b"))
    groups = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("_v"))
    lists = groups.select(*keys, F.transform("_v", lambda x: x["a"]).alias("_a"), F.transform("_v", lambda x: x["b"]).alias("_b"), F.size("_v").alias("_n"))
    dealt = lists.repartitionByRange(parts, "_n", *keys).sortWithinPartitions("_n")
    types = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInArrow(run, f"{types}, n bigint, ratio double, ci_low double, ci_high double")
