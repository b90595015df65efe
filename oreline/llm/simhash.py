"""SimHash near-duplicates through pivot distance tables (operator 2).

A document's fingerprint has bit i set where over half of its shingle hashes
have it. Fingerprints link at ``most`` or fewer differing bits; components are
taken over all links.

Finding links, exactly: of ``blocks`` blocks of a fingerprint at most ``most`` differ
between linked ones, so both agree in some choice of ``blocks - most``
blocks; each choice is a table of buckets. (Distances to pivots alone can't
deal fingerprints to tasks: they gather within a few bits of 32.) Within a
bucket the table of Hamming distances to reference fingerprints,
made once per fingerprint, discards every pair with a coordinate more than
``most`` apart; the others are verified on their bits. A bucket hands on a
spanning star per linked group, not its pairs.

Buckets above ``split`` rows are first dealt to parts, each row once, and linked
within their parts. What that connects needs no further pair: in a second pass the rows of a bucket's
largest component stay dealt and only the others are sent to all of its parts. If the others
are over ``split`` as well, the bucket is dealt anew by blocks of the bits that it leaves open (a pair
agrees on one of ``most + 1`` of those), and what is still large then by pairs of parts. So copies,
near copies and unlike rows that share a bucket are neither gathered nor dropped.

For links by similarity (``similar_links``) fingerprints have several lanes of 64 bits and
differ in so many bits that no block need agree; there each table keys on bits drawn
at random, as many tables as find a pair at the threshold with probability
``recall``. References are then taken from the fingerprints at hand, since random ones are
equally far from all.

Defined cases: null and empty texts and texts without words have fingerprint 0 and
link like any other; a text of any length is read whole; exact copies share one fingerprint and are handled
once; a null id never is a component's id unless it has no other; repeated rows are returned as
often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, cut, unused
from oreline.llm.components import connected_components

#: Steps of a 64-bit counter whose mixed values are further hashes of a shingle.
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes_of(text: str, shingle: int = 4, seed: int = 42, lanes: int = 1) -> np.ndarray:
    """SimHash over word shingles, ASCII lower case, ASCII white space: ``lanes`` unsigned longs, the first from the shingles' XXH64."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(lanes, dtype="<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:], strict=False)]
    totals = np.zeros(64 * lanes, dtype=np.int64)
    h = np.array(hashes, dtype="<u8")
    for lo in range(0, len(h), 1 << 14):
        part = h[lo : lo + (1 << 14), None]
        if lanes > 1:
            part = np.hstack([part, _mixed(part + STEP * np.arange(1, lanes, dtype="<u8"))])
        totals += np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * totals > len(h), bitorder="little").view("<u8")


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint."""
    return int(lanes_of(text, shingle, seed)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, lanes: int = 1, keep: tuple[Column, ...] = ()) -> DataFrame:
    """id_col, the columns ``keep`` and fp: the bits as a signed long, or in binary if there are several lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            values = np.array([lanes_of(t or "", shingle, seed, lanes) for t in texts], dtype="<u8").reshape(-1, lanes)
            fp = pa.array(values[:, 0].astype(np.uint64).view(np.int64)) if lanes == 1 else pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*batch.schema.names[:-1], "fp"])

    asked = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])
    return batched(asked).mapInArrow(run, f"{fields}, fp {'bigint' if lanes == 1 else 'binary'}")


def pivot_fingerprints(count: int) -> np.ndarray:
    """Reference fingerprints of 64 bits: hashes of their numbers."""
    return np.array([[xxhash.xxh64_intdigest(str(i).encode(), 7)] for i in range(count)], dtype=np.uint64)


def blocks_for(distinct: int, most: int, bucket: int = 512) -> int:
    """The fewest blocks that make mean buckets of at most ``bucket`` fingerprints."""
    blocks = most + 1
    while blocks < 16 and distinct > bucket << (64 // blocks) * (blocks - most):
        blocks += 1
    return blocks


def bucket_tables(blocks: int, most: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each table its number and the (shift, width) of the blocks it keys on."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in itertools.pairwise(edges)]
    return list(enumerate(list(c) for c in itertools.combinations(spans, blocks - most)))


def _key(spans: list[tuple[int, int]]):
    key = F.lit(0).cast("bigint")
    for shift, width in spans:
        part = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))
        key = F.shiftleft(key, width).bitwiseOR(part)
    return key


class _Forest:
    """Groups of n things, by least member."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        low = self.low
        while len(a):
            ra, rb = low[a], low[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(low, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = low[low]
                if np.array_equal(up, low):
                    break
                low[:] = up


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def bucket_links(
    fps: np.ndarray, group: np.ndarray, part: np.ndarray, across: np.ndarray, root: np.ndarray, pivots: np.ndarray, most: int, pairs_at_once: int = 1 << 18
) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member), as places, of the fingerprints (rows of lanes) linked within each group.

    Only pairs of different roots count and, where ``across`` is set, of different parts. All groups are worked on together: in the order of
    group and distance to the first pivot, a fingerprint's partners are the run that follows it.
    """
    n = len(fps)
    table = np.stack([_apart(fps, p) for p in pivots])
    key = group.astype(np.int64) * 4096 + table[0]
    order = np.argsort(key, kind="stable")
    key, fps, part, across, root, table = key[order], fps[order], part[order], across[order], root[order], np.ascontiguousarray(table[:, order])
    # keys of two groups are further apart than any radius
    counts = np.searchsorted(key, key + min(most, 2047), side="right") - np.arange(n) - 1
    total = np.cumsum(counts)
    forest = _Forest(n)
    lo = 0
    while lo < n:
        before = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + pairs_at_once, side="right")))
        own = counts[lo:hi]
        a = np.repeat(np.arange(lo, hi), own)
        b = np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own) + a + 1
        apart = (root[a] != root[b]) & (~across[a] | (part[a] != part[b]))
        a, b = a[apart], b[apart]
        for row in table[1:]:
            if not len(a):
                break
            near = np.abs(row[a] - row[b]) <= most
            a, b = a[near], b[near]
        near = _apart(fps[a], fps[b]) <= most
        forest.link(a[near], b[near])
        lo = hi
    member = np.flatnonzero(forest.low != np.arange(n))
    return order[member], order[forest.low[member]]


def _links_of(rows: DataFrame, most: int, pivots: int) -> DataFrame:
    """Star edges (a, b) within each group (tbl, key, i, j) of rows with fp, part and root."""
    keys = ["tbl", "key", "i", "j"]
    kind = rows.schema["fp"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivot_fingerprints(pivots)
        held: list | None = None

        def found(columns: list, edges: list[int]) -> pa.RecordBatch:
            """Links of the groups that begin at all but the last of ``edges``."""
            stop = edges[-1]
            fps = columns[0][:stop]
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            own = refs if fps.shape[1] == 1 or not stop else fps[np.linspace(0, stop - 1, min(pivots, stop)).astype(int)]
            a, b = bucket_links(fps, group, columns[5][:stop], columns[3][:stop] != columns[4][:stop], columns[6][:stop], own, most) if stop else ([], [])
            out = [fps[x][:, 0].view(np.int64) if kind == "bigint" else pa.array([v.tobytes() for v in fps[x]], pa.binary()) for x in (np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b"])

        for batch in batches:
            first = batch.column(0)
            fps = first.to_numpy(zero_copy_only=False).view(np.uint64)[:, None] if kind == "bigint" else _matrix(first)
            columns = [fps, *(batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7))]
            if held is not None:
                columns = [np.concatenate([x, y]) if len(x) else y for x, y in zip(held, columns, strict=True)]
            change = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
            for k in range(1, 5):
                change |= columns[k][1:] != columns[k][:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            yield found(columns, edges)
            held = [x[edges[-1] :] for x in columns]
        if held is not None and len(held[0]):
            yield found(held, [0, len(held[0])])

    dealt = rows.select("fp", *keys, "part", "root").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return batched(dealt).mapInArrow(run, f"a {kind}, b {kind}")


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary fingerprints of one length as rows of lanes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<u8").reshape(len(values), -1)


def _sized(rows: DataFrame, split: int, broadcast_rows: int = 50_000) -> tuple[DataFrame, int]:
    """``rows`` with ``parts``, which is above 1 in buckets above ``split`` rows, and the number of those."""
    large = cut(rows.groupBy("tbl", "key").count().where(F.col("count") > split).select("tbl", "key", F.ceil(F.col("count") / max(1, split // 2)).cast("int").alias("parts")))
    n = large.count()
    if not n:
        return rows.withColumn("parts", F.lit(1)), 0
    return rows.join(F.broadcast(large) if n <= broadcast_rows else large, ["tbl", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))), n


def _edges(rows: DataFrame, most: int, pivots: int, split: int, open_bits: list[list[int]] | None = None) -> DataFrame:
    """Edges that connect every pair of fp at ``most`` or fewer bits within a bucket (tbl, key) of ``rows``.

    ``open_bits`` gives for each tbl the masks of the blocks by which a large bucket can be dealt anew.
    """
    own_root = F.col("fp") if rows.schema["fp"].dataType.simpleString() == "bigint" else F.xxhash64("fp")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    sized, n = _sized(rows, split)
    sized = sized.withColumn("part", part)
    once = sized.select("fp", "tbl", "key", "part", F.col("part").alias("i"), F.col("part").alias("j"), own_root.alias("root"))
    if not n:
        return _links_of(once, most, pivots)
    stars = connected_components(_links_of(once, most, pivots))
    # the rows of large buckets with their component; the largest component of a bucket needs no pairs of its own
    hot = sized.where("parts > 1").join(stars, F.col("fp") == F.col("a"), "left").select("fp", "tbl", "key", "parts", "part", F.xxhash64(F.coalesce("b", "fp")).alias("root"))
    hot = cut(hot)
    sizes = hot.groupBy("tbl", "key", "root").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("tbl", "key").agg(F.max(F.struct("n", "root"))["root"].alias("top"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    buckets = cut(buckets, n)
    mixed = hot.join(F.broadcast(buckets) if n <= 50_000 else buckets, ["tbl", "key"])
    every = F.explode(F.when(F.col("root") == F.col("top"), F.array("part")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    # few others: all pairs that count are within the parts of the largest component and of them
    spread = mixed.where(F.col("others") <= split).select("fp", "tbl", "key", "root", every.alias("i")).select("fp", "tbl", "key", F.lit(0).alias("part"), "i", F.col("i").alias("j"), "root")
    many = mixed.where(F.col("others") > split).select("fp", "tbl", "key", "root")
    if open_bits:
        masks = F.element_at(F.array(*[F.array(*[F.lit(m) for m in own]) for own in open_bits]), F.col("tbl") + 1)
        many = many.select("fp", "root", "tbl", "key", F.posexplode(masks).alias("block", "mask"))
        many = many.select("fp", "root", (F.col("tbl") + (F.col("block") + 1) * 65536).alias("tbl"), F.xxhash64("key", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    else:
        many = many.withColumn("tbl", F.col("tbl") + 65536)
    many, _ = _sized(cut(many), split)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    crossed = many.select("fp", "tbl", "key", "root", part.alias("part"), other.alias("other"))
    crossed = crossed.select("fp", "tbl", "key", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "root")
    return stars.unionAll(_links_of(spread.unionByName(crossed), most, pivots))


def links(distinct: DataFrame, *, most: int = 4, pivots: int = 32, split: int = 1024, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect every pair of distinct 64-bit fingerprints ``fp`` at ``most`` or fewer bits.

    ``distinct`` should be materialized; it is counted to choose the tables.
    """
    tables = bucket_tables(blocks or blocks_for(distinct.count(), most), most)
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("tbl"), _key(spans).alias("key")) for t, spans in tables])).alias("k")).select("fp", "k.tbl", "k.key")
    return _edges(rows, most, pivots, split, [open_masks(spans, most) for _, spans in tables])


def open_masks(spans: list[tuple[int, int]], most: int) -> list[int]:
    """The bits outside ``spans`` in ``most + 1`` blocks, as signed masks."""
    taken = {b for shift, width in spans for b in range(shift, shift + width)}
    rest = [b for b in range(64) if b not in taken]
    edges = [len(rest) * i // (most + 1) for i in range(most + 2)]
    return [int(np.uint64(sum(1 << b for b in rest[a:z])).view(np.int64)) for a, z in itertools.pairwise(edges)]


def radius(similarity: float, lanes: int) -> tuple[float, int]:
    """The share of bits that differ where shingle sets have this Jaccard similarity, and a radius one standard error above it."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return share, int(64 * lanes * share + math.sqrt(64 * lanes * share * (1 - share)))


def bands_for(distinct: int, share: float, recall: float, bucket: int = 64) -> tuple[int, int]:
    """Tables and bits in each: buckets of ``bucket`` unlike rows in the mean, pairs that differ in ``share`` of their bits found with probability ``recall``."""
    width = min(32, max(8, math.ceil(math.log2(max(1, distinct) / bucket)) if distinct > bucket else 8))
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** width)), width


def similar_links(distinct: DataFrame, *, similarity: float, lanes: int, recall: float = 0.97, pivots: int = 16, split: int = 1024) -> DataFrame:
    """Edges (a, b) of distinct binary fingerprints ``fp`` whose bits show this similarity, of which ``recall`` are looked for at the threshold and more above."""
    share, most = radius(similarity, lanes)
    tables, width = bands_for(distinct.count(), share, recall)
    picked = np.random.default_rng(5).permuted(np.tile(np.arange(64 * lanes), (tables, 1)), axis=1)[:, :width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                own = batch.column(0).slice(lo, 2048)
                bits = np.unpackbits(_matrix(own).view(np.uint8), axis=1, bitorder="little")
                keys = np.stack([bits[:, at] @ powers for at in picked], axis=1)
                fp = own.take(pa.array(np.repeat(np.arange(len(own)), tables)))
                yield pa.RecordBatch.from_arrays([fp, pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(keys.reshape(-1))], names=["fp", "tbl", "key"])

    return _edges(batched(distinct.select("fp")).mapInArrow(run, "fp binary, tbl int, key bigint"), most, pivots, split)


def _settled(distinct: DataFrame, edges: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """fp and lowest, the least ``least`` of its component, for every row (fp, least) of ``distinct``."""
    stars = connected_components(edges)
    # only fingerprints with partners need a component; roots stand for themselves
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionAll(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    # few rows come out of a join of all: dealt anew, so that the join keeps its tasks and the result has few files
    size = stars.count()
    rooted = cut(distinct.join(members, "fp").select("fp", "least", "root").repartition(1 + size // 50_000))
    lowest = cut(rooted.groupBy("root").agg(F.min("least").alias("lowest")), size)
    linked = rooted.join(F.broadcast(lowest) if size <= broadcast_rows else lowest, "root").select("fp", "lowest")
    return cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("lowest")))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, most: int = 4, pivots: int = 32, split: int = 1024
) -> DataFrame:
    """id_col, fp, fingerprint (16 hex digits) and component_id, the least id in the document's component."""
    own = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    distinct = cut(own.groupBy("fp").agg(F.min(id_col).alias("least")))
    by_fp = _settled(distinct, links(distinct, most=most, pivots=pivots, split=split))
    return own.join(by_fp, "fp").select(F.col(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lowest").alias("component_id"))


def one_of_each_group(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    lanes: int = 4,
    recall: float = 0.97,
    seed: int = 42,
    split: int = 1024,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """One row of each group of copies and near copies; columns as they were.

    Rows link where fingerprints of ``lanes`` times 64 bits show a Jaccard similarity of ``similarity`` or more between
    their shingle sets, with one standard error of allowance. The row with the least id stays
    (null ids last, then by a hash of the text), so rows are told apart by id and text: an id on two
    unlike texts keeps both, and of rows with one id and one text the least by its columns stays, a null id being an id
    like any other. Texts without words are one group. An empty table gives an empty result; texts of any length are read whole.
    """
    h = F.xxhash64(F.col(text_col))
    own = cut(fingerprints(docs.withColumnRenamed(id_col, "_id"), id_col="_id", text_col=text_col, shingle=shingle, seed=seed, lanes=lanes, keep=(h.alias("_h"),)))
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_h").alias("h"))
    distinct = cut(own.groupBy("fp").agg(F.min(key).alias("least")))
    by_fp = _settled(distinct, similar_links(distinct, similarity=similarity, lanes=lanes, recall=recall, split=split))
    rows = own.groupBy("fp", "_id", "_h").agg(F.count("*").alias("n")).join(by_fp, "fp")
    stays = F.col("_id").eqNullSafe(F.col("lowest.id")) & (F.col("_h") == F.col("lowest.h"))
    ruled = cut(rows.select("_id", "_h", "n", stays.alias("stays")).where("not stays or n > 1"))
    i, t = unused(docs, "_gone_id", "_gone_text")

    def among(keys: DataFrame) -> tuple[DataFrame, Column]:
        keys = keys.select(F.col("_id").alias(i), F.col("_h").alias(t))
        return F.broadcast(keys) if keys.count() <= broadcast_rows else keys, F.col(id_col).eqNullSafe(F.col(i)) & (h == F.col(t))

    gone, again = ruled.where("not stays").distinct(), ruled.where("stays")
    left = docs.join(*among(gone), "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    keys, same = among(again)
    # rows that are repeated as they are: map-side minima, whatever their number
    once = left.join(keys, same, "left_semi").groupBy(F.col(id_col).alias(i), h.alias(t)).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return left.join(keys, same, "left_anti").select(*docs.columns).unionByName(once.select("_row.*"))
