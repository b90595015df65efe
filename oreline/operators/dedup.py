"""Duplicates, shared content and independence units.

Links within a group are stars to its least member, never all pairs: they
connect the same components. Components are found by alternating stars. Where
links themselves are the result, they are between different texts only, with
each copy's class beside them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.operators.records import fixed_blocks
from oreline.session import cut


def classes(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """id_col, key, class_id (the least id with that key): copies by aggregation and a join, null keys apart."""
    keyed = rows.select(id_col, key.alias("key"))
    least = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min(id_col).alias("class_id"), F.count("*").alias("class_size"))
    return keyed.join(least, "key", "left").select(id_col, "key", F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def star_links(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """Links (a, b) from each key's least id a to every other id b; null keys link nothing."""
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(id_col).alias("b"), F.col(key).alias("_k")).distinct()
    least = keyed.groupBy("_k").agg(F.min("b").alias("a"))
    return keyed.join(least, "_k").where("a < b").select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """member and root (the least node reached) for every node that isn't its own root, by alternating large and small stars."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("_b"))).select("a", F.least("a", "_b").alias("low"))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("member"), F.col("b").alias("root"))


def with_roots(rows: DataFrame, id_col: str, links: DataFrame) -> DataFrame:
    """id_col and root for every row."""
    c = components(links)
    return rows.select(id_col).join(c.select(F.col("member").alias(id_col), "root"), id_col, "left").select(id_col, F.coalesce("root", id_col).alias("root"))


def unit_ids(rooted: DataFrame, id_col: str, largest: int = 100_000) -> DataFrame:
    """root, size and unit: 'iu-' and 16 hex digits of the SHA-256 of the sorted members.

    The members of a unit above ``largest`` aren't gathered: they are hashed one after the other as they come sorted.
    """
    sized = rooted.groupBy("root").agg(F.count("*").alias("size"))
    listed = rooted.join(sized.where(F.col("size") <= largest), "root").groupBy("root", "size").agg(F.array_sort(F.collect_list(id_col)).alias("_m"))
    small = listed.select("root", "size", F.sha2(F.array_join(F.transform("_m", lambda x: x.cast("string")), ","), 256).alias("_d"))
    members = rooted.join(sized.where(F.col("size") > largest), "root").repartition("root").sortWithinPartitions("root", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = size = digest = None
        done: list[tuple] = []
        for batch in batches:
            for own, n, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or own != root:
                    if digest is not None:
                        done.append((root, size, digest.hexdigest()))
                    root, size, digest = own, n, hashlib.sha256(member.encode())
                else:
                    digest.update(b"," + member.encode())
        if digest is not None:
            done.append((root, size, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["root", "size", "_d"])

    kind = rooted.schema["root"].dataType.simpleString()
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind], pa.int64(), pa.string()]
    large = members.select("root", "size", F.col(id_col).cast("string")).mapInArrow(run, f"root {kind}, size bigint, _d string")
    return small.unionByName(large).select("root", "size", F.concat(F.lit("iu-"), F.substring("_d", 1, 16)).alias("unit"))


def normalise_line_ends(text: Column) -> Column:
    """Carriage returns dropped, but only before line feeds."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def block_digests(rows: DataFrame, id_col: str, text: Column, size: int) -> DataFrame:
    """id_col and digest of each full aligned block; a partial last block is left out."""
    blocks = F.transform(fixed_blocks(text, size, whole=True), lambda b: F.sha2(b, 256))
    return rows.select(id_col, F.explode(F.array_distinct(blocks)).alias("digest"))


def shared_blocks(digests: DataFrame, id_col: str) -> DataFrame:
    """id_col, blocks, and how many of them another id also has. A block that many share is only counted."""
    often = digests.groupBy("digest").agg(F.count("*").alias("n"))
    return digests.join(often, "digest").groupBy(id_col).agg(F.count("*").alias("blocks"), F.count_if(F.col("n") > 1).alias("shared_blocks"))


WORDS = re.compile(rb"[a-z0-9]+")


def shingle_sets(rows: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """id_col and s, the sorted distinct 64-bit hashes of a text's shingles, in one Arrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(1).to_pylist():
                words = WORDS.findall((text or "").replace("\r\n", "\n").encode().lower())
                grams = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
                digests = b"".join([hashlib.blake2b(g, digest_size=8).digest() for g in grams])
                sets.append(np.sort(np.frombuffer(digests, dtype=">i8").astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=[id_col, "s"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, s array<bigint>")


def partners(rows: DataFrame, id_col: str, key: str, allowed: Callable[[DataFrame, DataFrame], Column] | None = None, split: int = 1024) -> DataFrame:
    """Pairs (a, b), a below b, of rows with equal keys that ``allowed`` lets through, each once.

    The rows of a key with over ``split`` of them are dealt: a row meets the others in as many
    parts as ``split`` goes into their number, so that no task has all pairs of a frequent key.
    """
    often = rows.groupBy(key).agg(F.count("*").alias("_m")).where("_m > 1")
    sized = cut(rows.join(often, key).withColumn("_parts", F.ceil(F.col("_m") / split).cast("int")).drop("_m"))
    a = sized.withColumn("_r", F.pmod(F.xxhash64(id_col), "_parts").cast("int")).alias("a")
    b = sized.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._r") == F.col("b._r")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))
    found = a.join(b, on if allowed is None else on & allowed(a, b))
    return found.select(F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b")).distinct()


def bucket_counts(sets: DataFrame, buckets: int = 1 << 20) -> np.ndarray:
    """How many shingles fall in each of ``buckets`` by their low bits, counted map-side; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (buckets - 1), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = sets.select("s").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(kinds: DataFrame, num: int, den: int) -> DataFrame:
    """id, n (shingles of the set), g and p: its first n - ceil(n num / den) + 1 shingles and their places from 1, those of rarer buckets first.

    A shingle alone in its bucket can't make a pair; it only takes a place.
    """
    shared = kinds.sparkSession.sparkContext.broadcast(bucket_counts(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            row, size, gram, place = [], [], [], []
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, end in enumerate(ends.tolist()):
                own = flat[ends[i - 1] if i else 0 : end]
                weight = often[own & (len(often) - 1)]
                first = np.lexsort((own, weight))[: len(own) - -(-len(own) * num // den) + 1]
                p = np.flatnonzero(weight[first] > 1)
                row.append(np.full(len(p), i))
                size.append(np.full(len(p), len(own), dtype=np.int32))
                gram.append(own[first[p]])
                place.append((p + 1).astype(np.int32))
            join = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, dtype=kind), *parts]).astype(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(join(row, np.int64)), join(size, np.int32), join(gram, np.int64), join(place, np.int32)], names=["id", "n", "g", "p"])

    return kinds.select("id", "s").mapInArrow(run, f"id {kinds.schema['id'].dataType.simpleString()}, n int, g bigint, p int")


def similar_sets(sets: DataFrame, id_col: str, num: int = 4, den: int = 5, split: int = 1024) -> DataFrame:
    """Pairs (a, b) of different sets, each by its least id, with Jaccard num / den at least: shared and total shingles.

    Exact: in any one order of all shingles, similar sets share one of their first |s| - ceil(t |s|) + 1, so
    only sets that share such a shingle are compared, and compared in full if their sizes, and what follows the
    shingle in both, leave room for enough in common. The order is by the counts of hash buckets, rare ones
    first. Equal sets are one class; empty sets have no partner.
    """
    kinds = cut(sets.where(F.size("s") > 0).groupBy("s").agg(F.min(id_col).alias("id")))

    def room(a: DataFrame, b: DataFrame) -> Column:
        # of the first shingle that two sets share, and what follows it in the shorter rest, all they have in common is part
        rest = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) + 1
        sizes = (F.col("a.n") * den >= F.col("b.n") * num) & (F.col("b.n") * den >= F.col("a.n") * num)
        return sizes & (rest * (num + den) >= (F.col("a.n") + F.col("b.n")) * num)

    pairs = partners(prefixes(kinds, num, den), "id", "g", room, split)
    left, right = kinds.select(F.col("id").alias("a"), F.col("s").alias("sa")), kinds.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("total"))
    return found.where(F.col("shared") * den >= F.col("total") * num)


def set_key(hashes: str) -> Column:
    """128 bits of hash and the size of a sorted set; null if the set is null or empty."""
    return F.when(F.size(hashes) > 0, F.concat_ws(":", F.xxhash64(hashes), F.xxhash64(F.reverse(hashes)), F.size(hashes)))


def link_counts(rows: DataFrame, id_col: str, key: Column, pairs: DataFrame) -> DataFrame:
    """id_col, class_id (the least id with that key) and links, of how many other classes it has a pair (a, b); null keys have a class for each id."""
    ends = pairs.select("a").unionAll(pairs.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    own = classes(cut(rows.select(id_col, key.alias("_key"))), id_col, F.col("_key")).select(id_col, "class_id")
    return own.join(ends, "class_id", "left").select(id_col, "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


_finders: dict[str, tuple] = {}


def _finder(name: str, rows: list[tuple], anchor: int) -> tuple:
    """This worker's automaton over the items' first ``anchor`` characters, and the items of each beginning; built once."""
    import ahocorasick

    if name not in _finders:
        _finders.clear()
        automaton, items = ahocorasick.Automaton(), {}
        for item, text in rows:
            items.setdefault(text[:anchor], {}).setdefault(text, []).append(item)
        for begin in items:
            automaton.add_word(begin, begin)
        automaton.make_automaton()
        _finders[name] = automaton, items
    return _finders[name]


def contained(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, chunk_bytes: int = 32 << 20, anchor: int = 32) -> DataFrame:
    """id_col and item_col where a document holds an item's whole text.

    Items go to the workers in sets of at most ``chunk_bytes`` (a longer item is a set of its own), one pass over the documents for each. An
    automaton finds the first ``anchor`` characters of items, so its size is bounded by their number; the rest is compared in place.
    """
    rows = items.where(F.octet_length(item_text) > 0).select(item_col, item_text)
    total = rows.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    out = None
    for c in range(chunks):
        name = uuid.uuid4().hex
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.where(F.pmod(F.xxhash64(item_text), F.lit(chunks)) == c).collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton, items = _finder(name, shared.value, anchor) if shared.value else (None, {})
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist() if items else []):
                    own = set()
                    for end, begin in automaton.iter(text or ""):
                        own.update(x for whole, ids in items[begin].items() if text.startswith(whole, end + 1 - len(begin)) for x in ids)
                    at += [i] * len(own)
                    found += sorted(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, shared_type)], names=[id_col, item_col])

        shared_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
        part = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{item_col}` {item_kind}")
        out = part if out is None else out.unionAll(part)
    return out


PRIME = np.uint64((1 << 61) - 1)


def mulmod(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x y modulo 2^61 - 1, for x and y below it, in 64-bit arithmetic."""
    m32, m29 = np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
    xh, xl, yh, yl = x >> np.uint64(32), x & m32, y >> np.uint64(32), y & m32
    middle = xh * yl + xl * yh
    low = xl * yl
    return (np.uint64(8) * (xh * yh) + (middle >> np.uint64(29)) + ((middle & m29) << np.uint64(32)) + (low >> np.uint64(61)) + (low & PRIME)) % PRIME


def minhash_signatures(sets: DataFrame, id_col: str, permutations: int = 64) -> DataFrame:
    """id_col and sig: the least of (a h + b) mod 2^61 - 1 over a set's hashes, for each of the permutations."""
    rng = np.random.default_rng(61)
    a, b = rng.integers(1, int(PRIME), permutations, dtype=np.uint64), rng.integers(0, int(PRIME), permutations, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = []
            for s in batch.column(1).to_pylist():
                low = np.full(permutations, PRIME, dtype=np.uint64) if s else np.zeros(permutations, dtype=np.uint64)
                h = np.array(s or [], dtype=np.int64).view(np.uint64) % PRIME
                for lo in range(0, len(h), 4096):
                    low = np.minimum(low, ((mulmod(a[:, None], h[None, lo : lo + 4096]) + b[:, None]) % PRIME).min(axis=1))
                sigs.append(low.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.int64()))], names=[id_col, "sig"])

    return sets.select(id_col, "s").mapInArrow(run, f"`{id_col}` {sets.schema[id_col].dataType.simpleString()}, sig array<bigint>")


def minhash_pairs(sigs: DataFrame, id_col: str, bands: int = 16, num: int = 4, den: int = 5, split: int = 1024) -> DataFrame:
    """Pairs (a, b) of different signatures whose share of equal places is num / den at least, found through bands."""
    kinds = cut(sigs.groupBy("sig").agg(F.min(id_col).alias("id")))
    width = F.floor(F.size("sig") / bands).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * width + 1, width)))
    pairs = partners(kinds.select("id", F.explode(keys).alias("key")), "id", "key", split=split)
    left, right = kinds.select(F.col("id").alias("a"), F.col("sig").alias("x")), kinds.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(left, "a").join(right, "b").select("a", "b", same.alias("same"), F.size("x").alias("places")).where(F.col("same") * den >= F.col("places") * num)


def role_aggregate(rows: DataFrame, role: str, id_col: str, unit: str, consumed: str, heldout: list[str]) -> DataFrame:
    """Rows, ids and independence units for all roles, each role and held-out roles alone; consumed rows count only for ``all``."""
    tagged = rows.where(F.col(role).isNotNull()).select(
        F.explode(
            F.array_compact(
                F.array(F.lit("all"), F.when(~F.col(consumed), F.concat(F.lit("role:"), role)), F.when(~F.col(consumed) & F.col(role).isin(*heldout), F.lit("heldout")))
            )
        ).alias("scope"),
        id_col,
        unit,
    )
    out = tagged.groupBy("scope").agg(F.count("*").alias("n_rows"), F.countDistinct(id_col).alias("n_ids"), F.countDistinct(unit).alias("n_units"))
    return out.withColumn("promotion_authorised", (F.col("scope") == "heldout") & (F.col("n_units") > 0))
