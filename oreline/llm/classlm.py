"""Language-model scores from Brown classes (operator 10).

Learning counts every training word, with a map-side combine. The units of the exchange clustering
are the ``frequent`` most frequent words of up to 64 bytes, the end mark and ``SHAPES`` groups of all other words (by length and last
byte). Their neighbour counts are summed as a sparse table, stored in blocks of whole rows. The ``core`` most
frequent units start the classes, exchanged one by one on a dense table. Then all units are exchanged in
rounds: with the classes of the round before, a task works out for each unit of its blocks, taken out of its own class, the class
that raises the class-bigram likelihood most; half of the units may move in a round, and rounds end when
less than one unit in 500 moves, or after ``rounds``. A word's probability is

    L * P(class | class before) * P(word | class) + (1 - L) * P(word)

with add-0.1 emissions. Both emissions are in proportion to the word's count
plus 0.1, so a text's score is the sum of log10(count + 0.1) over its
tokens and of a term per pair of neighbouring classes. The pair terms need only the
classes. Counts and classes of the ``frequent`` words are broadcast, a bounded
table; every other word's count comes from a join, and its class is its group's.

Defined cases: a null or empty text is its end mark alone; a text of any length is scored whole; with no training
rows all counts are zero; repeated rows count and are scored as often as they occur; an
empty table gives an empty result; other columns are ignored; a null id is held out.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import batched, fresh_path, groups_of_bytes, remove

END = b""  # no word is empty
SHAPES = 64


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def shapes_of(words: list[bytes]) -> np.ndarray:
    """The shape group of each word: its length up to 15 in pairs, and its last byte modulo 8."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(b"".join(words) or b"\0", dtype=np.uint8)
    last = raw[np.maximum(np.cumsum(lengths) - 1, 0)] & 7
    return np.minimum(lengths, 15) // 2 * 8 + last


def word_counts(docs: DataFrame, text_col: str, held: int = 300_000, held_bytes: int = 64 << 20) -> DataFrame:
    """word (binary), c. Tasks combine their own counts, up to ``held`` words or those of ``held_bytes`` of text, before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        seen: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens_of(t))
                size += len(t or "")
                if len(seen) > held or (size > held_bytes and len(seen) > held // 8):
                    yield out()
                    seen.clear()
                    size = 0
        yield out()

    return batched(docs.select(text_col)).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words of the highest count bands that together hold at most ``most`` words, frequent first.

    Bands are sixteenths of a power of two, so their number is bounded at any corpus size.
    """
    band = F.floor(F.log2("c") * 16)
    total, low = 0, None
    for r in sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):
        total += r["count"]
        if total > most:
            break
        low = r["band"]
    if low is None:
        return []
    rows = counts.where((band >= low) & (F.octet_length("word") <= 64)).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


class Exchange:
    """Exchange clustering of few units by their bigram counts, one by one; unit 0 keeps a class of its own."""

    def __init__(self, bigrams: np.ndarray, classes: int):
        self.b = bigrams.astype(np.float64)
        n = len(bigrams)
        self.k = max(2, min(classes, n))
        order = np.argsort(-self.b.sum(axis=1)[1:], kind="stable") + 1
        self.of = np.zeros(n, dtype=np.int64)
        self.of[order] = np.arange(n - 1) % (self.k - 1) + 1

    def run(self, rounds: int = 4) -> np.ndarray:
        b, k, h = self.b, self.k, _h
        z = np.eye(k)[self.of]
        to, fro = b @ z, b.T @ z  # each unit's counts before and after each class
        n = z.T @ to
        for _ in range(rounds):
            moved = 0
            for u in np.argsort(-b.sum(axis=1), kind="stable").tolist():
                if u == 0 or not (b[u].any() or b[:, u].any()):
                    continue
                old, own = self.of[u], b[u, u]
                r, c = to[u].copy(), fro[u].copy()
                r[old] -= own
                c[old] -= own
                n[old] -= r
                n[:, old] -= c
                n[old, old] -= own
                left, right = n.sum(axis=1) + c, n.sum(axis=0) + r
                diag = np.arange(k)
                gain = (h(n + r) - h(n)).sum(axis=1) + (h(n.T + c) - h(n.T)).sum(axis=1)
                d = n[diag, diag]
                gain += h(d + r[diag] + c[diag] + own) - h(d + r[diag]) - h(d + c[diag]) + h(d)
                gain -= h(left + r.sum() + own) - h(left) + h(right + c.sum() + own) - h(right)
                gain[0] = -np.inf
                new = int(np.argmax(gain))
                if gain[new] <= gain[old] + 1e-9:
                    new = int(old)
                n[new] += r
                n[:, new] += c
                n[new, new] += own
                if new != old:
                    to[:, old] -= b[:, u]
                    to[:, new] += b[:, u]
                    fro[:, old] -= b[u]
                    fro[:, new] += b[u]
                    self.of[u] = new
                    moved += 1
            if not moved:
                break
        return self.of


def best_classes(n: np.ndarray, old: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the class that raises the likelihood most, and by how much it does so more than its own.

    ``n`` counts pairs of classes; ``old`` is each unit's class or -1, ``after`` and ``before`` its neighbours by
    class, ``own`` its pairs with itself, which are in ``after`` and ``before`` if it has a class. Class 0 takes no unit.
    Only cells that a unit's neighbours touch are worked on, so units with few go through together.
    """
    k, best, more = len(n), np.empty(len(old), dtype=np.int64), np.empty(len(old))
    touched = np.maximum((after > 0).sum(axis=1), (before > 0).sum(axis=1))
    order = np.argsort(touched, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, at_once // (k * max(1, int(touched[order[min(len(order), lo + 512) - 1]])))), lo + 512)
        u = order[lo:hi]
        o, s = old[u], own[u]
        at = np.arange(len(u))
        has = np.flatnonzero(o >= 0)
        r, c = after[u].copy(), before[u].copy()
        r[has, o[has]] -= s[has]
        c[has, o[has]] -= s[has]
        gain = np.zeros((len(u), k))
        width = max(1, int(touched[u].max()))
        for cells, x, y in ((n.T, r, c), (n, c, r)):
            j = np.argsort(-x, axis=1, kind="stable")[:, :width]  # all that the unit touches
            v = np.take_along_axis(x, j, axis=1)[:, :, None]
            m = cells[j]  # unit, touched class, class that might take it
            m[has, :, o[has]] -= v[has, :, 0]
            i, t = np.nonzero(j == o[:, None])
            m[i, t] -= y[i]
            m[i, t, o[i]] -= s[i]
            gain += (_h(m + v) - _h(m)).sum(axis=1)
        d = np.repeat(np.diag(n)[None], len(u), axis=0)
        d[has, o[has]] -= (r + c)[has, o[has]] + s[has]
        gain += _h(d + r + c + s[:, None]) - _h(d + r) - _h(d + c) + _h(d)
        for total, x, y in ((n.sum(axis=1), r, c), (n.sum(axis=0), c, r)):
            m = total + np.where(o >= 0, 0, 1)[:, None] * y
            m[has, o[has]] -= x.sum(axis=1)[has] + s[has]
            gain -= _h(m + (x.sum(axis=1) + s)[:, None]) - _h(m)
        gain[:, 0] = -np.inf
        best[u] = gain.argmax(axis=1)
        more[u] = gain.max(axis=1) - np.where(o >= 0, gain[at, o], -np.inf)
        lo = hi
    return best, more


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several lists, and the sums of their counts."""
    if not held:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n[order], first)


def _packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Steps of the sorted keys in four planes of bytes, then the counts in eight, compressed: high planes are mostly zero.

    Done here so that the JVM only sees the small result; its codecs would hold each block in buffers outside the heap.
    """
    steps = np.diff(key, prepend=0).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.compress(planes, 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    size = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 4 * size].reshape(4, size).T).view("<u4")[:, 0]
    return np.cumsum(steps, dtype=np.int64), np.ascontiguousarray(raw[4 * size :].reshape(8, size).T).view("<i8")[:, 0]


class Neighbours:
    """The sparse table of neighbouring units. A row of the stored table holds a block: the units of one remainder, with all units after and before each."""

    def __init__(self, docs: DataFrame, text_col: str, pairs, n_units: int, per_block: int = 256, held_pairs: int = 800_000):
        """``pairs(texts)`` gives the units of neighbouring tokens as arrays of unit * n_units + next unit."""
        self.spark, self.n_units = docs.sparkSession, n_units
        self.path = fresh_path(self.spark, "neighbours")
        self.blocks = blocks = -(-n_units // per_block)
        depth = -(-n_units // blocks)  # a key within a block is below depth * n_units, four bytes

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each block and side with this task's pairs, once for ``held_pairs`` distinct ones or so."""

            def out(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
                a, b = np.divmod(key, n_units)
                for side, (x, y) in enumerate(((a, b), (b, a))):
                    where = (x % blocks * depth + x // blocks) * n_units + y
                    order = np.argsort(where, kind="stable")
                    where = where[order]
                    edges = np.searchsorted(where, np.arange(blocks + 1) * (depth * n_units)).tolist()
                    rows = [(k, side, _packed(where[lo:hi] - k * depth * n_units, n[order[lo:hi]])) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
                    for lo in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo : lo + 64]], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["block", "side", "pairs"])

            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                for key in pairs(batch.column(0).to_pylist()):
                    held.append(np.unique(key, return_counts=True))
                    size += len(held[-1][0])
                    if size > held_pairs:
                        held = [_summed(held)]
                        size = len(held[0][0])
                        if 2 * size > held_pairs:
                            yield from out(*held[0])
                            held, size = [], 0
            if held:
                yield from out(*_summed(held))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each block; what it holds is summed whenever it has grown by ``held_pairs``, so it stays within the pairs there are."""

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), *(pa.array([_packed(*_summed(x))], pa.binary()) for x in held)], names=["block", "after", "before"])

            held: tuple[list, list] = ([], [])
            current, grown = None, 0
            for batch in batches:
                for block, side, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if current is not None and block != current:
                        yield out()
                        held, grown = ([], []), 0
                    current = block
                    held[side].append(_unpacked(blob))
                    grown += len(held[side][-1][0])
                    if grown > held_pairs:
                        held, grown = tuple([_summed(x)] for x in held), 0
            if current is not None:
                yield out()

        rows = batched(docs.select(text_col)).mapInArrow(count, "block int, side int, pairs binary").repartition("block").sortWithinPartitions("block")
        # readers hold a row group at a time, so groups are small
        groups = {"compression": "none", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4}
        rows.mapInArrow(merge, "block int, after binary, before binary").write.options(**groups).parquet(self.path)
        self.table = self.spark.read.parquet(self.path)

    def _decoder(self):
        n_units, blocks = self.n_units, self.blocks

        def units(block: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Unit, its neighbour and their count."""
            key, n = _unpacked(blob)
            inner, other = np.divmod(key, n_units)
            return inner * blocks + block, other, n

        return units

    def between(self, group: np.ndarray, k: int) -> np.ndarray:
        """Counts of pairs of groups (k x k); units of group -1 are left out."""
        shared = self.spark.sparkContext.broadcast(group.astype(np.int32))
        units = self._decoder()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, total = shared.value, np.zeros(k * k)
            for batch in batches:
                for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    unit, other, n = units(block, blob)
                    x, y = of[unit], of[other]
                    known = (x >= 0) & (y >= 0)
                    total += np.bincount(x[known] * np.int64(k) + y[known], weights=n[known], minlength=k * k)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["cell", "n"])

        out = np.zeros(k * k)
        found = self.table.select("block", "after").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        shared.unpersist()
        return out.reshape(k, k)

    def moves(self, class_of: np.ndarray, n: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Units and their new classes: those without a class, and of the others the half whose turn it is."""
        k = len(n)
        shared = self.spark.sparkContext.broadcast((class_of.astype(np.int32), n))
        units, blocks = self._decoder(), self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, n = shared.value
            for batch in batches:
                for block, *sides in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    own = np.arange(block, len(of), blocks)  # a unit's place among them is unit // blocks
                    sums = []
                    for side, blob in enumerate(sides):
                        unit, other, count = units(block, blob)
                        if side == 0:
                            itself = unit == other
                            loops = np.bincount(unit[itself] // blocks, weights=count[itself], minlength=len(own))
                        to = of[other]
                        known = to >= 0
                        sums.append(np.bincount(unit[known] // blocks * k + to[known], weights=count[known], minlength=len(own) * k).reshape(len(own), k))
                    free = np.flatnonzero((own != 0) & ((of[own] < 0) | ((own // blocks + own + turn) % 2 == 0)))
                    new, more = best_classes(n, of[own[free]], *(x[free] for x in sums), loops[free])
                    changed = (new != of[own[free]]) & (more > 1e-6)
                    yield pa.RecordBatch.from_arrays([pa.array(own[free][changed].astype(np.int32)), pa.array(new[changed].astype(np.int32))], names=["unit", "class"])

        found = self.table.mapInArrow(run, "unit int, class int").toArrow()
        shared.unpersist()
        return found.column("unit").to_numpy(), found.column("class").to_numpy()

    def drop(self) -> None:
        remove(self.spark, self.path)


def cluster(table: Neighbours, n_words: int, classes: int, core: int, rounds: int) -> np.ndarray:
    """The class of every unit: words, the first of which is the end mark, then shapes."""
    n_units = table.n_units
    first = np.concatenate([np.arange(min(n_words, core + 1)), np.arange(n_words, n_units)])
    place = np.full(n_units, -1)
    place[first] = np.arange(len(first))
    class_of = np.full(n_units, -1)
    class_of[first] = Exchange(table.between(place, len(first)), classes).run()
    k = int(class_of.max()) + 1
    for turn in range(rounds):
        units, new = table.moves(class_of, table.between(class_of, k), turn)
        class_of[units] = new
        if 500 * len(units) < n_units:
            break
    return np.where(class_of < 0, k - 1, class_of)


@dataclasses.dataclass
class ClassModel:
    counts: DataFrame  # word, c: all training words
    n: int
    v: int
    frequent: dict[bytes, int]  # word to its unit
    log_count: np.ndarray  # of each frequent word
    class_of: np.ndarray  # of each unit
    pair: np.ndarray  # log10 of what a pair of classes adds to a word's count term

    @property
    def log_total(self) -> float:
        return float(np.log10(self.n + 0.1 * (self.v + 1)))


def _units(words: list[bytes], place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The place (or -1) and the unit of each token."""
    at = np.fromiter(map(place.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
    u = at.copy()
    rare = at < 0
    u[rare] = len(place) + shapes_of(list(itertools.compress(words, rare.tolist())))
    return at, u


def learn(
    docs: DataFrame, *, text_col: str = "text", frequent: int = 131_072, core: int = 512, classes: int = 64, rounds: int = 6, mix: float = 0.9, group_bytes: int = 1 << 20
) -> ClassModel:
    """Learn from all rows of ``docs``. To the driver come ``frequent`` words at most, and counts of pairs of classes and of core units."""
    spark = docs.sparkSession
    path = fresh_path(spark, "word-counts")
    word_counts(docs, text_col).write.parquet(path)
    counts = spark.read.parquet(path)
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, frequent)
    end = counts.where(F.octet_length("word") == 0).first()
    top = [(END, end["c"] if end else 0), *[x for x in top if x[0] != END]]
    place = {w: i for i, (w, _) in enumerate(top)}
    n_units = len(top) + SHAPES
    shared = spark.sparkContext.broadcast(place)

    def pairs(texts: list[str | None]) -> Iterator[np.ndarray]:
        place = shared.value
        for lo, hi in groups_of_bytes(texts, group_bytes, lambda t: len(t or "")):
            words: list[bytes] = [END]
            for t in texts[lo:hi]:
                words += tokens_of(t)
            u = _units(words, place)[1]
            yield u[:-1] * n_units + u[1:]

    table = Neighbours(docs, text_col, pairs, n_units)
    class_of = cluster(table, len(top), classes, core, rounds)
    k = int(class_of.max()) + 1
    follow = table.between(class_of, k)
    table.drop()

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        n, v = np.zeros(n_units, dtype=np.int64), np.zeros(n_units, dtype=np.int64)
        for batch in batches:
            u = _units(batch.column(0).to_pylist(), place)[1]
            np.add.at(n, u, batch.column(1).to_numpy())
            v += np.bincount(u, minlength=n_units)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(v[some])], names=["unit", "n", "v"])

    mass = np.zeros((2, k))
    found = batched(counts).mapInArrow(masses, "unit bigint, n bigint, v bigint").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    for i, c in enumerate(("n", "v")):
        mass[i] = np.bincount(class_of[found.column("unit").to_numpy()], weights=found.column(c).to_numpy(), minlength=k)
    p = (follow + 0.5) / (follow.sum(axis=1, keepdims=True) + 0.5 * k)
    pair = np.log10(mix * p / (mass[0] + 0.1 * (mass[1] + 1))[None, :] + (1 - mix) / (totals["n"] + 0.1 * (totals["v"] + 1)))
    log_count = np.log10(np.array([c for _, c in top], dtype=np.float64) + 0.1)
    return ClassModel(counts, totals["n"], totals["v"], place, log_count, class_of, pair)


def score(docs: DataFrame, model: ClassModel, *, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", group_bytes: int = 2 << 20) -> DataFrame:
    """id_col, held_col, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.frequent, model.log_count, model.class_of, model.pair))
    known_end = model.n > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, log_count, class_of, pair = shared.value
        first = TaskContext.get().partitionId() << 33
        done = 0
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in groups_of_bytes(texts, group_bytes, lambda t: len(t or "")):
                words: list[bytes] = []
                sizes = []
                for t in texts[lo:hi]:
                    own = tokens_of(t)
                    sizes.append(len(own))
                    words += own
                sizes_ = np.array(sizes)
                doc = np.repeat(np.arange(len(sizes)), sizes_)
                at, u = _units(words, place)
                cls = class_of[u]
                before = np.concatenate([[0], cls[:-1]])
                before[np.cumsum(sizes_)[:-1]] = 0
                some = at >= 0
                logs = np.bincount(doc[some], weights=log_count[at[some]], minlength=len(sizes))
                steps = np.bincount(doc, weights=pair[before, cls], minlength=len(sizes))
                known = np.bincount(doc[some], minlength=len(sizes))
                if not known_end:
                    known -= 1
                n = len(sizes)
                keys = first + done + np.arange(n)
                done += n
                # rare words of the group by number, then each document's, once with its count
                number: dict[bytes, int] = {}
                own = np.fromiter((number.setdefault(w, len(number)) for w in itertools.compress(words, (~some).tolist())), dtype=np.int64, count=int((~some).sum()))
                rare, tf = np.unique(doc[~some] * max(1, len(number)) + own, return_counts=True)
                rare_doc, rare_word = np.divmod(rare, max(1, len(number)))
                m = len(rare)
                none = pa.nulls(m, pa.int64())
                # a document's own row joins nothing: no word has a space
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(keys), pa.array(keys[rare_doc])]),
                        pa.concat_arrays([pa.array([b" %d" % x for x in keys.tolist()], pa.binary()), pa.array(list(number), pa.binary()).take(pa.array(rare_word))]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tf)]),
                        pa.concat_arrays([batch.column(0).slice(lo, n), pa.nulls(m, batch.column(0).type)]),
                        pa.concat_arrays([batch.column(1).slice(lo, n), pa.nulls(m, pa.bool_())]),
                        pa.concat_arrays([pa.array(sizes, pa.int64()), none]),
                        pa.concat_arrays([pa.array(known, pa.int64()), none]),
                        pa.concat_arrays([pa.array(logs), none.cast(pa.float64())]),
                        pa.concat_arrays([pa.array(steps), none.cast(pa.float64())]),
                    ],
                    names=["key", "word", "tf", "id", "held", "n_tokens", "known", "logs", "steps"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = batched(docs.select(F.col(id_col), F.col(held_col), F.col(text_col))).mapInArrow(
        run, f"key bigint, word binary, tf bigint, id {kind}, held boolean, n_tokens bigint, known bigint, logs double, steps double"
    )
    c = F.coalesce(F.col("c"), F.lit(0))
    joined = rows.join(model.counts, "word", "left").groupBy("key").agg(
        F.max("id").alias(id_col),
        F.max("held").alias(held_col),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(F.when(c > 0, F.col("tf"))), F.lit(0))).alias("n_known"),
        (F.max("logs") + F.coalesce(F.sum(F.col("tf") * F.log10(c + F.lit(0.1))), F.lit(0.0))).alias("logs"),
        F.max("steps").alias("steps"),
    )
    return joined.select(
        id_col,
        held_col,
        "n_tokens",
        "n_known",
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(model.log_total)).alias("base_score"),
        (F.col("logs") + F.col("steps")).alias("score"),
    )
