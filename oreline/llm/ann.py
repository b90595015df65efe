"""Approximate nearest neighbours by a hash-prefix forest (operator 5).

Every tree is a sorted array of 32-bit hash strings, the signs of random
projections of the centred vectors. A query descends each tree to its longest
prefix match; then all trees ascend together, a bit at a time, until the rows that
share the prefix make up enough matches. Those are ranked by their exact
cosine in double precision. How many matches are enough is fitted for each forest: ``sample`` of its rows are
searched exhaustively, and the least number at which the forest would have found ``recall`` of their neighbours is
taken, so a forest of vectors in groups looks at few rows and one without any structure at more. Blocks of vectors have forests of their own (every
row is indexed), and a query searches all of them. No bucket is capped: a prefix that many rows share gives
them all. Which rows make a block follows from ids and the size of the table alone.

Defined cases: rows whose id or vector is null, zero or not finite take no part;
equal cosines go to the smaller id; a repeated query id is searched once, by
its least vector; repeated candidates are returned as often as they
occur, but never the query's own id; fewer than k candidates give all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from oreline.llm.vectors import chunks, search, top_k, usable

BITS = 32


class Forest:
    """``vectors``: rows of length 1."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int = 11):
        self.centre = vectors.mean(axis=0)
        self.planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], trees * BITS))
        keys = self.hashes(vectors)
        self.order = [np.argsort(keys[:, t], kind="stable").astype(np.int32) for t in range(trees)]
        self.keys = [keys[o, t] for t, o in enumerate(self.order)]

    def hashes(self, x: np.ndarray, at_once: int = 1024) -> np.ndarray:
        """Rows by trees."""
        out = np.empty((len(x), self.planes.shape[1] // BITS), dtype=np.uint32)
        for c in chunks(len(x), at_once):
            bits = ((x[c] - self.centre) @ self.planes > 0).reshape(len(x[c]), -1, BITS)
            out[c] = np.packbits(bits, axis=2, bitorder="big").reshape(len(x[c]), -1, 4).view(">u4")[:, :, 0]
        return out

    def ranges(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each tree's rows that share the first x bits of each hash begin and end: trees by rows by x."""
        mask = np.array([((1 << x) - 1) << (BITS - x) for x in range(BITS + 1)], dtype=np.uint32)
        lows, highs = [], []
        for t, keys in enumerate(self.keys):
            low = own[:, t, None] & mask
            lows.append(np.searchsorted(keys, low, side="left").astype(np.int32))
            highs.append(np.searchsorted(keys, low | ~mask, side="right").astype(np.int32))
        return np.stack(lows), np.stack(highs)

    @staticmethod
    def levels(gathered: np.ndarray, least: int) -> np.ndarray:
        """The longest prefix of each row of ``gathered`` (matches by its length) that has ``least`` matches; 0 if none has."""
        enough = gathered[:, ::-1] >= least
        return (BITS - np.argmax(enough, axis=1)) * enough.any(axis=1)

    def fitted(self, vectors: np.ndarray, k: int, recall: float, sample: int = 128, seed: int = 1) -> int:
        """The least number of matches that finds ``recall`` of the k nearest rows of ``sample`` of ``vectors``, the forest's own."""
        n = len(vectors)
        if recall >= 1 or n <= k + 1:
            return n * len(self.keys) + 1
        some = np.random.default_rng(seed).choice(n, min(sample, n), replace=False)
        cosine = vectors[some] @ vectors.T
        cosine[np.arange(len(some)), some] = -2
        near = np.argpartition(-cosine, k, axis=1)[:, :k]
        own = self.hashes(vectors[some])
        differ = own[:, None, :] ^ self.hashes(vectors[near.reshape(-1)]).reshape(len(some), k, -1)
        shared = (BITS - np.frexp(differ.astype(np.float64))[1]).max(axis=2)
        low, high = self.ranges(own)
        gathered = (high - low).sum(axis=0, dtype=np.int64)
        choices = np.unique(gathered)
        a, b = 0, len(choices) - 1
        while a < b:
            middle = (a + b) // 2
            if (shared >= self.levels(gathered, choices[middle])[:, None]).mean() >= recall:
                b = middle
            else:
                a = middle + 1
        return int(choices[a])

    def candidates(self, queries: np.ndarray, least: int, at_once: int = 256) -> list[np.ndarray]:
        """For each query the rows found when at least ``least`` matches are gathered over all trees."""
        rows = []
        for c in chunks(len(queries), at_once):
            low, high = self.ranges(self.hashes(queries[c]))
            level = self.levels((high - low).sum(axis=0, dtype=np.int64), least)
            for i, x in enumerate(level.tolist()):
                found = np.zeros(len(self.keys[0]), dtype=bool)
                if x:
                    for o, lo, hi in zip(self.order, low[:, i, x].tolist(), high[:, i, x].tolist(), strict=True):
                        found[o[lo:hi]] = True
                else:
                    found[:] = True
                rows.append(np.flatnonzero(found))
        return rows


def nearest_in_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, *, k: int, trees: int, recall: float) -> tuple:
    """The block's nearest rows; the block is one forest."""
    # scaled by powers of two so that squares neither overflow nor vanish; cosines keep their bits
    exact = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    vectors, queries = exact(vectors), exact(queries)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    forest = Forest(unit, trees)
    rows = forest.candidates(queries / np.linalg.norm(queries, axis=1, keepdims=True), forest.fitted(unit, k, recall))
    squares = np.einsum("ij,ij->i", vectors, vectors)
    out: tuple[list, list, list] = ([], [], [])
    for i, (own, near) in enumerate(zip(query_ids.tolist(), rows, strict=True)):
        near = near[ids[near] != own]
        q = queries[i]
        cosine = np.einsum("ij,j->i", vectors[near], q) / np.sqrt(squares[near] * np.einsum("j,j->", q, q))
        cosine = np.clip(cosine, -1.0, 1.0)
        best = top_k(cosine, ids[near], k)
        out[0].append(np.full(len(best), own))
        out[1].append(ids[near][best])
        out[2].append(cosine[best])
    return tuple(np.concatenate(x) for x in out)


def nearest(
    table: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 192, recall: float = 0.97, queries: DataFrame | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose id is divisible by ``every``, or those of ``queries``.

    ``recall`` is what forests are fitted to; at 1 every row is looked at.
    """
    vectors = usable(table, id_col, vec_col, zero=False)
    asked = vectors.where(f"id % {every} = 0") if queries is None else usable(queries, id_col, vec_col, zero=False)
    return search(vectors, asked, k, functools.partial(nearest_in_block, k=k, trees=trees, recall=recall), score_type="double")
