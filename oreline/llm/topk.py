"""Exact top-k by an impact-ordered, score-at-a-time index (operator 9).

Vectors become integers, floor(scale * x). The index of a block of vectors keeps, for each
quantised impact level from the highest down and each dimension, the
posting segment of rows whose component has that impact; a level whose segments hold over a 64th of all
places is kept as one array with zeros between. Segments are processed level by
level for a block of queries at once, adding query component times
impact to the rows' accumulators. After a level, what a row can still gain is
at most the query's norm times the norm of the row's unread components; and the
k-th best of some exactly scored rows is a floor. Processing stops
when that proves all but a few rows out; every row not proved out is then
scored exactly. At the last level the accumulators are exact themselves.

Defined cases: rows whose id or vector is null, or whose components are not all finite, take
no part; equal scores go to the smaller id; a repeated query id is
searched once, by its least vector; repeated candidates are returned as often as they
occur, but never the query's own id; fewer than k candidates give all; an empty table gives an empty result;
scores beyond a long are held at its ends; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from oreline.llm.vectors import best_of, chunks, search, top_k, usable

#: Doubles hold whole numbers up to here.
EXACT = float(1 << 53)


class ImpactIndex:
    def __init__(self, vectors: np.ndarray, levels: int = 12):
        """``vectors``: whole numbers as doubles."""
        self.vectors = vectors
        size = np.abs(vectors)
        # edges between levels, highest first, so that levels hold about as many postings each
        some = size[size > 0]
        edges = np.unique(np.quantile(some, np.linspace(0, 1, levels + 1)[1:-1]))[::-1] if len(some) else np.zeros(0)
        level = np.searchsorted(-edges, -size, side="left")
        self.levels = []
        rest = (vectors * vectors).sum(axis=1)
        for x in range(len(edges) + 1):
            here = level == x
            segments: list | np.ndarray = []
            if (here & (size > 0)).mean() > 1 / 64:
                segments = np.where(here, vectors, 0)
            else:
                for d in range(vectors.shape[1]):
                    rows = np.flatnonzero(here[:, d] & (vectors[:, d] != 0))
                    if len(rows):
                        segments.append((d, rows, vectors[rows, d]))
            rest = rest - np.where(here, vectors * vectors, 0).sum(axis=1)
            self.levels.append((segments, np.sqrt(np.maximum(rest, 0))))

    @staticmethod
    def _add(scores: np.ndarray, segments: list | np.ndarray, columns: np.ndarray) -> None:
        """Process one level for all queries. Sums of whole numbers are exact in any order."""
        if isinstance(segments, np.ndarray):
            scores += segments @ columns
        else:
            for d, rows, impacts in segments:
                scores[rows] += impacts[:, None] * columns[d]

    def possible(self, queries: np.ndarray, k: int, few: int, own: np.ndarray | None = None) -> list[np.ndarray]:
        """Rows that may be among the k best of each query; all others are proved out. ``own`` (rows x queries) marks rows that take no place."""
        n = len(self.vectors)
        scores = np.zeros((n, len(queries)))
        if own is not None:
            scores[own] = -np.inf
        norm = np.sqrt((queries * queries).sum(axis=1)) * (1 + 1e-9)
        columns = np.ascontiguousarray(queries.T)
        for segments, rest in self.levels[:-1]:
            self._add(scores, segments, columns)
            if n <= max(few, k) or rest.mean() > 0.5 * np.sqrt((self.vectors**2).sum(axis=1)).mean():
                continue
            top = np.argpartition(scores, n - k, axis=0)[n - k :]
            exact = np.einsum("kqd,qd->kq", self.vectors[top], queries)
            floor = np.where(np.isneginf(np.take_along_axis(scores, top, axis=0)), -np.inf, exact).min(axis=0)
            may = scores + rest[:, None] * norm >= floor - 1
            if may.sum(axis=0).max() <= few:
                return [np.flatnonzero(may[:, i]) for i in range(len(queries))]
        self._add(scores, self.levels[-1][0], columns)
        if n <= k:
            return [np.arange(n)] * len(queries)
        edge = np.partition(scores, n - k, axis=0)[n - k]
        return [np.flatnonzero(scores[:, i] >= edge[i]) for i in range(len(queries))]


def _whole(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], dtype=np.int64)


def best_in_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, *, k: int, index_rows: int = 4096, at_once: int = 512) -> tuple:
    """The block's best rows; ``index_rows`` rows make an index, which ``at_once`` queries go through together."""
    parts = []
    for c in chunks(len(ids), index_rows):
        for q in chunks(len(query_ids), at_once):
            parts.append(best_in_index(ids[c], vectors[c], query_ids[q], queries[q], k=k))
    return best_of(parts, k)


def best_in_index(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, *, k: int, few: int = 256) -> tuple:
    out: tuple[list, list, list] = ([], [], [])
    safe = vectors.shape[1] * (np.abs(vectors).max() + 1) * (np.abs(queries).max() + 1) < EXACT
    if safe:
        rows = ImpactIndex(vectors).possible(queries, k, few, ids[:, None] == query_ids)
    else:  # components so large that sums of doubles are not exact: whole numbers of any size
        rows = [np.arange(len(ids))] * len(queries)
        vectors, queries = (np.array([[int(c) for c in v] for v in x], dtype=object) for x in (vectors, queries))
    for i, (own, may) in enumerate(zip(query_ids.tolist(), rows, strict=True)):
        may = may[ids[may] != own]
        scores = _whole(vectors[may] @ queries[i])
        best = top_k(scores, ids[may], k)
        out[0].append(np.full(len(best), own))
        out[1].append(ids[may][best])
        out[2].append(scores[best])
    return tuple(np.concatenate(x) for x in out)


def best(table: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose id is divisible by ``every``, or those of ``queries``."""
    vectors = usable(table, id_col, vec_col, zero=True)
    asked = vectors.where(f"id % {every} = 0") if queries is None else usable(queries, id_col, vec_col, zero=True)
    return search(vectors, asked, k, functools.partial(_floored, k=k, scale=scale), score_type="bigint")


def _floored(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, *, k: int, scale: int) -> tuple:
    return best_in_block(ids, np.floor(vectors * scale), query_ids, np.floor(queries * scale), k=k)
