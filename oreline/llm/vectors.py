"""Blocks of query rows against blocks of vectors, shared by the two searches over embeddings.

All vectors and the queries are dealt to blocks of bounded size by a hash of their
ids. Each pair of a vector block and a query block is one group, so a task holds one
pair at a time whatever the table's size; each block's best rows are merged
by a window over the query. Of rows with one and the same vector only those of the
``k + 1`` smallest ids, one of which may be the query's own, and of each id only k rows can be among a
query's k best, so others are left out before the exchange: repeats are counted in the map tasks, then ids are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vec_col: str, *, zero: bool) -> DataFrame:
    """id and vec of rows with an id and a finite vector; ``zero`` lets zero vectors in."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keep = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite
    if not zero:
        keep &= F.exists(vec_col, lambda x: x != 0)
    vec = F.col(vec_col) if table.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
    return table.where(F.coalesce(keep, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    block: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    *,
    score_type: str,
    least_rows: int = 4096,
    most_rows: int = 32_768,
    most_values: int = 1 << 21,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows that ``block`` finds over all blocks.

    ``block(ids, vectors, query_ids, query_vectors)`` returns query ids, ids and
    scores of its own k best of each query. Vectors are only compared with those of their own length.

    Each vector is sent once per query block and each query once per vector block, so blocks
    are large: up to ``most_rows`` rows or ``most_values`` components, and a quarter of a small table. They
    don't depend on the cluster.
    """
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("d")).first()
    most_rows = max(1, min(most_rows, most_values // size["d"]))
    rows = min(most_rows, max(least_rows, -(-size["n"] // 4)))
    v_blocks, q_blocks = max(1, -(-size["n"] // rows)), max(1, -(-queries.count() // most_rows))
    first = Window.partitionBy("vec").orderBy("id")
    vectors = vectors.groupBy("vec", "id").agg(F.least(F.count("*"), F.lit(k)).alias("times")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    vectors = vectors.select("id", "vec", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("again"))
    at = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("id", "vec", F.size("vec").alias("d"), at("v", v_blocks).alias("vb"), each(q_blocks).alias("qb"))
    right = queries.groupBy("id").agg(F.min("vec").alias("vec")).select("id", "vec", F.size("vec").alias("d"), each(v_blocks).alias("vb"), at("q", q_blocks).alias("qb"))

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("id")
        found = block(v["id"].to_numpy(), np.stack(v["vec"].to_list()).astype(np.float64), q["id"].to_numpy(), np.stack(q["vec"].to_list()).astype(np.float64))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["d", "vb", "qb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query_id bigint, vec_id bigint, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def descending(scores: np.ndarray) -> np.ndarray:
    """A key that sorts the highest score first; whole numbers are inverted, as the least has no negative."""
    return ~scores if scores.dtype.kind == "i" else -scores


def chunks(n: int, rows: int):
    """Slices of at most ``rows`` that cover n rows."""
    return [slice(lo, min(n, lo + rows)) for lo in range(0, n, rows)]


def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query over several blocks' results; ties to the smaller id."""
    q, i, s = (np.concatenate([f[c] for f in found]) for c in range(3))
    order = np.lexsort((i, descending(s), q))
    q, i, s = q[order], i[order], s[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, dtype=np.int64)
    keep = place < k
    return q[keep], i[keep], s[keep]


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], descending(scores[some])))[:k]]
    return np.lexsort((ids, descending(scores)))[:k]
