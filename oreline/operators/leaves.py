"""Typed leaves: what each encoding of a token column would cost, and the cheapest.

Sizes are closed-form aggregates. A column is a group of rows in a total
order; the delta encodings look back one and two rows of it. The dictionary needs
the distinct tokens, which are counted by a second, combinable aggregation
instead of being collected.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.scalars import bit_width, canonical_int, framed_size, leaf_object_size, packed_size, uvar_len, zigzag


@dataclasses.dataclass(frozen=True)
class Leaf:
    id: int
    name: str
    size: Column
    numeric: bool
    least_rows: int = 1


def leaf_registry() -> list[Leaf]:
    """Encodings by id; sizes are expressions over the columns of ``column_profile``."""
    width = lambda lo, hi: bit_width(F.col(hi) - F.col(lo))
    n = F.col("n")
    return [
        Leaf(0, "raw", F.col("raw_bytes"), False),
        Leaf(1, "dict", uvar_len("d") + F.col("dict_bytes") + 1 + packed_size(n, F.when(F.col("d") <= 1, 0).otherwise(bit_width(F.col("d") - 1))), False),
        Leaf(2, "for", uvar_len(zigzag("v_min")) + 1 + packed_size(n, width("v_min", "v_max")), True),
        Leaf(3, "delta", uvar_len(zigzag("v0")) + uvar_len(zigzag("d_min")) + 1 + packed_size(n - 1, width("d_min", "d_max")), True, 2),
        Leaf(4, "dod", uvar_len(zigzag("v0")) + uvar_len(zigzag("d0")) + uvar_len(zigzag("dd_min")) + 1 + packed_size(n - 2, width("dd_min", "dd_max")), True, 3),
    ]


#: Families of leaf ids that a planner may be held to.
FAMILIES = {"RAW": (0,), "DICT": (0, 1), "INT": (0, 2, 3, 4), "MIXED": (0, 1, 2, 3, 4)}


def column_profile(rows: DataFrame, keys: list[str], order: list[str], token: str) -> DataFrame:
    """One row per column (group of ``keys``): counts, extremes of values, deltas and deltas of deltas, dictionary size.

    ``order`` must be total within a column. Numeric parts are null where some token isn't a canonical integer.
    """
    text = F.col(token).cast("string")
    size = framed_size(F.octet_length(text).cast("bigint"))
    dictionary = (
        rows.groupBy(*keys, text.alias("_token")).agg(F.count("*").alias("_c")).groupBy(*keys)
        .agg(F.count("*").alias("d"), F.sum(framed_size(F.octet_length("_token").cast("bigint"))).alias("dict_bytes"))
    )
    w = Window.partitionBy(*keys).orderBy(*order)
    v, d = F.col("_v"), F.col("_v") - F.lag("_v").over(w)
    seen = rows.select(*keys, size.alias("_size"), canonical_int(text).alias("_v"), *order) if token not in keys else rows
    stepped = seen.select(*keys, "_size", "_v", F.row_number().over(w).alias("_i"), d.alias("_d"), *[c for c in order if c not in keys])
    twice = stepped.withColumn("_dd", F.col("_d") - F.lag("_d").over(w))
    at = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    whole = F.count("_v") == F.count("*")
    numeric = {"v_min": F.min(v), "v_max": F.max(v), "v0": at(1, "_v"), "d_min": F.min("_d"), "d_max": F.max("_d"), "d0": at(2, "_d"), "dd_min": F.min("_dd"), "dd_max": F.max("_dd")}
    stats = twice.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_size").alias("raw_bytes"), whole.alias("all_int"), *[F.when(whole, e).alias(k) for k, e in numeric.items()])
    return stats.join(dictionary, keys)


def leaf_sizes(profile: DataFrame) -> DataFrame:
    """The profile with one size column per leaf, null where the leaf can't hold the column."""
    return profile.select(
        "*",
        *[F.when((F.col("all_int") if leaf.numeric else F.lit(True)) & (F.col("n") >= leaf.least_rows), leaf.size).alias(f"{leaf.name}_size") for leaf in leaf_registry()],
    )


def leaf_candidates(sized: DataFrame, keys: list[str]) -> DataFrame:
    """One row per column and leaf that can hold it: leaf_id, leaf, payload, size with framing."""
    each = F.explode(F.array(*[F.struct(F.lit(leaf.id).alias("leaf_id"), F.lit(leaf.name).alias("leaf"), F.col(f"{leaf.name}_size").alias("payload")) for leaf in leaf_registry()]))
    rows = sized.select(*keys, "n", each.alias("_c")).select(*keys, "n", "_c.leaf_id", "_c.leaf", "_c.payload").where("payload IS NOT NULL")
    return rows.withColumn("size", leaf_object_size("n", "payload"))


def cheapest(candidates: DataFrame, keys: list[str], cost: str = "size", ids: str = "leaf_id") -> DataFrame:
    """The row of least (cost, id) of each group: a total order, so ties go to the smaller id."""
    least = candidates.groupBy(*keys).agg(F.min(F.struct(F.col(cost), F.col(ids), F.struct(*[c for c in candidates.columns if c not in (*keys, cost, ids)]))).alias("_m"))
    return least.select(*keys, f"_m.{cost}", f"_m.{ids}", "_m.col3.*")


def select_leaf(rows: DataFrame, keys: list[str], order: list[str], token: str) -> DataFrame:
    """The cheapest leaf of each column. All its sizes are on one row, so choosing needs no exchange."""
    sized = leaf_sizes(column_profile(rows, keys, order, token))
    sized = sized.select("*", *[leaf_object_size("n", f"{leaf.name}_size").alias(f"_{leaf.id}") for leaf in leaf_registry()])
    best = F.array_min(F.filter(F.array(*[F.when(F.col(f"_{leaf.id}").isNotNull(), F.struct(F.col(f"_{leaf.id}").alias("size"), F.lit(leaf.id).alias("leaf_id"))) for leaf in leaf_registry()]), lambda x: x.isNotNull()))
    names = [f"{leaf.name}_size" for leaf in leaf_registry()]
    return sized.select(*keys, "n", "d", *names, best.alias("_b")).select(*keys, "n", "d", *names, F.col("_b.leaf_id").alias("leaf_id"), F.col("_b.size").alias("size"))
