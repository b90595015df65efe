"""Fronts of points: skylines, dominators, budgets and secants.

A two-dimensional skyline is a sort and a running extreme, O(n log n)
within a group and without a join. Equal points don't dominate each other. With
three dimensions or a wanted dominator a group's points are joined with each other
on the group's key and inequalities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_front(keys: list[str], cost: str, gain: str) -> Column:
    """Whether no point of the group has at most this cost and at least this gain, one strictly better."""
    by_cost = Window.partitionBy(*keys).orderBy(cost).rangeBetween(Window.unboundedPreceding, 0)
    by_gain = Window.partitionBy(*keys).orderBy(F.desc(gain)).rangeBetween(Window.unboundedPreceding, 0)
    return (F.max(gain).over(by_cost) == F.col(gain)) & (F.min(cost).over(by_gain) == F.col(cost))


def dominated_by(points: DataFrame, refs: DataFrame, keys: list[str], costs: list[str], gains: list[str], name: str, ordinal: str | None = None) -> DataFrame:
    """``points`` with ``dominator``: the first reference, by ``ordinal``, that is as good everywhere and better somewhere."""
    ordinal = ordinal or name
    axes = [*costs, *gains]
    other = refs.select(*keys, F.col(name).alias("_name"), F.col(ordinal).alias("_ordinal"), *[F.col(a).alias(f"_{a}") for a in axes])
    no_worse = [F.col(f"_{a}") <= F.col(a) for a in costs] + [F.col(f"_{a}") >= F.col(a) for a in gains]
    better = [F.col(f"_{a}") < F.col(a) for a in costs] + [F.col(f"_{a}") > F.col(a) for a in gains]
    condition = _all(no_worse) & _any(better)
    pairs = points.join(other, keys).where(condition).groupBy(*keys, name).agg(F.min(F.struct("_ordinal", "_name")).alias("_d"))
    return points.join(pairs.select(*keys, name, F.col("_d._name").alias("dominator")), [*keys, name], "left")


def undominated(points: DataFrame, keys: list[str], costs: list[str], gains: list[str]) -> DataFrame:
    """The skyline in any number of dimensions, as an anti-join within groups."""
    a, b = points.alias("a"), points.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    no_worse = [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in costs] + [F.col(f"b.{g}") >= F.col(f"a.{g}") for g in gains]
    better = [F.col(f"b.{c}") < F.col(f"a.{c}") for c in costs] + [F.col(f"b.{g}") > F.col(f"a.{g}") for g in gains]
    return a.join(b, _all(same + no_worse) & _any(better), "left_anti")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def budget_at(points: DataFrame, keys: list[str], cost: str, gain: str, levels: list[float]) -> DataFrame:
    """keys, level, least cost among points with at least that gain (null if none). Levels are few: one conditional minimum each."""
    wide = points.groupBy(*keys).agg(*[F.min(F.when(F.col(gain) >= x, F.col(cost))).alias(f"_{i}") for i, x in enumerate(levels)])
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("level"), F.col(f"_{i}").alias("budget")) for i, x in enumerate(levels)]))
    return wide.select(*keys, each.alias("_x")).select(*keys, "_x.level", "_x.budget")


def budget_curve(points: DataFrame, keys: list[str], cost: str, gain: str) -> DataFrame:
    """The step function of least cost by demanded gain: segments low, high, budget; equal neighbours are one segment."""
    steps = points.groupBy(*keys, gain).agg(F.min(cost).alias("_c"))
    up = Window.partitionBy(*keys).orderBy(gain)
    suffix = Window.partitionBy(*keys).orderBy(F.desc(gain))
    curve = steps.withColumn("budget", F.min("_c").over(suffix)).withColumn("_before", F.lag("budget").over(up))
    change = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("budget")), 1).otherwise(0)
    islands = curve.withColumn("_new", change).withColumn("_s", F.sum("_new").over(up))
    return islands.groupBy(*keys, "_s", "budget").agg(F.min(gain).alias("low"), F.max(gain).alias("high")).drop("_s")


def critical_gain(points: DataFrame, refs: DataFrame, keys: list[str], name: str, cost: str, gain: str) -> DataFrame:
    """keys, name and the most gain among references of at most this cost, which a point must exceed; null where there are none.

    One sort and a running maximum over points and references together.
    """
    both = points.select(*keys, name, cost, F.lit(None).cast("double").alias("_g")).unionByName(refs.select(*keys, F.lit(None).cast("string").alias(name), cost, F.col(gain).cast("double").alias("_g")))
    running = F.max("_g").over(Window.partitionBy(*keys).orderBy(cost).rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("critical", running).where(F.col(name).isNotNull()).select(*keys, name, cost, "critical")


def secants(front: DataFrame, keys: list[str], cost: str, gain: str) -> DataFrame:
    """Between neighbours of a front by gain: cost given up per gain, where both grow."""
    w = Window.partitionBy(*keys).orderBy(gain, cost)
    steps = front.withColumn("_dc", F.lead(cost).over(w) - F.col(cost)).withColumn("_dg", F.lead(gain).over(w) - F.col(gain))
    return steps.where("_dc > 0 AND _dg > 0").withColumn("slope", F.col("_dc") / F.col("_dg"))
