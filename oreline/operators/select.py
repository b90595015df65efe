"""Choosing and ruling: argmin in a total order, gates and label ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions.scalars import uvar_len


def argmin(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group by ``order``, which should be total; one combinable aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    least = F.min(F.struct(F.struct(*[c.alias(f"o{i}") if isinstance(c, Column) else F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("order"), F.struct(*rest).alias("row")))
    return rows.groupBy(*keys).agg(least.alias("_m")).select(*keys, "_m.row.*")


def ladder(*rungs: tuple[Column, str], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    out = F.when(rungs[0][0], rungs[0][1])
    for condition, label in rungs[1:]:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


#: The labels below, and their order, are fixed values: they are the rulings' meaning.
def timing_status(blocked: Column, control_cv: Column, candidate_cv: Column, ci_high: Column, most_cv: float, epsilon: float) -> Column:
    valid = ~blocked & (control_cv <= most_cv) & (candidate_cv <= most_cv)
    return ladder((blocked, "BLOCKED_AMBIENT"), (~valid, "BLOCKED_NOISE"), (ci_high < 1.0 - epsilon, "PASS_SPEED_GATE"), otherwise="NO_SPEED_GATE")


def cost_ruling(timing_ok: Column, bytes_win: Column, time_ratios: list[Column], memory_ratios: list[Column], most: float = 2.0) -> Column:
    within = F.lit(True)
    for r in [*time_ratios, *memory_ratios]:
        within = within & (r <= most)
    return ladder((~timing_ok, "TIMING_BLOCKED"), (~bytes_win, "NO_BINDING_BYTE_WIN"), (~within, "FRONT-GAP_COST"), otherwise="COST_GAP_CLOSED_PENDING_ENCODE_DECSIZE")


def discovery_ruling(selected: Column, improves: Column, beats_bytes: Column, beats_speed: Column) -> Column:
    return ladder((~selected, "KILL-DIFF"), (~improves, "NO-INCREMENTAL-BYTE-WIN"), (~(beats_bytes & beats_speed), "SPECIALIZED-TRADEOFF"), otherwise="SPECIALIZED-DISCOVERY-ADVANCE")


def additive_cost(n_bytes: Column, seconds: Column, rate: float, fixed: float, spread: float) -> Column:
    """J = L + rate c + 2 fixed + spread c."""
    return n_bytes + seconds * rate + 2.0 * fixed + seconds * spread


def agreement(rows: DataFrame, keys: list[str], same: Column, weight: str, near_tie: Column) -> DataFrame:
    """How far two selections agree, by count and by weight, and outside near ties."""
    clear = ~near_tie
    return rows.groupBy(*keys).agg(
        F.count("*").alias("slots"),
        F.count_if(same).alias("agree"),
        F.count_if(near_tie).alias("near_ties"),
        F.count_if(clear & same).alias("clear_agree"),
        F.sum(weight).alias("weight"),
        F.coalesce(F.sum(F.when(same, F.col(weight))), F.lit(0)).alias("weight_agree"),
        F.coalesce(F.sum(F.when(clear, F.col(weight))), F.lit(0)).alias("clear_weight"),
        F.coalesce(F.sum(F.when(clear & same, F.col(weight))), F.lit(0)).alias("clear_weight_agree"),
    )


def every(gates: list[Column]) -> Column:
    out = gates[0]
    for g in gates[1:]:
        out = out & g
    return out


def hybrid_gates(c):
    """Gates of a hybrid envelope: a model for arithmetic, a dictionary for repeats, a general codec for series. ``c`` gives columns; the second value rules on the gates."""
    gates = [(c("a_mode") == 1) & c("a_models"), c("r_mode").isin(2, 3), c("t_mode") == 2, c("a_own") < c("a_q11"), c("a_dec") > c("a_q11_dec"), F.lit(True)]
    return gates, lambda g: ladder((~every([g[0], g[1], g[5]]), "INVALID_ENVELOPE_SELECTION"), (every(g), "HYBRID_ARCHITECTURE_VALIDATED_DISCOVERY"), otherwise="HYBRID_ARCHITECTURE_PARTIAL_DISCOVERY")


def fast_gates(c, files: int = 7):
    """Gates of a fast search against the full one."""
    gates = [
        every([c("a_mode") == 1, c("a_models"), c("a_own") == c("a_whole"), c("a_own") < c("a_q5"), c("a_dec") > c("a_q5_dec")]),
        F.lit(True),
        (c("a_enc") > c("a_whole_enc")) & (c("t_enc") > c("t_whole_enc")),
        (c("t_mode") == 2) & (c("t_own") == c("t_whole")),
        c("files") == files,
        F.lit(True),
    ]
    return gates, lambda g: ladder((every(g), "FAST-ENCODE-TRADEOFF-DISCOVERY"), otherwise="FAST-SEARCH-NO-THROUGHPUT-RETURN")


def budget_gates(c, arithmetic: int = 33204, series: int = 120602, skips: int = 4):
    """Gates of a budgeted search; its limits are those the protocol fixed beforehand."""
    gates = [
        (c("a_mode") == 4) & (c("a_own") < arithmetic),
        (c("t_mode") == 2) & (c("t_own") <= series),
        c("skips") >= skips,
        (c("a_enc") > c("a_whole_enc")) & (c("t_enc") > c("t_whole_enc")),
        every([c("a_own") >= 0, c("a_q5") >= 0, c("a_q11") >= 0]),
        every([c("a_mode") == 4, c("a_dec") > c("a_q5_dec"), c("a_dec") > c("a_q11_dec")]),
    ]
    return gates, lambda g: ladder((every(g), "PASS"), otherwise="FAIL")


def framed_block(length: Column | str, coded: Column | str) -> Column:
    """Bytes of a coded block: type, payload size, CRC and a payload of codec, plain length and code."""
    length, coded = (F.col(x) if isinstance(x, str) else x for x in (length, coded))
    payload = 2 + uvar_len(length) + coded
    return 1 + uvar_len(payload) + 4 + payload


def block_sizes(blocks: DataFrame, whole: DataFrame) -> DataFrame:
    """By block size: wins, the sum of each block's best backend, and against one stream per file its regret and warm-up tax.

    ``blocks`` has file, block_size, blen, a, b (coded bytes) and raw (only a was tried); ``whole`` has wa and wb of each file and block size.
    """
    best = F.when(F.col("raw"), F.col("fa")).otherwise(F.least("fa", "fb"))
    plain = 1 + uvar_len("blen") + 4 + F.col("blen")
    framed = blocks.withColumn("fa", framed_block("blen", "a")).withColumn("fb", framed_block("blen", "b"))
    live = ~F.col("raw")
    each = framed.groupBy("file", "block_size").agg(
        F.count("*").alias("blocks"),
        F.count_if(live & (F.col("a") < F.col("b"))).alias("wins_a"),
        F.count_if(live & (F.col("a") >= F.col("b"))).alias("wins_b"),
        F.count_if("raw").alias("wins_raw"),
        F.sum(best).alias("oracle"),
        F.sum(F.least(best, plain)).alias("oracle_any"),
        F.sum("fa").alias("sum_a"),
        F.sum(F.when(live, F.col("fb")).otherwise(0)).alias("sum_b"),
    )
    both = each.join(whole, ["file", "block_size"]).withColumn("w", F.least("wa", "wb")).withColumn("whole_framed", framed_block("w", "w"))
    warm = F.when(F.col("wb") <= F.col("wa"), F.col("sum_b")).otherwise(F.col("sum_a")) - F.col("whole_framed")
    sums = [F.sum(c).alias(c) for c in ("blocks", "wins_a", "wins_b", "wins_raw", "oracle", "oracle_any", "whole_framed")]
    return both.groupBy("block_size").agg(*sums, F.sum(F.col("oracle") - F.col("whole_framed")).alias("regret"), F.sum(warm).alias("warm_up"))


def regret(totals: DataFrame, key: str) -> DataFrame:
    """key, chosen, least, regret and regret_pct of each row, then of all together (-1) and the worst (-2)."""
    lost = lambda: (F.col("chosen") - F.col("least")).alias("regret")
    pct = lambda: F.round(F.lit(100.0) * (F.col("chosen") - F.col("least")) / F.col("least"), 9).alias("regret_pct")
    each = totals.select(F.col(key).cast("bigint").alias(key), "chosen", "least", lost(), pct())
    both = totals.agg(F.sum("chosen").alias("chosen"), F.sum("least").alias("least")).select(F.lit(-1).cast("bigint").alias(key), "chosen", "least", lost(), pct())
    worst = each.agg(F.max("regret").alias("regret"), F.max("regret_pct").alias("regret_pct")).select(F.lit(-2).cast("bigint").alias(key), F.lit(None).cast("bigint").alias("chosen"), F.lit(None).cast("bigint").alias("least"), "regret", "regret_pct")
    return each.unionByName(both).unionByName(worst)


def substitutions(candidates: DataFrame, columns: list[str], shape: Column, slot: Column, most: int = 24) -> DataFrame:
    """The ``most`` best replacements of a column's raw leaf (leaf 0) by (delta, shape, slot, leaf)."""
    raw = F.max(F.when(F.col("leaf_id") == 0, F.col("size")))
    base = candidates.groupBy(*columns).agg(raw.alias("_raw"))
    each = candidates.where("leaf_id <> 0").join(base, columns).select(shape.alias("shape"), slot.alias("slot"), F.col("leaf_id").alias("leaf"), (F.col("size") - F.col("_raw")).alias("delta"))
    return each.orderBy("delta", "shape", "slot", "leaf").limit(most)
