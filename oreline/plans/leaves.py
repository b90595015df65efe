"""Queries over typed leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.functions.scalars import bit_width, doubling_class, packed_size, signed_ring, unzigzag, uvar_len, zigzag
from oreline.operators import leaves
from oreline.plans.registry import bw, packed, query, uv, zz


def profile_sql(source: str, keys: str, order: str, token: str) -> str:
    """CTEs s (all sizes per column) and c (candidates) for DuckDB."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    size = f"{uv('strlen(tok)')} + strlen(tok)"
    return f"""
    t AS (SELECT {keys}, {order}, {token}::VARCHAR AS tok, ({token})::BIGINT AS v FROM {source}),
    l1 AS (SELECT *, row_number() OVER w AS i, v - lag(v) OVER w AS dl FROM t WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
    l2 AS (SELECT *, dl - lag(dl) OVER (PARTITION BY {keys} ORDER BY {order}) AS dd FROM l1),
    a AS (SELECT {keys}, count(*) AS n, sum({size})::BIGINT AS raw_bytes, min(v) AS v_min, max(v) AS v_max,
          max(CASE WHEN i = 1 THEN v END) AS v0, max(CASE WHEN i = 2 THEN dl END) AS d0,
          min(dl) AS d_min, max(dl) AS d_max, min(dd) AS dd_min, max(dd) AS dd_max FROM l2 GROUP BY {keys}),
    b AS (SELECT {keys}, count(*) AS d, sum({size})::BIGINT AS dict_bytes FROM (SELECT DISTINCT {keys}, tok FROM t) GROUP BY {keys}),
    s AS (SELECT {a_keys}, n, d, raw_bytes AS raw_size,
          {uv('d')} + dict_bytes + 1 + {packed('n', f"CASE WHEN d <= 1 THEN 0 ELSE {bw('d - 1')} END")} AS dict_size,
          {uv(zz('v_min'))} + 1 + {packed('n', bw('v_max - v_min'))} AS for_size,
          CASE WHEN n >= 2 THEN {uv(zz('v0'))} + {uv(zz('d_min'))} + 1 + {packed('n - 1', bw('d_max - d_min'))} END AS delta_size,
          CASE WHEN n >= 3 THEN {uv(zz('v0'))} + {uv(zz('d0'))} + {uv(zz('dd_min'))} + 1 + {packed('n - 2', bw('dd_max - dd_min'))} END AS dod_size
          FROM a JOIN b ON {on}),
    c AS (SELECT {keys}, n, leaf_id, p AS payload, 1 + {uv('n')} + {uv('p')} + p AS size FROM (
          SELECT {keys}, n, 0 AS leaf_id, raw_size AS p FROM s UNION ALL SELECT {keys}, n, 1, dict_size FROM s
          UNION ALL SELECT {keys}, n, 2, for_size FROM s UNION ALL SELECT {keys}, n, 3, delta_size FROM s
          UNION ALL SELECT {keys}, n, 4, dod_size FROM s) WHERE p IS NOT NULL),
    best AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY size, leaf_id) AS rn FROM c)"""


SELECT_SQL = """
    SELECT {cols}, s.n::BIGINT AS n, d::BIGINT AS d, raw_size::BIGINT AS raw_size, dict_size::BIGINT AS dict_size,
           for_size::BIGINT AS for_size, delta_size::BIGINT AS delta_size, dod_size::BIGINT AS dod_size,
           leaf_id::INT AS leaf_id, size::BIGINT AS size
    FROM s JOIN best USING ({keys}) WHERE rn = 1"""

LINEITEM_ORDER = "l_orderkey, l_linenumber, l_partkey"


@query("leaf_select_lineitem", "WITH" + profile_sql("lineitem", "l_suppkey", LINEITEM_ORDER, "l_partkey") + SELECT_SQL.format(cols="l_suppkey", keys="l_suppkey"))
def leaf_select_lineitem(t):
    """The cheapest of five encodings of each supplier's part keys."""
    return leaves.select_leaf(t("lineitem").withColumn("tok", F.col("l_partkey")), ["l_suppkey"], LINEITEM_ORDER.split(", "), "tok")


@query("leaf_sizes_events_ts", "WITH" + profile_sql("(SELECT user_id, event_id, epoch_us(ts) AS us FROM events)", "user_id", "event_id", "us") + SELECT_SQL.format(cols="user_id", keys="user_id"))
def leaf_sizes_events_ts(t):
    """Encodings of each user's event times in microseconds."""
    rows = t("events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts)").alias("us"))
    return leaves.select_leaf(rows, ["user_id"], ["event_id"], "us")


@query(
    "leaf_family_masks",
    "WITH" + profile_sql("lineitem", "l_suppkey", LINEITEM_ORDER, "l_partkey")
    + """, f AS (SELECT * FROM (VALUES ('RAW', [0]), ('DICT', [0, 1]), ('INT', [0, 2, 3, 4]), ('MIXED', [0, 1, 2, 3, 4])) v(family, ids)),
    r AS (SELECT family, l_suppkey, size, row_number() OVER (PARTITION BY family, l_suppkey ORDER BY size, leaf_id) AS rn
          FROM c JOIN f ON list_contains(ids, leaf_id))
    SELECT family, count(*)::BIGINT AS columns, sum(size)::BIGINT AS total_size FROM r WHERE rn = 1 GROUP BY family""",
)
def leaf_family_masks(t):
    """Total size under each family of encodings."""
    rows = t("lineitem").withColumn("tok", F.col("l_partkey"))
    found = leaves.leaf_candidates(leaves.leaf_sizes(leaves.column_profile(rows, ["l_suppkey"], LINEITEM_ORDER.split(", "), "tok")), ["l_suppkey"])
    family = F.explode(F.array(*[F.when(F.col("leaf_id").isin(*ids), F.lit(name)) for name, ids in leaves.FAMILIES.items()])).alias("family")
    least = found.select("l_suppkey", "size", family).where("family IS NOT NULL").groupBy("family", "l_suppkey").agg(F.min("size").alias("size"))
    return least.groupBy("family").agg(F.count("*").alias("columns"), F.sum("size").alias("total_size"))


@query(
    "leaf_rank_proxy_s1",
    "WITH" + profile_sql("lineitem", "l_suppkey", LINEITEM_ORDER, "l_partkey")
    + """, p AS (SELECT l_suppkey, leaf_id, size, payload, row_number() OVER (PARTITION BY l_suppkey ORDER BY payload, leaf_id) AS proxy_rank,
          row_number() OVER (PARTITION BY l_suppkey ORDER BY size, leaf_id) AS true_rank FROM c)
    SELECT l_suppkey, leaf_id::INT AS leaf_id, proxy_rank::INT AS proxy_rank, true_rank::INT AS true_rank, (size - payload)::BIGINT AS framing FROM p""",
)
def leaf_rank_proxy_s1(t):
    """Rank of each candidate by its payload, the cheap proxy, and by its complete size."""
    from pyspark.sql import Window

    rows = t("lineitem").withColumn("tok", F.col("l_partkey"))
    found = leaves.leaf_candidates(leaves.leaf_sizes(leaves.column_profile(rows, ["l_suppkey"], LINEITEM_ORDER.split(", "), "tok")), ["l_suppkey"])
    w = Window.partitionBy("l_suppkey")
    return found.select(
        "l_suppkey",
        "leaf_id",
        F.row_number().over(w.orderBy("payload", "leaf_id")).alias("proxy_rank"),
        F.row_number().over(w.orderBy("size", "leaf_id")).alias("true_rank"),
        (F.col("size") - F.col("payload")).alias("framing"),
    )


@query(
    "substitutions_top24",
    "WITH" + profile_sql("lineitem", "l_suppkey", LINEITEM_ORDER, "l_partkey")
    + """, r AS (SELECT l_suppkey, size AS raw FROM c WHERE leaf_id = 0)
    SELECT (l_suppkey // 10)::BIGINT AS shape, (l_suppkey % 10)::BIGINT AS slot, leaf_id::INT AS leaf, (size - raw)::BIGINT AS delta FROM c JOIN r USING (l_suppkey) WHERE leaf_id <> 0 ORDER BY delta, shape, slot, leaf LIMIT 24""",
)
def substitutions_top24(t):
    """The 24 best replacements of raw columns."""
    from oreline.operators import select

    rows = t("lineitem").withColumn("tok", F.col("l_partkey"))
    found = leaves.leaf_candidates(leaves.leaf_sizes(leaves.column_profile(rows, ["l_suppkey"], LINEITEM_ORDER.split(", "), "tok")), ["l_suppkey"])
    return select.substitutions(found, ["l_suppkey"], F.floor(F.col("l_suppkey") / 10).cast("bigint"), (F.col("l_suppkey") % 10).cast("bigint"))


@query(
    "scalar_costs",
    f"""WITH k AS (SELECT o_orderkey, o_custkey, (o_custkey - 700)::BIGINT AS x FROM orders)
    SELECT o_orderkey, {uv('o_orderkey')}::BIGINT AS key_len, {zz('x')}::BIGINT AS zz, x AS back, {bw('o_custkey')}::BIGINT AS width,
           {packed('o_orderkey', bw('o_custkey'))}::BIGINT AS packed_bytes,
           (CASE WHEN ((x * 77) % 65536 + 65536) % 65536 >= 32768 THEN ((x * 77) % 65536 + 65536) % 65536 - 65536 ELSE ((x * 77) % 65536 + 65536) % 65536 END)::BIGINT AS ring,
           least(13, length(bin(o_orderkey // 4)) - 1)::INT AS class
    FROM k""",
)
def scalar_costs(t):
    """LEB128, zigzag, widths, packing, rings and length classes over order keys."""
    k = t("orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") - 700).alias("x"))
    return k.select(
        "o_orderkey",
        uvar_len("o_orderkey").alias("key_len"),
        zigzag("x").alias("zz"),
        unzigzag(zigzag("x")).alias("back"),
        bit_width("o_custkey").alias("width"),
        packed_size("o_orderkey", bit_width("o_custkey")).alias("packed_bytes"),
        signed_ring(F.col("x") * 77, 2).alias("ring"),
        doubling_class("o_orderkey").cast("int").alias("class"),
    )
