"""Queries over numeric series and record layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oreline.operators import layout, series
from oreline.plans.registry import bw, query, uv, zz

KEYS, ORDER = ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]
BY = "PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey"
WORDS = 256
#: Words of orders: a line with exceptions.
ORDER_WORDS = "o_orderkey * 5 + CASE WHEN o_orderkey % 37 = 0 THEN 11 ELSE 0 END"


def part_blocks(t):
    return series.series_blocks(t("lineitem"), KEYS, ORDER, "l_partkey", WORDS)


def order_blocks(t):
    rows = t("orders").select(F.lit(0).alias("file"), "o_orderkey", F.expr(ORDER_WORDS).alias("v"), F.floor(F.col("o_orderkey") / WORDS).alias("part"))
    return series.series_blocks(rows, ["part"], ["o_orderkey"], "v", WORDS)


#: Words of supplier blocks: block, i within it, v.
BLOCKS = f"""n AS (SELECT l_suppkey, row_number() OVER ({BY}) - 1 AS k, l_partkey AS v FROM lineitem),
    b AS (SELECT l_suppkey, k // {WORDS} AS block, k % {WORDS} AS i, v FROM n)"""
#: The median line of each block of b (keys l_suppkey, block), its residuals and local innovations.
FIT = f"""{BLOCKS},
    df AS (SELECT *, v - lag(v) OVER (PARTITION BY l_suppkey, block ORDER BY i) AS d, count(*) OVER (PARTITION BY l_suppkey, block) AS c, first_value(v) OVER (PARTITION BY l_suppkey, block ORDER BY i) AS v0 FROM b),
    sr AS (SELECT l_suppkey, block, c, d, row_number() OVER (PARTITION BY l_suppkey, block ORDER BY d) - 1 AS r FROM df WHERE d IS NOT NULL),
    st AS (SELECT l_suppkey, block, d AS step FROM sr WHERE r = (c - 1) // 2),
    o AS (SELECT df.*, step, v - v0 - i * step AS off FROM df JOIN st USING (l_suppkey, block) WHERE c >= 3),
    orank AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, block ORDER BY off) - 1 AS r FROM o),
    bs AS (SELECT l_suppkey, block, v0 + off AS base FROM orank WHERE r = c // 2),
    z AS (SELECT l_suppkey, block, i, c, step, base, {zz('v - base - i * step')} AS around, CASE WHEN d IS NOT NULL THEN {zz('d - step')} END AS local FROM o JOIN bs USING (l_suppkey, block)),
    g AS (SELECT l_suppkey, block, c, step, base, {bw('max(around)')} AS median_bits, {bw('max(local)')} AS local_bits FROM z GROUP BY ALL)"""
SIZES = f"11 + {uv('c')} + (c * median_bits + 7) // 8 AS median_size, 11 + {uv('c')} + ((c - 1) * local_bits + 7) // 8 AS local_size, 1 + {uv('4 * c')} + 4 * c AS raw_size"


@query("delta_dod", f"""WITH d AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_partkey - lag(l_partkey) OVER ({BY}) AS delta FROM lineitem)
    SELECT *, delta - lag(delta) OVER ({BY}) AS dod FROM d""")  # fmt: skip
def delta_dod(t):
    """Differences and differences of differences along each supplier's lines."""
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumn("delta", series.difference("l_partkey", KEYS, ORDER)).withColumn("dod", series.difference("l_partkey", KEYS, ORDER, 2))


@query("kth_difference", f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey,
    l_partkey - 3 * lag(l_partkey, 1) OVER w + 3 * lag(l_partkey, 2) OVER w - lag(l_partkey, 3) OVER w AS third FROM lineitem WINDOW w AS ({BY})""")  # fmt: skip
def kth_difference(t):
    """Third differences as one binomial sum."""
    return t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", series.difference("l_partkey", KEYS, ORDER, 3).alias("third"))


@query("xor_prev_leading_zeros", f"""WITH x AS (SELECT l_suppkey, xor(l_partkey, lag(l_partkey) OVER ({BY})) AS x FROM lineitem)
    SELECT l_suppkey, (64 - {bw('x')})::INT AS leading, count(*)::BIGINT AS n FROM x WHERE x IS NOT NULL GROUP BY ALL""")  # fmt: skip
def xor_prev_leading_zeros(t):
    """Leading zeros of XORs with the value before."""
    x = t("lineitem").select("l_suppkey", series.xor_previous("l_partkey", KEYS, ORDER).alias("x")).where("x IS NOT NULL")
    return x.groupBy("l_suppkey", series.leading_zeros(F.col("x")).cast("int").alias("leading")).agg(F.count("*").alias("n"))


@query("affine_median_model", f"""WITH {FIT}, s AS (SELECT *, {SIZES} FROM g)
    SELECT l_suppkey, block::BIGINT AS block, c::BIGINT AS n_words, step::BIGINT AS step, ((base % 4294967296 + 4294967296) % 4294967296)::BIGINT AS base, median_bits::BIGINT AS median_bits, median_size::BIGINT AS median_size, raw_size::BIGINT AS raw_size FROM s""")  # fmt: skip
def affine_median_model(t):
    """Blocks as a median line and packed residuals."""
    return series.model_sizes(part_blocks(t), KEYS).where("n_words >= 3").select("l_suppkey", "block", "n_words", "step", "base", "median_bits", "median_size", "raw_size")


@query("local_innovation_model", f"WITH {FIT}, s AS (SELECT *, {SIZES} FROM g) SELECT l_suppkey, block::BIGINT AS block, local_bits::BIGINT AS local_bits, local_size::BIGINT AS local_size, (local_size < raw_size) AS beats_raw FROM s")
def local_innovation_model(t):
    """Blocks as steps around the median step."""
    s = series.model_sizes(part_blocks(t), KEYS).where("n_words >= 3")
    return s.select("l_suppkey", "block", "local_bits", "local_size", (F.col("local_size") < F.col("raw_size")).alias("beats_raw"))


@query("tiled_width_model", f"""WITH {FIT}, ta AS (SELECT l_suppkey, block, i // 16 AS tile, count(*) AS n, {bw('max(around)')} AS bits FROM z GROUP BY ALL),
    tl AS (SELECT l_suppkey, block, (i - 1) // 16 AS tile, count(*) AS n, {bw('max(local)')} AS bits FROM z WHERE local IS NOT NULL GROUP BY ALL),
    a AS (SELECT l_suppkey, block, 9 + sum(1 + (n * bits + 7) // 8) AS tiled_size FROM ta GROUP BY ALL), l AS (SELECT l_suppkey, block, 9 + sum(1 + (n * bits + 7) // 8) AS tiled_local_size FROM tl GROUP BY ALL)
    SELECT l_suppkey, block::BIGINT AS block, tiled_size::BIGINT AS tiled_size, tiled_local_size::BIGINT AS tiled_local_size FROM a JOIN l USING (l_suppkey, block)""")  # fmt: skip
def tiled_width_model(t):
    """Residuals in tiles of 16 with a width each."""
    return series.model_sizes(part_blocks(t), KEYS).where("n_words >= 3").select("l_suppkey", "block", "tiled_size", "tiled_local_size")


@query("affine_modal_exceptions", f"""WITH b AS (SELECT o_orderkey // {WORDS} AS part, o_orderkey, {ORDER_WORDS} AS v, row_number() OVER (PARTITION BY o_orderkey // {WORDS} ORDER BY o_orderkey) - 1 AS i FROM orders),
    d AS (SELECT part, v - lag(v) OVER (PARTITION BY part ORDER BY i) AS d FROM b), dc AS (SELECT part, d, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY ALL),
    st AS (SELECT part, d AS step FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, d) AS r FROM dc) WHERE r = 1),
    c AS (SELECT part, v - i * step AS base, count(*) AS n FROM b JOIN st USING (part) GROUP BY ALL), bs AS (SELECT part, base FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, base) AS r FROM c) WHERE r = 1),
    e AS (SELECT part, i - coalesce(lag(i) OVER (PARTITION BY part ORDER BY i), -1) - 1 AS gap FROM b JOIN st USING (part) JOIN bs USING (part) WHERE v <> base + i * step),
    x AS (SELECT part, count(*) AS n, sum({uv('gap')} + 4) AS bytes FROM e GROUP BY part), w AS (SELECT part, count(*) AS c FROM b GROUP BY part)
    SELECT part::BIGINT AS part, step::BIGINT AS step, base::BIGINT AS base, coalesce(n, 0)::BIGINT AS exceptions, (10 + {uv('c')} + CASE WHEN n > 0 THEN {uv('n')} + bytes ELSE 0 END)::BIGINT AS modal_size
    FROM w JOIN st USING (part) JOIN bs USING (part) LEFT JOIN x USING (part)""")  # fmt: skip
def affine_modal_exceptions(t):
    """Blocks as their commonest line and sparse exceptions."""
    s = series.model_sizes(order_blocks(t), ["part"])
    return s.select("part", F.col("modal_step").alias("step"), F.col("modal_base").alias("base"), "exceptions", "modal_size")


STRIDES = f"""b AS (SELECT o_orderkey // {WORDS} AS part, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_custkey ELSE 7 END AS v, row_number() OVER (PARTITION BY o_orderkey // {WORDS} ORDER BY o_orderkey) - 1 AS k FROM orders),
    m AS (SELECT part, count(*) AS n FROM b GROUP BY part), l AS (SELECT part, n, stride, n // stride AS c, k % stride AS lane, k // stride AS i, v FROM b JOIN m USING (part), (SELECT unnest(range(2, 13)) AS stride) WHERE k < n // stride * stride AND n // stride >= 3),
    df AS (SELECT *, v - lag(v) OVER p AS d, first_value(v) OVER p AS v0 FROM l WINDOW p AS (PARTITION BY part, stride, lane ORDER BY i)),
    st AS (SELECT part, stride, lane, d AS step FROM (SELECT *, row_number() OVER (PARTITION BY part, stride, lane ORDER BY d) - 1 AS r FROM df WHERE d IS NOT NULL) WHERE r = (c - 1) // 2),
    o AS (SELECT part, stride, lane, c, n, v0, v - v0 - i * step AS off FROM df JOIN st USING (part, stride, lane)),
    bs AS (SELECT part, stride, lane, off AS shift FROM (SELECT *, row_number() OVER (PARTITION BY part, stride, lane ORDER BY off) - 1 AS r FROM o) WHERE r = c // 2),
    w AS (SELECT part, stride, lane, c, n, {bw('max(' + zz('off - shift') + ')')} AS bits FROM o JOIN bs USING (part, stride, lane) GROUP BY ALL),
    y AS (SELECT part, stride, n, c, count(*) FILTER (WHERE 10 + (c * bits + 7) // 8 < 1 + 4 * c) AS lanes, sum(least(1 + 4 * c, 10 + (c * bits + 7) // 8)) AS body FROM w GROUP BY ALL),
    s AS (SELECT part, stride, lanes, 2 + {uv('4 * n')} + 4 * (n - c * stride) + body AS size FROM y)"""


@query("strided_lane_model", f"WITH {STRIDES} SELECT part::BIGINT AS part, stride::BIGINT AS stride, lanes::BIGINT AS stride_lanes, size::BIGINT AS stride_size FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY size, stride) AS r FROM s) WHERE r = 1")
def strided_lane_model(t):
    """The best stride of interleaved fields."""
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, k).when(k % 3 == 1, F.col("o_custkey")).otherwise(7)
    rows = t("orders").select("o_orderkey", v.alias("v"), F.floor(k / WORDS).alias("part"))
    return series.model_sizes(series.series_blocks(rows, ["part"], ["o_orderkey"], "v", WORDS), ["part"]).where("stride IS NOT NULL").select("part", "stride", "stride_lanes", "stride_size")


@query("numeric_probe_gate", f"""WITH {BLOCKS}, c AS (SELECT l_suppkey, block, count(*) AS n FROM b GROUP BY ALL),
    p AS (SELECT l_suppkey, block, n, stride, lane, least(32, (n - 1 - lane) // stride) AS pairs FROM c, (SELECT unnest(range(1, 13)) AS stride), (SELECT unnest(range(0, 4)) AS lane) WHERE lane < stride AND n > lane + 24 * stride),
    d AS (SELECT p.*, abs(y.v - x.v) <= 4096 AS small FROM p JOIN b x ON x.l_suppkey = p.l_suppkey AND x.block = p.block AND x.i >= lane AND (x.i - lane) % stride = 0 AND (x.i - lane) // stride < pairs
          JOIN b y ON y.l_suppkey = p.l_suppkey AND y.block = p.block AND y.i = x.i + stride),
    g AS (SELECT l_suppkey, block, stride, lane, (count(*) FILTER (WHERE small)) * 8 >= max(pairs) * 7 AS ok FROM d GROUP BY ALL), r AS (SELECT l_suppkey, block, bool_or(ok) AS ok FROM g GROUP BY ALL)
    SELECT c.l_suppkey, c.block::BIGINT AS block, n >= 128 AND coalesce(ok, false) AS regular FROM c LEFT JOIN r USING (l_suppkey, block)""")  # fmt: skip
def numeric_probe_gate(t):
    """Blocks regular enough to try numeric models on."""
    return series.model_sizes(part_blocks(t), KEYS).select("l_suppkey", "block", "regular")


@query("cheapest_block_model")
def cheapest_block_model(t):
    """The cheapest model of each block, raw winning ties."""
    return series.model_sizes(part_blocks(t), KEYS).select("l_suppkey", "block", "model", "model_size", "raw_size")


SYMBOLS = "s AS (SELECT doc_id, unnest(range(0, strlen(text))) AS i, unnest(regexp_extract_all(hex(encode(text)), '..')) AS sym, strlen(text) AS n FROM documents WHERE text <> '')"


@query("period_match_fraction", f"""WITH {SYMBOLS}, p AS (SELECT doc_id, n, p, sym = lag(sym, p) OVER (PARTITION BY doc_id, p ORDER BY i) AS same FROM s, (SELECT unnest(range(1, 9)) AS p))
    SELECT doc_id, p AS lag, (count(*) FILTER (WHERE same))::BIGINT AS matches, count(same)::BIGINT AS compared FROM p GROUP BY doc_id, p HAVING count(same) > 0""")  # fmt: skip
def period_match_fraction(t):
    """How many bytes equal the byte 1 to 8 before, as its SQL has it; ``period_spectrum`` goes to 1,024."""
    return layout.per_text(t("documents").where("text <> ''"), "doc_id", "text", lambda b: layout.match_fractions(b, 8), "lag bigint, matches bigint, compared bigint")


@query("period_spectrum")
def period_spectrum(t):
    """How many bytes equal the byte 1 to 1,024 before, for which SQL would need a row per byte and lag."""
    return layout.per_text(t("documents").where("text <> ''"), "doc_id", "text", lambda b: layout.match_fractions(b, 1024), "lag bigint, matches bigint, compared bigint")


@query("field_const_test", f"""WITH {BLOCKS} SELECT l_suppkey, block::BIGINT AS block, (i % 4)::INT AS field, min(v) = max(v) AS const, count(DISTINCT v)::BIGINT AS values FROM b GROUP BY ALL""")
def field_const_test(t):
    """Whether each of four interleaved fields of a block is constant."""
    words = part_blocks(t).select("l_suppkey", "block", F.posexplode("words").alias("i", "v"))
    return words.groupBy("l_suppkey", "block", (F.col("i") % 4).alias("field")).agg((F.min("v") == F.max("v")).alias("const"), F.countDistinct("v").alias("values"))


@query("tiling_cost", f"""WITH {SYMBOLS}, v AS (SELECT doc_id, n, i, ('0x' || sym)::INT AS b FROM s), t AS (SELECT * FROM (SELECT unnest([1, 2, 4]) AS stride), (SELECT unnest([0, 1]) AS k)),
    l AS (SELECT doc_id, n, stride, k, i % stride AS lane, CASE WHEN k = 0 THEN b ELSE b - lag(b) OVER (PARTITION BY doc_id, stride, k, i % stride ORDER BY i) END AS d FROM v, t),
    f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, stride, k, lane) AS words FROM l), c AS (SELECT doc_id, n, stride, k, lane, words, d, count(*) AS c FROM f WHERE d IS NOT NULL AND words >= 8 GROUP BY ALL),
    e AS (SELECT doc_id, n, stride, k, lane, -sum(c * log2(c / (words - k))) + (k + 1) * 32 AS bits FROM c GROUP BY doc_id, n, stride, k, lane, words)
    SELECT doc_id, stride::BIGINT AS stride, k::BIGINT AS diff_order, round(sum(bits) + 8.0 * (n - stride * ((n - 1) // stride + 1)) + 64, 6) AS bits FROM e GROUP BY doc_id, n, stride, k""")  # fmt: skip
def tiling_cost(t):
    """Bits of each document as byte lanes of a stride, differenced or not, with seeds and framing."""

    def costs(b):
        found = [(stride, k, layout.tiling_cost(b, stride, 1, k)) for stride in (1, 2, 4) for k in (0, 1)]
        return [(s, k, round(c, 6)) for s, k, c in found if c is not None]

    return layout.per_text(t("documents").where("text <> ''"), "doc_id", "text", costs, "stride bigint, diff_order bigint, bits double")


@query("lane_sweep_topn", f"""WITH {SYMBOLS}, v AS (SELECT doc_id, n, i, ('0x' || sym)::INT AS b FROM s), w AS (SELECT doc_id, stride, i, b FROM v, (SELECT unnest(range(1, 5)) AS stride) WHERE i % stride = 0),
    d AS (SELECT doc_id, stride, b AS d0, b - lag(b) OVER p AS d1, b - 2 * lag(b) OVER p + lag(b, 2) OVER p AS d2, count(*) OVER (PARTITION BY doc_id, stride) AS words FROM w WINDOW p AS (PARTITION BY doc_id, stride ORDER BY i)),
    u AS (SELECT doc_id, stride, words, 0 AS k, d0 AS d FROM d UNION ALL SELECT doc_id, stride, words, 1, d1 FROM d UNION ALL SELECT doc_id, stride, words, 2, d2 FROM d),
    c AS (SELECT doc_id, stride, words, k, d, count(*) AS c FROM u WHERE d IS NOT NULL AND words >= 64 GROUP BY ALL),
    e AS (SELECT doc_id, stride, k, words, round(-sum(c * log2(c / (words - k))) / (words * stride), 9) + 0 AS rate FROM c GROUP BY doc_id, stride, k, words)
    SELECT doc_id, stride::BIGINT AS stride, k::BIGINT AS diff_order, words::BIGINT AS words, rate, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rate, stride, k) AS r FROM e) WHERE r <= 4""")  # fmt: skip
def lane_sweep_topn(t):
    """Of each document's byte lanes from offset 0 with strides 1 to 4, as its SQL has them, the four with the fewest bits per covered byte; ``lane_sweep_full`` sweeps all."""

    def best(b):
        found = sorted(layout.lane_rates(b, range(1, 5)), key=lambda x: (x[5], x[2], x[3]))[:4]
        return [(s, k, n, rate, r + 1) for r, (_, _, s, k, n, rate) in enumerate(found)]

    s = layout.per_text(t("documents").where("text <> ''"), "doc_id", "text", best, "stride bigint, diff_order bigint, words bigint, rate double, rank bigint")
    return s.withColumn("rank", F.col("rank").cast("int"))


@query("lane_sweep_full")
def lane_sweep_full(t):
    """The four lanes of each document with the fewest bits per covered byte, of widths 1, 2, 4 and 8 with all offsets and strides to 64."""

    def best(b):
        return [(*x, r) for r, x in enumerate(layout.best_lanes(b, 4), 1)]

    s = layout.per_text(t("documents").where("text <> ''"), "doc_id", "text", best, "width bigint, offset bigint, stride bigint, diff_order bigint, words bigint, rate double, rank bigint")
    return s.withColumn("rank", F.col("rank").cast("int"))


@query("min_n_payoff", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > l_tax * 100 THEN (floor((64 + l_quantity - 2 * (l_tax * 100)) / (l_quantity - l_tax * 100)) + 1)::BIGINT END AS min_n FROM lineitem")
def min_n_payoff(t):
    """From how many values on a model with a seed cost pays."""
    h = F.col("l_tax") * 100
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", series.payoff_rows(F.lit(64) + F.col("l_quantity"), 2, h, F.col("l_quantity")).alias("min_n"))


@query("modal_value", """SELECT l_suppkey, q::BIGINT AS mode, n::BIGINT AS n FROM (SELECT l_suppkey, l_quantity AS q, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY l_suppkey, l_quantity) WHERE r = 1""")
def modal_value(t):
    """Each supplier's commonest quantity, ties to the smaller."""
    counts = t("lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("bigint").alias("q")).agg(F.count("*").alias("n"))
    return counts.groupBy("l_suppkey").agg(F.max(F.struct("n", (-F.col("q")).alias("w"))).alias("m")).select("l_suppkey", (-F.col("m.w")).alias("mode"), F.col("m.n").alias("n"))


@query("invariant_selectivity", f"""WITH w AS (SELECT l_suppkey, l_partkey - lag(l_partkey, 7) OVER ({BY}) AS key FROM lineitem), c AS (SELECT l_suppkey, key, count(*) AS n FROM w WHERE key IS NOT NULL GROUP BY ALL)
    SELECT l_suppkey, sum(n)::BIGINT AS windows, count(*)::BIGINT AS keys, (sum(n) FILTER (WHERE n > 1))::BIGINT AS colliding FROM c GROUP BY l_suppkey""")  # fmt: skip
def invariant_selectivity(t):
    """How many windows share a step key with another."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    keys = t("lineitem").select("l_suppkey", (F.col("l_partkey") - F.lag("l_partkey", 7).over(w)).alias("key")).where("key IS NOT NULL")
    counts = keys.groupBy("l_suppkey", "key").agg(F.count("*").alias("n"))
    return counts.groupBy("l_suppkey").agg(F.sum("n").alias("windows"), F.count("*").alias("keys"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("colliding"))


@query("discover_period")
def discover_period(t):
    """The period, of up to 1,024 bytes, at which each document's bytes are cheapest as records."""
    return layout.per_text(t("documents").where("text <> ''"), "doc_id", "text", lambda b: [x] if (x := layout.discover_period(b)) else [], "period bigint, bits double")


@query("record_partition")
def record_partition(t):
    """Fields of each supplier series' bytes as records of eight bytes."""
    packed = F.array_join(F.transform("words", lambda v: F.lpad(v.cast("string"), 8, "0")), "")
    texts = part_blocks(t).select(F.concat_ws("/", "l_suppkey", "block").alias("id"), packed.alias("text"))
    return layout.per_text(texts, "id", "text", lambda b: layout.partition_record(b, 8), "offset bigint, width bigint, kind string, bits double")
