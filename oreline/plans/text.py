"""Queries over documents as byte strings and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oreline.operators import bytestats, records
from oreline.plans.registry import bw, query, uv

SYMBOLS = "SELECT doc_id, unnest(range(1, strlen(text) + 1)) AS i, unnest(regexp_extract_all(hex(encode(text)), '..')) AS sym FROM documents WHERE text <> ''"
#: Line frames with their terminators.
FRAMES = """parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
    frames AS (SELECT doc_id, i - 1 AS rec_id, CASE WHEN i < len(p) THEN p[i] || chr(10) ELSE p[i] END AS record
               FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts) WHERE i < len(p) OR p[i] <> '')"""


@query(
    "byte_entropy_docs",
    f"""WITH s AS ({SYMBOLS}), c AS (SELECT doc_id, sym, count(*) AS n FROM s GROUP BY doc_id, sym),
    m AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
    SELECT doc_id, total::BIGINT AS n_bytes, count(*)::BIGINT AS distinct_bytes, round(-sum(n * log2(n / total)) / total, 9) + 0 AS entropy
    FROM c JOIN m USING (doc_id) GROUP BY doc_id, total""",
)
def byte_entropy_docs(t):
    """Order-0 entropy of each document's bytes."""
    s = bytestats.byte_statistics(t("documents").where("text <> ''"), "doc_id", "text", ["n_bytes", "distinct_bytes", "entropy"])
    return s.select("doc_id", "n_bytes", "distinct_bytes", F.round("entropy", 9).alias("entropy"))


@query(
    "byte_entropy_order1_docs",
    f"""WITH s AS ({SYMBOLS}), p AS (SELECT doc_id, i, sym, lag(sym) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s),
    j AS (SELECT doc_id, before, sym, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY ALL),
    x AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id, before) AS c, sum(n) OVER (PARTITION BY doc_id) AS m FROM j)
    SELECT doc_id, round(-sum(n * log2(n / c)) / max(m), 9) + 0 AS order1_entropy FROM x GROUP BY doc_id""",
)
def byte_entropy_order1_docs(t):
    """Entropy of each byte given the byte before."""
    s = bytestats.byte_statistics(t("documents").where("octet_length(text) > 1"), "doc_id", "text", ["order1_entropy"])
    return s.select("doc_id", (F.round("order1_entropy", 9) + 0).alias("order1_entropy"))


@query(
    "h0_scaled_docs",
    f"""WITH s AS ({SYMBOLS}), c AS (SELECT doc_id, sym, count(*) AS n FROM s GROUP BY doc_id, sym),
    m AS (SELECT doc_id, sum(n)::BIGINT AS total FROM c GROUP BY doc_id)
    SELECT doc_id, sum(256 * n * ({bw('total - 1')} - (length(bin(n)) - 1)))::BIGINT AS h0_scaled FROM c JOIN m USING (doc_id) GROUP BY doc_id""",
)
def h0_scaled_docs(t):
    """The whole-number entropy surface of each document."""
    return bytestats.byte_statistics(t("documents").where("text <> ''"), "doc_id", "text", ["h0_scaled"])


@query(
    "vxor_zero_density",
    f"""WITH {FRAMES}, d AS (SELECT doc_id, max(strlen(record)) AS stride, count(*) AS records FROM frames GROUP BY doc_id),
    grid AS (SELECT doc_id, rec_id, record, unnest(range(0, stride)) AS i FROM frames JOIN d USING (doc_id)),
    cells AS (SELECT doc_id, rec_id, i, coalesce(nullif(substr(hex(encode(record)), 2 * i + 1, 2), ''), '00') AS x FROM grid),
    v AS (SELECT doc_id, x = lag(x, 1, '00') OVER (PARTITION BY doc_id, i ORDER BY rec_id) AS same FROM cells)
    SELECT doc_id, max(records)::BIGINT AS records, max(stride)::BIGINT AS stride, count(*)::BIGINT AS matrix_bytes,
           (count(*) FILTER (WHERE same))::BIGINT AS xor_zeros, round((count(*) FILTER (WHERE same)) / count(*), 9) AS zero_density
    FROM v JOIN d USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM documents WHERE text <> '') GROUP BY doc_id""",
)
def vxor_zero_density(t):
    """Share of zeros when each record is XORed with the one before, padded to the longest."""
    s = bytestats.byte_statistics(t("documents").where("text <> ''"), "doc_id", "text", ["records", "stride", "matrix_bytes", "xor_zeros"])
    return s.select("doc_id", "records", "stride", "matrix_bytes", "xor_zeros", F.round(F.col("xor_zeros") / F.col("matrix_bytes"), 9).alias("zero_density"))


@query(
    "text_likeness",
    f"""WITH s AS ({SYMBOLS})
    SELECT doc_id, count(*)::BIGINT AS n_bytes, (count(*) FILTER (WHERE sym IN ('09', '0A', '0B', '0C', '0D') OR (sym >= '20' AND sym <= '7E')))::BIGINT AS printable,
           (count(*) FILTER (WHERE sym IN ('09', '0A', '0B', '0C', '0D') OR (sym >= '20' AND sym <= '7E'))) * 100 >= count(*) * 95 AS is_text
    FROM s GROUP BY doc_id""",
)
def text_likeness(t):
    """Documents of which 95 % of the bytes are printable ASCII."""
    s = bytestats.byte_statistics(t("documents").where("text <> ''"), "doc_id", "text", ["n_bytes", "printable"])
    return s.select("doc_id", "n_bytes", "printable", bytestats.text_like(F.col("printable"), F.col("n_bytes"), 95, 100).alias("is_text"))


@query(
    "prev_byte_context_sizes",
    f"""WITH s AS ({SYMBOLS}), p AS (SELECT lag(sym, 1, '00') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s)
    SELECT ('0x' || before)::INT AS context, count(*)::BIGINT AS n FROM p GROUP BY before""",
)
def prev_byte_context_sizes(t):
    """How many bytes each context of one byte routes."""
    return bytestats.context_sizes(t("documents"), "text")


@query(
    "incompressibility_gate",
    """WITH d AS (SELECT doc_id, strlen(text) AS n, greatest(1, strlen(text) // 1024) AS stride, hex(encode(text)) AS h FROM documents),
    w AS (SELECT doc_id, substr(h, i * stride * 2 + 1, 8) AS x FROM (SELECT *, unnest(range(0, least(1024, (n - 4) // stride + 1))) AS i FROM d WHERE n >= 512)),
    c AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM w GROUP BY doc_id)
    SELECT d.doc_id, coalesce(dup * 100 <= 1024, false) AS incompressible FROM d LEFT JOIN c USING (doc_id) WHERE n IS NOT NULL""",
)
def incompressibility_gate(t):
    """Documents whose sampled windows hardly repeat, at which dearer encoders needn't be tried."""
    s = bytestats.byte_statistics(t("documents").where("text IS NOT NULL"), "doc_id", "text", ["n_bytes", "repeats"])
    return s.select("doc_id", bytestats.looks_incompressible(F.col("repeats"), F.col("n_bytes")).alias("incompressible"))


@query(
    "record_split_docs",
    f"WITH {FRAMES} SELECT doc_id, rec_id::INT AS rec_id, strlen(record)::BIGINT AS n_bytes, sha256(record) AS digest FROM frames",
)
def record_split_docs(t):
    """Line frames of every document."""
    r = records.split_records(t("documents"), "doc_id", "text")
    return r.select("doc_id", "rec_id", F.octet_length("record").cast("bigint").alias("n_bytes"), F.sha2("record", 256).alias("digest"))


@query(
    "fixed_block_split",
    """SELECT doc_id, i::INT AS block_id, length(substr(text, i * 256 + 1, 256))::BIGINT AS blen, sha256(substr(text, i * 256 + 1, 256)) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 255) // 256)) AS i FROM documents)""",
)
def fixed_block_split(t):
    """Blocks of 256 characters."""
    b = t("documents").select("doc_id", F.posexplode(records.fixed_blocks(F.col("text"), 256)).alias("block_id", "block"))
    return b.select("doc_id", "block_id", F.length("block").cast("bigint").alias("blen"), F.sha2("block", 256).alias("digest"))


@query(
    "record_stats_docs",
    f"""WITH {FRAMES}, r AS (SELECT doc_id, strlen(record) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY strlen(record)) AS k,
        count(*) OVER (PARTITION BY doc_id) AS c FROM frames)
    SELECT doc_id, max(c)::BIGINT AS record_count, min(n)::BIGINT AS len_min, median(n)::DOUBLE AS len_median,
           max(CASE WHEN k = ceil(95 * c / 100) THEN n END)::BIGINT AS len_p95, max(n)::BIGINT AS len_max, round(stddev_pop(n) / avg(n), 9) AS len_cv
    FROM r GROUP BY doc_id""",
)
def record_stats_docs(t):
    """Least, median, 95th percentile, most and CV of record lengths; no exchange, a document is one row."""
    lengths = F.transform(records.frames(F.col("text")), lambda x: F.octet_length(x))
    s = t("documents").where("text <> ''").select("doc_id", lengths.alias("l")).select("doc_id", *[e.alias(k) for k, e in records.length_statistics(F.col("l")).items()])
    return s.withColumn("len_cv", F.round("len_cv", 9))


@query(
    "crlf_frame_counters",
    f"""WITH {FRAMES} SELECT doc_id, count(*)::BIGINT AS frames, (count(*) FILTER (WHERE ends_with(record, chr(13) || chr(10))))::BIGINT AS crlf,
    (count(*) FILTER (WHERE ends_with(record, chr(10)) AND NOT ends_with(record, chr(13) || chr(10))))::BIGINT AS lf,
    (count(*) FILTER (WHERE NOT ends_with(record, chr(10))))::BIGINT AS unterminated FROM frames GROUP BY doc_id""",
)
def crlf_frame_counters(t):
    """Frames by their terminator."""
    f = records.frames(F.col("text"))
    ends = lambda x, s: F.endswith(x, F.lit(s))
    count = lambda p: F.size(F.filter("f", p)).cast("bigint")
    return t("documents").where("text <> ''").select("doc_id", f.alias("f")).select(
        "doc_id",
        F.size("f").cast("bigint").alias("frames"),
        count(lambda x: ends(x, "\r\n")).alias("crlf"),
        count(lambda x: ends(x, "\n") & ~ends(x, "\r\n")).alias("lf"),
        count(lambda x: ~ends(x, "\n")).alias("unterminated"),
    )


@query(
    "line_transpose_counts",
    f"""WITH {FRAMES}, g AS (SELECT doc_id, unnest(range(0, length(record))) AS col FROM frames),
    c AS (SELECT doc_id, col, count(*) AS n FROM g GROUP BY doc_id, col)
    SELECT doc_id, col::INT AS col, n::BIGINT AS n, (sum(n) OVER (PARTITION BY doc_id ORDER BY col) - n)::BIGINT AS column_offset FROM c""",
)
def line_transpose_counts(t):
    """Where each column of a document's line-column transpose begins: a prefix sum of column heights."""
    r = records.split_records(t("documents"), "doc_id", "text").select("doc_id", F.length("record").alias("n"))
    ends = r.groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    # lines of at least col + 1 characters: a suffix sum over the distinct lengths
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"))
    tall = ends.select("doc_id", "n", F.sum("c").over(w).alias("h"), F.coalesce(F.lead("n").over(w), F.lit(0)).alias("low"))
    cols = tall.select("doc_id", F.explode(F.sequence(F.col("low"), F.col("n") - 1)).alias("col"), F.col("h").alias("n"))
    return cols.withColumn("column_offset", F.sum("n").over(Window.partitionBy("doc_id").orderBy("col")) - F.col("n"))


@query(
    "rle_zero_runs",
    """WITH v AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_partkey % 3 AS v FROM lineitem),
    m AS (SELECT *, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS run FROM v),
    r AS (SELECT l_suppkey, run, count(*) AS n FROM m WHERE v = 0 GROUP BY l_suppkey, run)
    SELECT l_suppkey, n::BIGINT AS run_length, count(*)::BIGINT AS runs FROM r GROUP BY l_suppkey, n""",
)
def rle_zero_runs(t):
    """Histogram of zero-run lengths in each supplier's series."""
    rows = t("lineitem").withColumn("v", F.col("l_partkey") % 3)
    return records.zero_runs(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "v").groupBy("l_suppkey", "run_length").agg(F.count("*").alias("runs"))


@query(
    "default_exception_size",
    f"""WITH c AS (SELECT l_suppkey, CASE WHEN l_quantity < 30 THEN 0 ELSE l_quantity::BIGINT END AS v, count(*) AS c FROM lineitem GROUP BY ALL),
    m AS (SELECT l_suppkey, sum(c)::BIGINT AS n, max(c) AS top FROM c GROUP BY l_suppkey),
    d AS (SELECT l_suppkey, n, top, min(v) AS default_value FROM c JOIN m USING (l_suppkey) WHERE c.c = top GROUP BY ALL)
    SELECT l_suppkey, n, default_value::BIGINT AS default_value, (n - top)::BIGINT AS exceptions,
           (CASE WHEN top >= n // 2 THEN 2 + {uv('n')} + {uv('n - top')} + (n + 7) // 8 + (n - top) END)::BIGINT AS size FROM d""",
)
def default_exception_size(t):
    """Size of each supplier's quantities as a common value and exceptions."""
    rows = t("lineitem").withColumn("v", F.when(F.col("l_quantity") < 30, 0).otherwise(F.col("l_quantity").cast("bigint")))
    return records.default_with_exceptions(rows, ["l_suppkey"], "v")
