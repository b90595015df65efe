"""Queries over JSON records made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.operators import shapes
from oreline.plans.registry import query, uv

#: Records of four shapes; every eleventh is cut short where ``broken``.
RECORDS = """recs AS (SELECT event_id, user_id, event_type, '{"id":' || event_id || ',"t":"' || event_type || '"' ||
    CASE WHEN event_id % 5 = 0 THEN ',"u":' || user_id ELSE '' END || CASE WHEN event_id % 7 = 0 THEN ',"p":' || props ELSE '' END || '}' AS rec FROM events)"""
SCALAR = r"""(:\s*)("[^"]*"|-?[0-9]+)"""
SHAPES = f"""{RECORDS}, parsed AS (SELECT *, regexp_replace(rec, '{SCALAR}', '\\1?', 'g') AS template, regexp_extract_all(rec, '{SCALAR}', 2) AS vals FROM recs),
    found AS (SELECT template, count(*) AS members, min(event_id) AS first, max(len(vals)) AS slots FROM parsed GROUP BY template),
    shapes AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS shape_id FROM found)"""
TOKENS = f"""{SHAPES}, numbered AS (SELECT event_id, shape_id, vals, row_number() OVER (PARTITION BY shape_id ORDER BY event_id) - 1 AS occurrence FROM parsed JOIN shapes USING (template)),
    tokens AS (SELECT event_id, shape_id, occurrence, unnest(range(0, len(vals))) AS slot, unnest(vals) AS token FROM numbered)"""


def records(t):
    e = F.col("event_id")
    rec = F.concat(
        F.lit('{"id":'), e.cast("string"), F.lit(',"t":"'), F.col("event_type"), F.lit('"'),
        F.when(e % 5 == 0, F.concat(F.lit(',"u":'), F.col("user_id").cast("string"))).otherwise(""),
        F.when(e % 7 == 0, F.concat(F.lit(',"p":'), F.col("props"))).otherwise(""), F.lit("}"),
    )
    return t("events").select("event_id", "user_id", "event_type", rec.alias("rec"))


def parsed(t):
    return shapes.parse_records(records(t), ["event_id", "user_id", "event_type"], "rec")


@query("shape_dictionary", f"WITH {SHAPES} SELECT shape_id::BIGINT AS shape_id, template, members::BIGINT AS members, slots::BIGINT AS slots, first FROM shapes")
def shape_dictionary(t):
    """Templates in order of first appearance."""
    return shapes.shape_dictionary(parsed(t), "event_id").select("shape_id", "template", "members", "slots", "first")


@query(
    "shape_coverage",
    f"""WITH {SHAPES}, c AS (SELECT user_id, shape_id, count(*) AS m FROM parsed JOIN shapes USING (template) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, shape_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY m, shape_id) AS u,
          count(*) OVER (PARTITION BY user_id) AS n FROM c)
    SELECT user_id, count(*)::BIGINT AS shapes, (count(*) FILTER (WHERE m = 1))::BIGINT AS singletons, (sum(m) FILTER (WHERE d <= 1))::BIGINT AS top1,
           (sum(m) FILTER (WHERE d <= 5))::BIGINT AS top5, (sum(m) FILTER (WHERE d <= 10))::BIGINT AS top10, (sum(m) FILTER (WHERE d <= 100))::BIGINT AS top100,
           (max(m) FILTER (WHERE u = (n - 1) // 2 + 1))::BIGINT AS median_members, (max(m) FILTER (WHERE u = 95 * (n - 1) // 100 + 1))::BIGINT AS p95_members, max(m)::BIGINT AS max_members
    FROM r GROUP BY user_id""",
)
def shape_coverage(t):
    """How few shapes cover each user's records."""
    found = shapes.shape_dictionary(parsed(t), "event_id", ["user_id"])
    return shapes.shape_coverage(found, ["user_id"])


@query(
    "shape_row_col_carrier_bytes",
    f"""WITH {SHAPES}, v AS (SELECT shape_id, rec, unnest(vals) AS v, event_id FROM parsed JOIN shapes USING (template)),
    val AS (SELECT sum({uv('strlen(v)')}) AS value_length_bytes, sum(strlen(v)) AS raw_value_bytes FROM v),
    r AS (SELECT count(*) AS records, sum(strlen(rec)) AS source_bytes, sum({uv('shape_id')}) AS shape_id_bytes FROM parsed JOIN shapes USING (template)),
    p AS (SELECT shape_id, unnest(string_split(template, '?')) AS part FROM shapes),
    d AS (SELECT (SELECT count(*) FROM shapes) AS shapes, (SELECT sum({uv('members')} + {uv('slots')}) FROM shapes) + sum({uv('strlen(part)')} + strlen(part)) AS dict_bytes, sum(strlen(part)) AS template_bytes FROM p),
    a AS (SELECT *, 6 + {uv('source_bytes')} + {uv('records')} + {uv('shapes')} AS header_bytes FROM r, val, d)
    SELECT records::BIGINT AS records, shapes::BIGINT AS shapes, source_bytes::BIGINT AS source_bytes, header_bytes::BIGINT AS header_bytes, dict_bytes::BIGINT AS shape_dictionary_bytes,
           template_bytes::BIGINT AS template_bytes, shape_id_bytes::BIGINT AS shape_id_bytes, value_length_bytes::BIGINT AS value_length_bytes, raw_value_bytes::BIGINT AS raw_value_bytes,
           (header_bytes + dict_bytes + shape_id_bytes + value_length_bytes + raw_value_bytes)::BIGINT AS carrier_bytes, (source_bytes - raw_value_bytes - template_bytes)::BIGINT AS template_bytes_avoided FROM a""",
)
def shape_row_col_carrier_bytes(t):
    """What a shape carrier of all records would cost, by category."""
    from oreline.session import cut

    p = cut(parsed(t))
    return shapes.carrier_sizes(p, shapes.shape_dictionary(p, "event_id"))


@query(
    "shape_regions",
    f"""WITH {RECORDS}, b AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN substr(rec, 1, length(rec) - 1) ELSE rec END AS rec, event_id % 11 <> 0 AS valid FROM recs),
    r AS (SELECT event_type, CASE WHEN valid THEN regexp_replace(rec, '{SCALAR}', '\\1?', 'g') END AS template, strlen(rec) AS n, valid FROM b)
    SELECT event_type, CASE WHEN valid THEN 'structured' ELSE 'raw' END AS kind, template, count(*)::BIGINT AS records, sum(n)::BIGINT AS n_bytes,
           (min(valid::INT) OVER (PARTITION BY event_type)) = 1 AS whole_eligible
    FROM r GROUP BY event_type, valid, template""",
)
def shape_regions(t):
    """Regions of each type's records: one per shape, and one raw region for lines that don't parse."""
    from pyspark.sql import Window

    broken = records(t).withColumn("rec", F.when(F.col("event_id") % 11 == 0, F.substring("rec", F.lit(1), F.length("rec") - 1)).otherwise(F.col("rec")))
    p = shapes.parse_records(broken.withColumn("n", F.octet_length("rec").cast("bigint")), ["event_type", "n"], "rec")
    kind = F.when(F.col("valid"), "structured").otherwise("raw").alias("kind")
    regions = p.groupBy("event_type", kind, F.when(F.col("valid"), shapes.template()).alias("template")).agg(F.count("*").alias("records"), F.sum("n").alias("n_bytes"))
    return regions.withColumn("whole_eligible", F.count_if(F.col("kind") == "raw").over(Window.partitionBy("event_type")) == 0)


def all_tokens(t):
    from oreline.session import cut

    p = cut(parsed(t))
    return shapes.tokens(p, shapes.shape_dictionary(p, "event_id"), "event_id")


def token_order_sql(order: str) -> str:
    return f"WITH {TOKENS} SELECT shape_id::BIGINT AS shape_id, occurrence::INT AS occurrence, slot::INT AS slot, token, row_number() OVER (ORDER BY {order}) - 1 AS rank FROM tokens"


def ordered(t, kind):
    return shapes.global_rank(all_tokens(t), shapes.order_columns(kind, "event_id")).select("shape_id", "occurrence", "slot", "token", "rank")


@query("token_order_source", token_order_sql("event_id, slot"))
def token_order_source(t):
    """Tokens as they stand in the records."""
    return ordered(t, "source")


@query("token_order_row", token_order_sql("shape_id, occurrence, slot"))
def token_order_row(t):
    """Tokens by shape, record and slot."""
    return ordered(t, "shape_row")


@query("token_order_column", token_order_sql("shape_id, slot, occurrence"))
def token_order_column(t):
    """Tokens by shape, slot and record."""
    return ordered(t, "shape_column")


@query("token_order_ordinal", token_order_sql("slot, shape_id, occurrence"))
def token_order_ordinal(t):
    """Tokens by slot across shapes."""
    return ordered(t, "ordinal")


@query(
    "token_moved_count",
    f"""WITH {TOKENS}, r AS (SELECT shape_id, row_number() OVER (ORDER BY shape_id, slot, occurrence) AS a, row_number() OVER (ORDER BY slot, shape_id, occurrence) AS b FROM tokens)
    SELECT shape_id::BIGINT AS shape_id, count(*)::BIGINT AS tokens, (count(*) FILTER (WHERE a <> b))::BIGINT AS moved FROM r GROUP BY shape_id""",
)
def token_moved_count(t):
    """How many tokens of each shape stand elsewhere in the ordinal order than in the column order."""
    both = shapes.global_rank(shapes.global_rank(all_tokens(t), shapes.order_columns("shape_column", "event_id"), "a"), shapes.order_columns("ordinal", "event_id"), "b")
    return both.groupBy("shape_id").agg(F.count("*").alias("tokens"), F.count_if(F.col("a") != F.col("b")).alias("moved"))


@query(
    "token_resolve",
    f"""WITH {TOKENS}, w AS (SELECT shape_id, slot, max(occurrence) AS occurrence FROM tokens GROUP BY ALL)
    SELECT w.shape_id::BIGINT AS shape_id, w.slot::INT AS slot, w.occurrence::INT AS occurrence, token FROM w JOIN tokens t ON t.shape_id = w.shape_id AND t.slot = w.slot AND t.occurrence = w.occurrence""",
)
def token_resolve(t):
    """Tokens found by shape, slot and occurrence: the last of each column."""
    k = all_tokens(t)
    wanted = k.groupBy("shape_id", "slot").agg(F.max("occurrence").alias("occurrence"))
    return wanted.join(k, ["shape_id", "slot", "occurrence"]).select("shape_id", "slot", "occurrence", "token")


@query(
    "token_multiset_sha",
    f"""WITH {TOKENS}, c AS (SELECT shape_id, slot, token, count(*) AS c FROM tokens GROUP BY ALL),
    f AS (SELECT shape_id, slot, c, strlen(token) || ':' || token || ':' || c AS framed FROM c)
    SELECT shape_id::BIGINT AS shape_id, slot::INT AS slot, sum(c)::BIGINT AS tokens, sha256(string_agg(framed, '|' ORDER BY framed)) AS fingerprint FROM f GROUP BY shape_id, slot""",
)
def token_multiset_sha(t):
    """A fingerprint of each column's tokens that no order changes."""
    return shapes.multiset_fingerprint(all_tokens(t), ["shape_id", "slot"], "token")


@query("hash_permutation", "SELECT o_orderkey, row_number() OVER (ORDER BY sha256('7' || chr(31) || o_orderkey), o_orderkey) - 1 AS rank FROM orders")
def hash_permutation(t):
    """A seeded random order of the orders."""
    keyed = t("orders").select("o_orderkey", shapes.permutation_key(7, F.col("o_orderkey")).alias("h"))
    return shapes.global_rank(keyed, ["h", "o_orderkey"]).select("o_orderkey", "rank")


@query(
    "token_routes",
    """WITH w AS (SELECT event_type, user_id, event_id, (epoch_us(ts) // 1000000)::BIGINT AS d FROM events),
    l AS (SELECT event_type, user_id, d, lag(d) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS before FROM w)
    SELECT event_type, CASE WHEN before IS NULL THEN 'absent' WHEN before = d THEN 'same' ELSE 'delta' END AS route, count(*)::BIGINT AS n, sum(abs(d - before))::BIGINT AS moved FROM l GROUP BY ALL""",
)
def token_routes(t):
    """Whether each displacement is the first of its shape, the same as the last one or a step from it."""
    from pyspark.sql import Window

    d = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', ts)")
    before = F.lag("d").over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    rows = t("events").select("event_type", "user_id", "event_id", d.alias("d")).withColumn("before", before)
    route = F.when(F.col("before").isNull(), "absent").when(F.col("before") == F.col("d"), "same").otherwise("delta")
    return rows.groupBy("event_type", route.alias("route")).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("d") - F.col("before"))).alias("moved"))
