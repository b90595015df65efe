"""Shapes of JSON records: exact templates, their slots, orders of tokens and carrier sizes.

A record's template is every byte between its scalar values; keys belong to
it, and so do white space and key order. Parsing is one Arrow pass that gives the
parts and the values of a record; all else is grouping and ranking.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.scalars import framed_size, uvar_len
from oreline.session import cut

TOKEN = re.compile(
    r'(?P<space>[ \t\r\n]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<scalar>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<mark>[{}\[\],:])"
)


def scalar_spans(text: str) -> list[tuple[int, int]] | None:
    """Where the scalar values of a JSON text stand; None if it isn't one JSON value."""
    spans: list[tuple[int, int]] = []
    stack: list[str] = []
    want = "value"  # value, first (value or end), key, keyfirst (key or end), colon, next
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            return None
        kind, token = m.lastgroup, m.group()
        at = m.end()
        if kind == "space":
            continue
        if kind == "string" and want in ("key", "keyfirst"):
            want = "colon"
        elif kind in ("string", "scalar") and want in ("value", "first"):
            spans.append(m.span())
            want = "next"
        elif kind != "mark":
            return None
        elif token in "{[" and want in ("value", "first"):
            stack.append(token)
            want = "keyfirst" if token == "{" else "first"
        elif token == ":" and want == "colon":
            want = "value"
        elif token == "," and want == "next" and stack:
            want = "key" if stack[-1] == "{" else "value"
        elif token in "}]" and stack and stack[-1] == ("{" if token == "}" else "[") and want in ("next", "keyfirst" if token == "}" else "first"):
            stack.pop()
            want = "next"
        else:
            return None
    return spans if want == "next" and not stack else None


def parse_records(rows: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """id_cols, valid, parts (one more than values) and values. A null or invalid text has no parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, parts, values = [], [], []
            for text in batch.column(len(id_cols)).to_pylist():
                spans = None if text is None else scalar_spans(text)
                valid.append(spans is not None)
                spans = spans or []
                values.append([text[a:b] for a, b in spans])
                edges = [0, *(x for s in spans for x in s), len(text or "")]
                parts.append([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)] if valid[-1] else [])
            text_list = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(id_cols)], pa.array(valid, pa.bool_()), pa.array(parts, text_list), pa.array(values, text_list)], names=[*id_cols, "valid", "parts", "values"]
            )

    ids = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.select(*id_cols, text_col).mapInArrow(run, f"{ids}, valid boolean, parts array<string>, values array<string>")


def template(parts: Column | str = "parts", mark: str = "?") -> Column:
    return F.array_join(parts, mark)


def shape_dictionary(parsed: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """One row per template: shape_id by first appearance, template, members, slots, first.

    Without ``keys`` ids are ranks over the whole table of shapes, which is small beside the records.
    """
    keys = keys or []
    found = parsed.where("valid").groupBy(*keys, template().alias("template")).agg(
        F.count("*").alias("members"), F.min(order).alias("first"), F.max(F.size("values")).cast("bigint").alias("slots"), F.max(F.transform("parts", lambda p: F.octet_length(p))).alias("part_bytes")
    )
    if keys:
        w = Window.partitionBy(*keys).orderBy("first")
        return found.withColumn("shape_id", F.row_number().over(w) - 1)
    return global_rank(found, ["first"], "shape_id")


def shape_coverage(members: DataFrame, keys: list[str], count: str = "members") -> DataFrame:
    """Singletons, records in the 1, 5, 10 and 100 largest shapes, lower median, p95 by floor, largest."""
    w = Window.partitionBy(*keys)
    down, up = w.orderBy(F.desc(count), "shape_id"), w.orderBy(count, "shape_id")
    n = F.count("*").over(w)
    ranked = members.select(*keys, F.col(count).alias("_c"), F.row_number().over(down).alias("_d"), F.row_number().over(up).alias("_u"), n.alias("_n"))
    top = lambda k: F.sum(F.when(F.col("_d") <= k, F.col("_c"))).alias(f"top{k}")
    at = lambda i: F.max(F.when(F.col("_u") == i, F.col("_c")))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("shapes"),
        F.count_if(F.col("_c") == 1).alias("singletons"),
        *[top(k) for k in (1, 5, 10, 100)],
        at(F.floor((F.col("_n") - 1) / 2) + 1).alias("median_members"),
        at(F.floor(F.lit(95) * (F.col("_n") - 1) / 100) + 1).alias("p95_members"),
        F.max("_c").alias("max_members"),
    )


def carrier_sizes(parsed: DataFrame, shapes: DataFrame, magic: int = 6) -> DataFrame:
    """Bytes of a shape carrier by category; row-major and column-major hold the same bytes in another order."""
    rows = parsed.where("valid").select(template().alias("template"), "values", "parts")
    ids = rows.join(shapes.select("template", "shape_id"), "template")
    value_bytes = F.aggregate("values", F.lit(0).cast("bigint"), lambda s, v: s + F.octet_length(v))
    length_bytes = F.aggregate("values", F.lit(0).cast("bigint"), lambda s, v: s + uvar_len(F.octet_length(v).cast("bigint")))
    part_total = lambda f: F.aggregate("part_bytes", F.lit(0).cast("bigint"), lambda s, p: s + f(p.cast("bigint")))
    body = ids.agg(
        F.count("*").alias("records"),
        F.sum(uvar_len("shape_id")).alias("shape_id_bytes"),
        F.sum(length_bytes).alias("value_length_bytes"),
        F.sum(value_bytes).alias("raw_value_bytes"),
        F.sum(value_bytes + F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + F.octet_length(p))).alias("source_bytes"),
    )
    dictionary = shapes.agg(
        F.count("*").alias("shapes"),
        F.sum(uvar_len("members") + uvar_len("slots") + part_total(framed_size)).alias("shape_dictionary_bytes"),
        F.sum(part_total(lambda p: p)).alias("template_bytes"),
    )
    both = body.crossJoin(F.broadcast(dictionary))  # one row each
    header = F.lit(magic) + uvar_len("source_bytes") + uvar_len("records") + uvar_len("shapes")
    total = F.col("header_bytes") + F.col("shape_dictionary_bytes") + F.col("shape_id_bytes") + F.col("value_length_bytes") + F.col("raw_value_bytes")
    return both.withColumn("header_bytes", header).withColumn("carrier_bytes", total).withColumn("template_bytes_avoided", F.col("source_bytes") - F.col("raw_value_bytes") - F.col("template_bytes"))


def tokens(parsed: DataFrame, shapes: DataFrame, order: str) -> DataFrame:
    """One row per token: shape_id, occurrence (of the record in its shape), slot, token and the record's order.

    Records are ranked by shape and order over range partitions, so a shape that most records have is many tasks' work; a
    shape's first rank is its offset.
    """
    rows = parsed.where("valid").select(order, template().alias("template"), "values").join(shapes.select("template", "shape_id"), "template")
    ranked = cut(global_rank(rows.select("shape_id", order, "values"), ["shape_id", order], "_rank"))
    first = ranked.groupBy("shape_id").agg(F.min("_rank").alias("_first"))
    numbered = ranked.join(first, "shape_id").withColumn("occurrence", (F.col("_rank") - F.col("_first")).cast("int"))
    return numbered.select(order, "shape_id", "occurrence", F.posexplode("values").alias("slot", "token"))


#: Token orders by the columns that rank them; the first is by source position.
def order_columns(kind: str, order: str) -> list[str]:
    return {"source": [order, "slot"], "shape_row": ["shape_id", "occurrence", "slot"], "shape_column": ["shape_id", "slot", "occurrence"], "ordinal": ["slot", "shape_id", "occurrence"]}[kind]


def global_rank(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Rows with their rank from 0 in a total order, without gathering them in one partition.

    Range partitions are sorted on their own; only their row counts, one per
    partition, are summed to offsets.
    """
    part = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = part.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = part.groupBy("_part").count().collect()  # one row per partition
    total, pairs = 0, []
    for r in sorted(counts, key=lambda r: r["_part"]):
        pairs += [F.lit(r["_part"]), F.lit(total)]
        total += r["count"]
    offset = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    return within.withColumn(name, (offset + F.col("_i") - 1).cast("bigint")).drop("_part", "_i")


def permutation_key(seed: Column | str | int, index: Column) -> Column:
    """The hash that a seeded random permutation is sorted by: sha256 of seed, 0x1F and index."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), index.cast("string")), 256)


def multiset_fingerprint(rows: DataFrame, keys: list[str], token: str) -> DataFrame:
    """SHA-256 over each group's sorted distinct tokens with their counts: equal for equal multisets."""
    counts = rows.groupBy(*keys, token).agg(F.count("*").alias("_c"))
    framed = F.concat_ws(":", F.octet_length(token).cast("string"), F.col(token), F.col("_c").cast("string"))
    return counts.groupBy(*keys).agg(F.sum("_c").alias("tokens"), F.sha2(F.array_join(F.array_sort(F.collect_list(framed)), "|"), 256).alias("fingerprint"))
