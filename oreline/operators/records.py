"""Records of texts: line frames, fixed blocks, order statistics and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(text: Column) -> Column:
    """Line-feed frames, terminator kept; the last may be unterminated, and no empty one follows a final line feed."""
    parts = F.split(text, "\n", -1)
    whole = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(x, F.lit("\n")))
    tail = F.element_at(parts, -1)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.when(tail == "", whole).otherwise(F.array_append(whole, tail)))


def split_records(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, rec_id (from 0), record."""
    return texts.select(id_col, F.posexplode(frames(F.col(text_col))).alias("rec_id", "record"))


def fixed_blocks(text: Column, size: int, whole: bool = False) -> Column:
    """Blocks of ``size`` characters; the last may be shorter, or is left out if they must be ``whole``.

    One scan by a pattern: a substring at a character's number would walk the text anew for every block.
    """
    count = str(size) if whole else f"1,{size}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s).{%s}" % count), 0)


def length_statistics(lengths: Column, kind: str = "median") -> dict[str, Column]:
    """Of an array of whole numbers: count, least, median (of two the mean), p95 by ceiling, most, population CV."""
    a = F.array_sort(lengths)
    n = F.size(a)
    total = F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    squares = F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint") * x)
    deviation = F.sqrt((squares * n - total * total).cast("double")) / n  # whole numbers up to here
    at = lambda i: F.try_element_at(a, i.cast("int"))
    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2.0
    return {
        "record_count": n.cast("bigint"),
        "len_min": at(F.lit(1)).cast("bigint"),
        "len_median": middle,
        "len_p95": at(F.ceil(F.lit(95) * n / 100)).cast("bigint"),
        "len_max": at(n).cast("bigint"),
        "len_cv": F.try_divide(deviation * n, total),
    }


def zero_runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of zeros in each ordered group, by gaps and islands: keys, run, run_length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    nonzero = F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).over(w)
    marked = rows.select(*keys, *order, F.col(value).alias("_v"), nonzero.alias("run"))
    return marked.where("_v = 0").groupBy(*keys, "run").agg(F.count("*").alias("run_length"))


def default_with_exceptions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Size of a byte stream kept as its commonest value and the exceptions, null below half; ties to the smaller value."""
    from oreline.functions.scalars import uvar_len

    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    top = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max(F.struct("_c", (-F.col("_v")).alias("_w"))).alias("_m"))
    n, common = F.col("n"), F.col("_m._c")
    size = F.lit(2) + uvar_len("n") + uvar_len(n - common) + F.floor((n + 7) / 8) + (n - common)
    return top.select(*keys, "n", (-F.col("_m._w")).alias("default_value"), (n - common).alias("exceptions"), F.when(common >= F.floor(n / 2), size).alias("size"))
