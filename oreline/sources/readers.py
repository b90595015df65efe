"""Readers of evidence tables and observation series, and sinks of reports.

All take paths that Spark resolves. Schemas are given, so no file is read
twice, and a row that doesn't fit raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUITE = "file STRING, input_bytes BIGINT, codec STRING, compressed_bytes BIGINT, ratio DOUBLE, encode_MBps DOUBLE, decode_MBps DOUBLE, roundtrip STRING"
PAIRS = "pair INT, position INT, order STRING, arm STRING, seconds DOUBLE, observed_bytes BIGINT, observed_sha256 STRING"
BLOCKS = "file STRING, block_size BIGINT, block_index BIGINT, blen BIGINT, brotli_bytes BIGINT, bwt_coded_bytes BIGINT, bwt_raw INT, winner STRING, margin BIGINT"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A table with a header; an empty field is null and a malformed row an error."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").option("nullValue", "").option("enforceSchema", False).csv(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return csv(spark, path, schema, "\t")


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; raises if a column is missing."""
    if missing := sorted(set(columns) - set(rows.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a folder, one row each, with their file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())


def daily(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width daily observations: station, month, element, day, value (null for -9999), flag.

    A line has an 11-character station, year, month, element and 31 fields of eight characters.
    """
    line = F.col("value")
    number = lambda a, n: F.substring(line, a, n).cast("int")
    day = F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda d: F.struct((d + 1).alias("day"), F.substring(line, d * 8 + 22, F.lit(5)).alias("v"), F.trim(F.substring(line, d * 8 + 28, F.lit(1))).alias("flag")))).alias("d")
    rows = spark.read.text(path).where(F.length("value") >= 21 + 8 * 28)
    rows = rows.select(F.substring(line, 1, 11).alias("station"), number(12, 4).alias("year"), number(16, 2).alias("month"), F.substring(line, 18, 4).alias("element"), day)
    exists = F.try_to_date(F.format_string("%04d-%02d-%02d", "year", "month", "d.day"), "yyyy-MM-dd")
    value = F.nullif(F.trim("d.v").cast("int"), F.lit(-9999))
    return rows.select("station", "element", exists.alias("date"), value.cast("smallint").alias("value"), F.col("d.flag").alias("flag")).where("date IS NOT NULL")


WATER = "value STRUCT<timeSeries: ARRAY<STRUCT<sourceInfo: STRUCT<siteCode: ARRAY<STRUCT<value: STRING>>>, values: ARRAY<STRUCT<value: ARRAY<STRUCT<value: STRING, dateTime: STRING>>>>>>>"


def water_levels(spark: SparkSession, path: str, scale: int = 1000) -> DataFrame:
    """WaterML JSON as site, time, scaled (a whole number of 1/scale, null if inexact) and ordered, false where a time isn't after the one before."""
    from oreline.functions.scalars import exact_fixed_point

    doc = spark.read.schema(WATER).option("multiLine", True).json(path)
    s = doc.select(F.explode("value.timeSeries").alias("s")).select(F.col("s.sourceInfo.siteCode")[0]["value"].alias("site"), F.posexplode(F.flatten(F.col("s.values.value"))).alias("i", "v"))
    before = F.lag("time").over(Window.partitionBy("site").orderBy("i"))
    rows = s.select("site", "i", F.col("v.dateTime").alias("time"), exact_fixed_point("v.value", scale).cast("int").alias("scaled"))
    return rows.withColumn("ordered", F.coalesce(F.col("time") > before, F.lit(True))).drop("i")


def power_series(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of series by parameter and day: parameter, day, value, in order of day."""
    doc = spark.read.schema("properties STRUCT<parameter: MAP<STRING, MAP<STRING, DECIMAL(18,6)>>>").option("multiLine", True).json(path)
    each = doc.select(F.explode("properties.parameter").alias("parameter", "series"))
    return each.select("parameter", F.explode("series").alias("day", "value"))


def profile_lines(spark: SparkSession, path: str) -> DataFrame:
    """Flat profiles: share, seconds and function of each line that has them."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+(?:\d+\s+[\d.]+\s+[\d.]+\s+)?(\S.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).cast("double").alias("share_pct"), part(3).cast("double").alias("seconds"), F.trim(part(4)).alias("function"))


def page_kind(content: Column) -> Column:
    """The kind of a 4096-byte database page, by its first byte."""
    first = F.hex(F.substring(content, 1, 1))
    kinds = {"02": "index_interior", "05": "table_interior", "0A": "index_leaf", "0D": "table_leaf", "53": "header"}  # fixed values of the format
    out = F.lit("other")
    for byte, kind in kinds.items():
        out = F.when(first == byte, kind).otherwise(out)
    return out


def database_pages(found: DataFrame, size: int = 4096) -> DataFrame:
    """path, page, kind of every full page of each file."""
    n = F.floor(F.octet_length("content") / size).cast("int")
    pages = found.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    return pages.select("path", "page", page_kind(F.substring("content", F.col("page") * size + 1, F.lit(size))).alias("kind"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks: what a resumed run still has to write."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def json_rows(rows: DataFrame, schema: str) -> DataFrame:
    """Each row as one JSON text, with the schema's name in it."""
    return rows.select(F.to_json(F.struct(F.lit(schema).alias("schema"), *rows.columns)).alias("value"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report table of at most ``most`` rows; larger results belong in files."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *[[text(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def verify_pins(found: DataFrame, pins: DataFrame) -> DataFrame:
    """Files whose size or MD5 isn't what ``pins`` (name, bytes, md5) says, and pins without a file."""
    have = found.select(F.substring_index("path", "/", -1).alias("name"), F.octet_length("content").cast("bigint").alias("_bytes"), F.md5("content").alias("_md5"))
    both = pins.join(have, "name", "left")
    return both.where(F.col("_md5").isNull() | (F.col("_bytes") != F.col("bytes")) | (F.col("_md5") != F.col("md5"))).select("name", F.when(F.col("_md5").isNull(), "missing").otherwise("differs").alias("problem"))


def write_files(found: DataFrame, folder: str, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """Write each row's bytes to a file of its name in ``folder``, a path or URI that executors share; returns names and sizes.

    A file is written under another name and then renamed, so a task that is run again leaves no half of one.
    """
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        own, plain = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        own.create_dir(plain, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{plain}/.{uuid.uuid4().hex}"
                with own.open_output_stream(part, compression=None) as f:
                    f.write(content or b"")
                own.move(part, f"{plain}/{name}")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "size"])

    return found.select(F.col(name_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(run, "name string, size bigint")


def callgrind(spark: SparkSession, path: str) -> DataFrame:
    """Function and summed self cost of a callgrind profile; cost lines belong to the function named last before them in their file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    w = Window.partitionBy("file").orderBy("i")
    name = F.when(F.col("line").rlike("^fn="), F.regexp_extract("line", r"^fn=(?:\(\d+\)\s*)?(.*)$", 1))
    seen = lines.withColumn("function", F.last(name, ignorenulls=True).over(w)).withColumn("called", F.lag("line").over(w).rlike("^calls="))
    cost = seen.where(F.col("line").rlike(r"^[+*-]?\d+ \d+") & ~F.coalesce("called", F.lit(False)))
    return cost.groupBy("file", "function").agg(F.sum(F.regexp_extract("line", r"^\S+ (\d+)", 1).cast("bigint")).alias("cost"))
