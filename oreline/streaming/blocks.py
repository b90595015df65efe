"""Blocks and events as streams.

Block jobs keep no state: files that arrive are read, coded or checked
block by block. Windowed counts over events, with a watermark, are an extension of
this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.sources import container


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of files as they arrive in a folder."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").load(folder).select("path", "content")


def coded_blocks(files: DataFrame, block_size: int = 1 << 18, codecs: tuple[int, ...] = (2, 9, 32)) -> DataFrame:
    """The coded blocks of arriving files; stateless, so a block is done where its file is read."""
    n = F.ceil(F.octet_length("content") / block_size).cast("int")
    each = files.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_id"))
    blocks = each.select("path", "block_id", F.substring("content", F.col("block_id") * block_size + 1, F.lit(block_size)).alias("data"))
    return container.encode_blocks(blocks, ["path", "block_id"], "data", codecs)


def checked_blocks(files: DataFrame) -> DataFrame:
    """The blocks of arriving containers, decoded and checked against their CRC."""
    return container.scan(files, with_data=True)


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Extension: events by type and window; events later than ``late`` are left out once their window is closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what has arrived to Parquet and stop; a checkpoint makes each file count once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
