"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the session names in ``spark.checkpoint.dir``. Where that is
    unset a local session gets a folder of its own; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"oreline-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint.

    Where its size is known to be about ``rows`` it gets a partition for 100,000 of them, at
    most as many as it has: every partition is a file, and on a file system without native
    calls every file costs the executor a process.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // 100_000)))).checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores in front of those that ``df`` already has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def batched(df: DataFrame) -> DataFrame:
    """``df``, after bounding its session's Arrow batches by bytes, so that long texts don't make large ones.

    Only a session that still has Spark's default bound is changed.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, "8m")
    return df


def groups_of_bytes(values: list, most: int, size: Callable = len) -> Iterator[tuple[int, int]]:
    """Cut ``values`` into runs [lo, hi) of about ``most`` summed size; each has a value at least."""
    lo = 0
    held = 0
    for i, v in enumerate(values):
        n = size(v)
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(values):
        yield lo, len(values)


def held_out(col: str, folds: int):
    """True where crc32 of the id as text falls in fold 0 (null id: fold 0 of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds == 0
