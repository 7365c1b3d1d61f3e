"""Small files and directories in whatever store Spark writes to."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut through the checkpoint folder that the session names.

    A session in one process that names none gets a local one; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="vellum-checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered from 1 in an order, without gathering them: ranges are sorted apart, and only their sizes meet."""
    at, part, size, before = (f"__{name}_{x}" for x in ("at", "part", "size", "before"))
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    placed = ranges.withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(part).agg(F.count("*").alias(size))  # a row for each range
    earlier = F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    here = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + here + 1).drop(at, part, before)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def recover(spark: SparkSession, path: str) -> None:
    """Finish a write_text() that ended after its delete: what stands beside a missing target is complete."""
    if not exists(spark, path) and exists(spark, f"{path}.next"):
        fs, where = _fs(spark, path)
        fs.rename(_fs(spark, f"{path}.next")[1], where)


def copy_in(spark: SparkSession, local: str, target: str) -> None:
    """A file or tree of the driver's disk into the store."""
    fs, where = _fs(spark, target)
    fs.copyFromLocalFile(_fs(spark, f"file://{local}")[1], where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename over it. Stores have no common rename that replaces: recover() closes the gap."""
    recover(spark, path)
    fs, where = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.next")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(beside, where)
