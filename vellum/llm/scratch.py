"""Tables that cut lineage, kept where every executor can read them.

They live under ``spark.checkpoint.dir``, which a cluster sets to shared storage, so a lost
executor costs only the tasks it was running. Only a session in one process (``local[...]``:
tests, a laptop) that names no such folder gets a local one; on a cluster that is an error.
Folders are deleted when the driver ends, as results are read from them until then.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a folder of our own where it is unset and there is one process only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return _own[key]


class Scratch:
    """Written tables of one operator call; each name is written once."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/vellum-{purpose}-{uuid.uuid4().hex}"
        fs, path = self._at(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back: its plan then starts at the files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            fs, path = self._at(self.path(name))
            fs.delete(path, True)

    def _at(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, whatever their names: the struct keeps them apart from columns of our own."""
    return F.struct(*(docs["`" + c.replace("`", "``") + "`"] for c in docs.columns))


def unused_name(docs: DataFrame, base: str) -> str:
    """base, with underscores until no column of docs is called so in any case."""
    taken = {c.lower() for c in docs.columns}
    while base.lower() in taken:
        base += "_"
    return base
