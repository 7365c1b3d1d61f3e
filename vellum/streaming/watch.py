"""File changes as a stream of incremental index runs.

The file source wakes a batch for new and changed files; deletions are found as every batch
compares the whole listing with the stored paths. One batch runs at a time, so changes that
come meanwhile are picked up by the next. A run that fails is tried again; if it fails for good,
the query ends with its error and the batch stays uncommitted, so a restart begins with it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.files import qualified

DEBOUNCE = "250 milliseconds"
#: Runs of a batch before its error ends the query, and seconds between them.
ATTEMPTS, PAUSE = 3, 1.0
_FILE = "path string, modificationTime timestamp, length long, content binary"


def _told(callback: Callable[[Any], None] | None, value: Any) -> None:
    if callback:
        try:
            callback(value)
        except Exception:  # noqa: BLE001, S110  a listener's error must not stop the stream
            pass


def watch(engine: Engine, checkpoint: str, debounce: str = DEBOUNCE, on_indexed: Callable[[dict], None] | None = None, on_error: Callable[[Exception], None] | None = None, once: bool = False) -> StreamingQuery:
    """Index now, then after every change. once: stop when nothing is waiting."""
    _told(on_indexed, engine.index())
    spark = engine.spark
    changes = spark.readStream.schema(_FILE).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]*").load(qualified(spark, engine.root)).select("path", "modificationTime")

    def run(batch: DataFrame, epoch: int) -> None:
        for attempt in range(1, ATTEMPTS + 1):
            try:
                done = engine.index()
            except Exception as error:
                _told(on_error, error)
                if attempt == ATTEMPTS:
                    raise
                time.sleep(PAUSE)
            else:
                _told(on_indexed, done)
                return

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def latest_versions(updates: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Of a stream (path, hash, at), the last hash of each path in windows of a minute; late rows are dropped after `delay`."""
    return updates.withWatermark("at", delay).groupBy(F.window("at", "1 minute"), "path").agg(F.max(F.struct("at", "hash")).alias("last")).select("path", F.col("window.start").alias("minute"), F.col("last.hash").alias("hash"))
