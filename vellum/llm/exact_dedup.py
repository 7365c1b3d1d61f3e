"""Exact dedup: a cuckoo-filter index over content digests, sharded by digest.

Every map task runs its own rows through an index first, so a text that fills a third of the
table reaches its shard as one row a task. Shards index what is left. Memory of a task is
bounded: a map-side index is emptied downstream at `MAP_ENTRIES` digests, and the number of
shards follows the number of rows.

A filter's hit is verified against what its bucket holds: the SHA-256 of the whole normalised
text. Comparing the texts byte by byte would shuffle every copy to say the same.

Cases: a null text counts as empty; empty texts are equal to each other and to texts of white
space only. Null doc_ids come last in the choice of the row that stays. Rows equal in text and
doc_id are a tie: one of them stays, in `drop_exact` the one whose whole row is the least as
JSON. Very long texts are hashed whole, one at a time. Columns other than id and text pass
through untouched where rows are filtered, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuckoo import CuckooIndex
from .scratch import Scratch, shuffle_partitions, whole_row
from .tokens import WHITE

MAP_ENTRIES = 200_000
SHARD_ROWS = 400_000

_DIGESTED = "uid long, doc_id long, thash long, points long, digest binary"
_GROUPED = "digest binary, points long, doc_id long, uid long, members long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").fill_null("")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("uid"),
                batch.column("doc_id"),
                batch.column("thash"),
                pc.utf8_length(text).cast(pa.int64()),
                pa.array([hashlib.sha256(x.as_buffer().to_pybytes().translate(None, WHITE)).digest() for x in text], pa.binary()),
            ],
            names=["uid", "doc_id", "thash", "points", "digest"],
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, thash, points, digest of every row: SHA-256 of the text without white space."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("thash"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(_digest, _DIGESTED)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (points, doc_id, uid): more code points, then the smaller doc_id (null last), then the smaller uid."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in part], pa.binary()),
                *(pa.array([v[k] for _, v in part], pa.int64()) for k in range(4)),
            ],
            names=["digest", "points", "doc_id", "uid", "members"],
        )


def _index(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, points, doc_id, uid, members in zip(*(batch.column(k).to_pylist() for k in ("digest", "points", "doc_id", "uid", "members")), strict=True):
                was = index.get(digest)
                best = (points, doc_id, uid)
                index.put(digest, (*(best if was is None else _better(was[:3], best)), members + (was[3] if was else 0)))
            if limit and len(index) >= limit:
                yield from _emit(index)
                index = CuckooIndex()
        yield from _emit(index)

    return run


def groups(digested: DataFrame, shards: int) -> DataFrame:
    """digest, points, doc_id, uid (of the row that stays) and members of every distinct digest."""
    rows = digested.select("digest", "points", "doc_id", "uid", F.lit(1).cast("long").alias("members"))
    combined = rows.mapInArrow(_index(MAP_ENTRIES), _GROUPED)
    return combined.repartition(shards, "digest").mapInArrow(_index(None), _GROUPED)


def _resolve(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = scratch.cut(digests(docs, id_col, text_col), "digests")
    shards = max(shuffle_partitions(spark), -(-rows.count() // SHARD_ROWS))
    return rows, scratch.cut(groups(rows, shards), "groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, thash, keep_id, group_size, kept, text_sha256."""
    rows, found = _resolve(docs, id_col, text_col)
    many = found.where("members > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), "members")
    return rows.join(many, "digest", "left").select(
        "doc_id",
        "thash",
        F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row stands for; columns unchanged."""
    rows, found = _resolve(docs, id_col, text_col)
    marks = Scratch(docs.sparkSession, "exact-marks").cut(_marks(rows, found), "marks")
    held = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    marked = held.join(marks, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("thash")), "left")
    kept = marked.where("repeated is null").select("row.*")
    if marks.where("repeated").isEmpty():
        return kept
    once = marked.where("repeated").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(once.select("row.*"))


def _marks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, thash, repeated of rows that go (repeated false), and of rows that stay and come more than once (true)."""
    many = found.where("members > 1").select("digest", F.col("uid").alias("keep_uid"))
    keys = rows.join(many, "digest").groupBy("doc_id", "thash").agg(F.max(F.col("uid") == F.col("keep_uid")).alias("stays"), F.count("*").alias("n"))
    return keys.where("not stays or n > 1").select("doc_id", "thash", F.col("stays").alias("repeated"))


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """A new state (digest, live) of an index of live digests.

    index: digest, live. added, removed: a digest column, one row for each text that arrives or
    leaves. Counts are summed before the shuffle. A digest leaves the filter when its last
    live text does; removing more than is live leaves none.
    """
    moves = index.select("digest", F.col("live").cast("long").alias("move"), F.lit(0).alias("turn"))
    moves = moves.unionByName(added.groupBy("digest").agg(F.count("*").alias("move")).withColumn("turn", F.lit(1)))
    moves = moves.unionByName(removed.groupBy("digest").agg((-F.count("*")).alias("move")).withColumn("turn", F.lit(2)))
    return moves.repartition(shards, "digest").sortWithinPartitions("turn").mapInArrow(_update, "digest binary, live long")


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, move in zip(batch.column("digest").to_pylist(), batch.column("move").to_pylist(), strict=True):
            live = (index.get(digest) or 0) + move
            if live > 0:
                index.put(digest, live)
            else:
                index.remove(digest)
    rows = list(index.items())
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["digest", "live"])
