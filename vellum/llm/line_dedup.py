"""Line dedup over range-partitioned line hashes.

Each document gives one row per distinct line key: its 128-bit hash and the positions where it
stands. Rows are range-partitioned by (hash, document) and sorted within partitions, so a line
that a third of all documents share is spread over many tasks. A task streams its rows and
holds a handful of them: a run of equal hashes is decided as soon as it has enough documents,
and only a partition's first and last runs are settled with the neighbours' counts. Rows of a
run that stays undecided beyond `HELD` of them, as rows of one doc_id may, are written out and
settled likewise. What comes back is a compressed bitmap of kept lines for each document, not
text.

Cases: a null or empty text is one empty line, which is kept. Keys of fewer than
`min_key_points` code points never count. Documents are counted by distinct doc_id: rows of one
doc_id count once, whatever their texts, and rows of null doc_id count as none, but lose lines
that others make frequent. Rows equal in doc_id and text share a bitmap. Of a line to keep once,
the first occurrence by doc_id (null first) and text hash stays. A very long text is split by
itself; its lines are rows like others. Columns other than id and text are never read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions
from .tokens import WHITE

LINES_PER_PARTITION = 2_000_000
#: Rows of an undecided run that a task holds.
HELD = 2000

_LINES = "hi long, lo long, doc_id long, thash long, at binary, n_lines int"
_FOUND = "hi long, lo long, doc_id long, thash long, at binary, state int"
#: What a streamed row says: drop these lines; undecided member of an edge run, and the first of its run; this edge run is decided.
DROP, OPEN, DECIDED = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _hash_lines(min_key_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, thash, text in zip(batch.column("doc_id").to_pylist(), batch.column("thash").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                at: dict[bytes, list[int]] = {}
                lines = raw.split(b"\n")
                for i, line in enumerate(lines):
                    key = line_key(line)
                    if key and (min_key_points <= 1 or _points(key) >= min_key_points):
                        at.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                rows.append((None, doc_id, thash, None, len(lines)))
                rows.extend((h, doc_id, thash, np.array(where, "<u4").tobytes(), None) for h, where in at.items())
                size += len(raw)
                if size > 4 << 20 or len(rows) > 100_000:
                    yield _line_rows(rows)
                    rows, size = [], 0
            if rows:
                yield _line_rows(rows)

    return run


def _line_rows(rows: list[tuple]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(r[0] or bytes(16) for r in rows), ">i8").reshape(-1, 2).astype(np.int64)
    mask = np.array([r[0] is None for r in rows])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(halves[:, 0], pa.int64(), mask=mask),
            pa.array(halves[:, 1], pa.int64(), mask=mask),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.binary()),
            pa.array([r[4] for r in rows], pa.int32()),
        ],
        names=[x.split()[0] for x in _LINES.split(", ")],
    )


def _stream(min_docs: int, keep_first: bool):
    """Decides each run of equal hashes in a partition sorted by hash, document.

    With keep_first, the first row of a decided run keeps its first line. An edge run gives
    its head to the settlement, as an earlier partition may hold the run's true first row; the
    mark of a partition's last run names the head that it kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = None
        held: list[tuple] = []
        docs = 0
        last_id = last_row = head = None
        decided = first_run = True
        written = False

        def decide() -> None:
            nonlocal decided
            decided = True
            elsewhere = first_run or written  # the settlement finds the run's first row
            if elsewhere:
                out.append((*key, None, None, None, DECIDED))
            for i, row in enumerate(held):
                head_row = keep_first and not i and not written
                if head_row and elsewhere:
                    out.append((*key, *row, OPEN))
                elif where := row[2][4:] if head_row else row[2]:
                    out.append((*key, row[0], row[1], where, DROP))

        def close(final: bool) -> None:
            nonlocal first_run
            if key is not None:
                edge = first_run or final
                if not decided and edge:
                    out.extend((*key, *row, OPEN) for row in held)
                elif decided and final and not first_run:
                    out.append((*key, *(head if keep_first else (None, None)), None, DECIDED))
                first_run = False
            held.clear()

        seen = False
        for batch in batches:
            columns = [batch.column(k) for k in ("hi", "lo", "doc_id", "thash", "at")]
            hi, lo = (c.to_numpy() for c in columns[:2])
            if not len(hi):
                continue
            same = np.zeros(len(hi) + 1, bool)
            same[1:-1] = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
            same[0] = seen and key == (int(hi[0]), int(lo[0]))
            # A run of one row inside the batch can neither reach min_docs nor be an edge.
            alone = ~same[:-1] & ~same[1:] if min_docs > 1 else np.zeros(len(hi), bool)
            alone[0] = alone[-1] = False
            rows = np.flatnonzero(~alone)
            picked = [c.take(pa.array(rows)).to_pylist() for c in columns]
            for i, h, lw, doc_id, thash, where in zip(rows.tolist(), *picked, strict=True):
                if not same[i]:
                    close(False)
                    if i:
                        first_run = False
                    key, docs, last_id, last_row, decided, written, head = (h, lw), 0, None, None, False, False, (doc_id, thash)
                    if not seen:
                        first_run = seen = True
                if (doc_id, thash) == last_row:
                    continue
                last_row = (doc_id, thash)
                if doc_id is not None and doc_id != last_id:
                    docs += 1
                    last_id = doc_id
                if decided:
                    out.append((h, lw, doc_id, thash, where, DROP))
                else:
                    held.append((doc_id, thash, where))
                    if docs >= min_docs:
                        decide()
                        held.clear()
                    elif len(held) >= HELD:
                        out.extend((*key, *row, OPEN) for row in held)
                        written = True
                        held.clear()
            if len(out) > 20_000:
                yield _found_rows(out)
                out = []
        close(True)
        yield _found_rows(out)

    return run


def _found_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _settle(found: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """Rows of edge runs, and of runs that were written out undecided, that are to be dropped."""
    edge = found.where(F.col("state") != DROP)
    first = F.min(F.when(F.col("thash").isNotNull(), F.struct(F.col("doc_id").isNotNull(), "doc_id", "thash")))
    runs = edge.groupBy("hi", "lo").agg(F.max((F.col("state") == DECIDED).cast("int")).alias("marked"), F.count_distinct(F.when(F.col("state") == OPEN, F.col("doc_id"))).alias("open"), first.alias("first"))
    runs = runs.where((F.col("marked") == 1) | (F.col("open") >= min_docs))
    gone = edge.where(F.col("state") == OPEN).join(runs, ["hi", "lo"])
    if keep_first:
        is_first = F.struct(F.col("doc_id").isNotNull(), "doc_id", "thash").eqNullSafe(F.col("first"))
        gone = gone.withColumn("at", F.when(is_first, F.expr("substring(at, 5)")).otherwise(F.col("at")))
    return gone.select("doc_id", "thash", "at")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, maps = [], []
        for n, drops in zip(batch.column("n_lines").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            for at in drops or ():
                keep[np.frombuffer(at, "<u4")] = False
            dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("thash"), batch.column("n_lines").cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "thash", "n_lines", "n_dropped", "keep"])


def kept_flags(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_key_points: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, thash, n_lines, n_dropped and keep (zlib of packed bits, first line first) of every distinct document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("string").alias("text"))
    lines = scratch.cut(rows.mapInArrow(_hash_lines(min_key_points), _LINES), "lines")
    parts = max(shuffle_partitions(spark), -(-lines.count() // LINES_PER_PARTITION))
    ordered = lines.where("hi is not null").repartitionByRange(parts, "hi", "lo", "doc_id", "thash").sortWithinPartitions("hi", "lo", "doc_id", "thash")
    found = scratch.cut(ordered.mapInArrow(_stream(min_docs, keep_first), _FOUND), "found")
    drops = found.where(F.col("state") == DROP).select("doc_id", "thash", "at").unionByName(_settle(found, min_docs, keep_first))
    drops = drops.groupBy("doc_id", "thash").agg(F.collect_list("at").alias("drops")).select(F.col("doc_id").alias("d"), F.col("thash").alias("t"), "drops")
    whole = lines.where("hi is null").groupBy("doc_id", "thash").agg(F.first("n_lines").alias("n_lines"))
    joined = whole.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("thash") == F.col("t")), "left").select("doc_id", "thash", "n_lines", "drops")
    return joined.mapInArrow(_bitmaps, "doc_id long, thash long, n_lines long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, keep, n in zip(batch.column("text"), batch.column("keep").to_pylist(), batch.column("n_lines").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if keep is not None:
                raw = b"\n".join(line for line, k in zip(raw.split(b"\n"), kept_flags(keep, n), strict=True) if k)
            texts.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def kept_digests(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: a bitmap of all ones stays away from the join with the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("string").alias("text"))
    maps = bitmaps.select(F.col("doc_id").alias("d"), F.col("thash").alias("t"), "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    joined = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("thash") == F.col("t")), "left")
    return joined.select("doc_id", "text", "n_lines", "n_dropped", "keep").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
