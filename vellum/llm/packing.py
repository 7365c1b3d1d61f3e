"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are in words. A document longer than the largest sequence is cut into full pieces and a
rest. Pieces of a block are placed longest first, each into the open bin that it fills best. If
none has room, a bin is opened at the size of least cost per word among those that hold the
piece. Which sizes may be opened is optimised jointly: the block is packed once for every upper
limit on the opening size, bins are then cut down to the smallest size that holds their
contents, and the packing of least total cost stays.

Texts stay where they are: each is counted in place, and only ids and lengths are shuffled. A
piece's block is a hash of its document, copy and number, so blocks are even (about `BLOCK`
pieces, whatever repeats), and the packing doesn't depend on how the input is split. The loss
against one global packing is at most the last bins of each block.

Cases: null, empty and blank texts have no piece; they give one row of length 0 with a null bin.
Rows repeated in the input are packed as often as they come; rows of equal id and text are told
apart by number only. Ties in length are in order of id, text hash, copy and piece. A very long
text is counted by itself and spread over blocks by its pieces. Columns other than id and text
are never read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import slices, text_bytes, word_spans

BLOCK = 20_000
#: Copies of a row that one task writes out.
LOT = 50_000
#: Cost of a sequence of each permitted length: its length and a fixed overhead.
SIZES: dict[int, float] = {n: n + 16.0 for n in (512, 1024, 2048, 4096, 8192)}

_SCHEMA = "bin_id long, capacity int, used int, offset int, doc_id long, piece int, start long, length int"


def smallest(sizes: list[int], used: int) -> int:
    return sizes[bisect_left(sizes, used)]


def _place(lengths: list[int], order: list[int], sizes: list[int], cost: Mapping[int, float], limit: int) -> tuple[list[int], list[int]]:
    """The bin of each piece, and the words in each bin, if bins are opened at `limit` at most."""
    opening = {}
    for fit in sizes:
        allowed = [c for c in sizes if fit <= c <= limit]
        opening[fit] = min(allowed, key=lambda c: (cost[c] / c, c)) if allowed else fit
    bin_of, used, room = [0] * len(lengths), [], []
    for i in order:
        need = lengths[i]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(used), opening[smallest(sizes, need)]
            used.append(0)
        bin_of[i] = b
        used[b] += need
        if left > need:
            insort(room, (left - need, b))
    return bin_of, used


def pack(lengths: list[int], cost: Mapping[int, float] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, capacity of each bin, words in each bin; no length over the largest size."""
    sizes = sorted(cost)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best = None
    for limit in sizes:
        bin_of, used = _place(lengths, order, sizes, cost, limit)
        capacity = [smallest(sizes, u) for u in used]
        total = sum(cost[c] for c in capacity)
        if best is None or total < best[0]:
            best = (total, bin_of, capacity, used)
    return best[1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = np.diff(word_spans(*text_bytes(part.column("text")))[2])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("thash"), pa.array(words, pa.int64())], names=["doc_id", "thash", "n"])


def _pack_block(cost: Mapping[int, float]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "thash", "copy", "piece"], ascending=[False, True, True, True, True], na_position="last", kind="stable")
        lengths = pdf["length"].tolist()
        bin_of, capacity, used = pack(lengths, cost)
        filled, offsets = [0] * len(used), []
        for b, length in zip(bin_of, lengths, strict=True):
            offsets.append(filled[b])
            filled[b] += length
        bins = np.array(bin_of)
        return pd.DataFrame(
            {
                "bin_id": (pdf["block"].to_numpy() << 24) + bins,
                "capacity": np.array(capacity)[bins],
                "used": np.array(used)[bins],
                "offset": offsets,
                "doc_id": pdf["doc_id"].astype("Int64"),
                "piece": pdf["piece"],
                "start": pdf["start"],
                "length": lengths,
            }
        )

    return run


def pack_documents(docs: DataFrame, cost: Mapping[int, float] = SIZES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: bin_id, capacity, used, offset in the bin, doc_id, piece, start word, length."""
    scratch, most = Scratch(docs.sparkSession, "pack"), max(cost)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_count, "doc_id long, thash long, n long").groupBy("doc_id", "thash", "n").agg(F.count("*").alias("times"))
    counted = scratch.cut(counted, "counted")
    pieces_of = F.ceil(F.col("n") / most)
    total, repeats = counted.agg(F.sum(pieces_of * F.col("times")), F.max("times")).first()
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / LOT))))
    if (repeats or 0) > LOT:
        lots = lots.repartition("doc_id", "thash", "n", "lot")
    copies = lots.withColumn("copy", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("times"), (F.col("lot") + 1) * LOT) - 1)))
    pieces = copies.where("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces_of - 1)))
    blocks = max(1, -(-(total or 0) // block))
    pieces = pieces.select(
        F.pmod(F.xxhash64("doc_id", "thash", "copy", "piece"), F.lit(blocks)).alias("block"),
        "doc_id",
        "thash",
        "copy",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * most).alias("start"),
        F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("length"),
    )
    packed = pieces.groupBy("block").applyInPandas(_pack_block(dict(cost)), _SCHEMA)
    none = F.lit(None).cast("int")
    empty = copies.where("n = 0").select(F.lit(None).cast("long").alias("bin_id"), none.alias("capacity"), none.alias("used"), none.alias("offset"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("length"))
    return packed.unionByName(empty)
