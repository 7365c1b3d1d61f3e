"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share by weight of the whole budget, but at most `max_ratio` times its
own size; what a full source leaves is shared again by weight. A document's expected copies are
in proportion to its propensity within its source, but `max_ratio` at most; the scale is solved
so that the source's expected words are its target. Whole copies are certain. What is left of
the expectation is an inclusion probability p: documents are ranked by random odds over
inclusion odds, [u/(1-u)] / [p/(1-p)], and taken in that order until the source's remaining
words are used up. So a sample has a fixed size in words, not in rows.

The order is never sorted as a whole. A histogram of the rank over `COARSE` equal parts finds the
part where a source's target falls, one over `FINE` parts of that finds it closer, and only the
rows of that last part are put in order; each source then has one threshold, and every document
is decided by itself against its source's row.

Bounds: windows over one source see its `COARSE` + 1 or `FINE` histogram rows, its levels of
propensity, or the rows of one last part, about one in `COARSE * FINE` of its documents. Windows
over all sources see one row of each.

Cases: a null or empty text has size 0. The null source is a source of its own, the last one.
Propensities are rounded to eighths of octaves from 2**-8 to 2**8; null counts as 1. Rows equal
in doc_id and text share their random number and so their fate. Null doc_ids take part like
others. A very long text is counted by itself, and is taken if more than half of it fits. Columns
other than those named pass through, whatever their names. An empty table gives an empty
result; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, whole_row
from .tokens import slices, text_bytes, word_spans

#: Parts of a histogram of ranks, and parts of one of them; a rank's bin is its place among all of the latter.
COARSE, FINE = 64, 64
BINS = COARSE * FINE


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = np.diff(word_spans(*text_bytes(part.column("text")))[2])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("thash"), part.column("source"), part.column("propensity"), pa.array(words, pa.int64())], names=["doc_id", "thash", "source", "propensity", "size"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", propensity: Column | None = None) -> DataFrame:
    """doc_id, thash, source, propensity and size in words of every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("thash"),
        F.col(source_col).cast("string").alias("source"),
        _rounded(propensity).alias("propensity"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(_count, "doc_id long, thash long, source string, propensity double, size long")


def _rounded(propensity: Column | None) -> Column:
    """One of a few thousand levels at most, so that a source's are few rows."""
    if propensity is None:
        return F.lit(1.0)
    octaves = F.round(F.log2(propensity.cast("double")) * 8) / 8
    return F.coalesce(F.pow(F.lit(2.0), F.least(F.lit(8.0), F.greatest(F.lit(-8.0), octaves))), F.lit(1.0))


def source_scales(sizes: DataFrame, targets: DataFrame, max_ratio: float) -> DataFrame:
    """place, scale of each source: expected copies are scale * propensity, max_ratio at most, and give the target in words.

    Levels of propensity become full in falling order; with all levels above one full, the
    scale is what is left over what the others weigh.
    """
    levels = sizes.join(targets.select(F.col("source").alias("of"), "place", "target"), sizes.source.eqNullSafe(F.col("of")))
    levels = levels.groupBy("place", "target", "propensity").agg(F.sum("size").alias("words")).where("words > 0")
    down = Window.partitionBy("place").orderBy(F.col("propensity").desc())
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(max_ratio))
    weighs = F.sum(F.col("words") * F.col("propensity")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    solved = levels.withColumn("scale", (F.col("target") - full) / weighs)
    fits = F.when(F.col("scale") * F.col("propensity") <= F.lit(float(max_ratio)) * (1 + 1e-12), F.struct(-F.col("propensity"), "scale"))
    every = F.lit(float(max_ratio)) / F.min("propensity")
    return solved.groupBy("place").agg(F.coalesce(F.min(fits).getField("scale"), every).alias("scale"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_ratio: float) -> DataFrame:
    """source, place, source_size and target: one row per source.

    The windows run over one row per source, not over documents. Sources are filled in the
    order of the level at which they become full; the level of the first that doesn't is the
    level of all that follow.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    found = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(every).cast("long"))
        .withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(max_ratio)))
    )
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = (
        found.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("level", level)
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    )
    common = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(whole).getField("level")
    return leveled.withColumn("common", common).select("source", "place", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _ranked(rows: DataFrame, max_ratio: float, seed: int) -> DataFrame:
    """Adds whole (certain copies), v (the rank, in 0 to 1) and bin."""
    expected = F.least(F.lit(float(max_ratio)), F.coalesce(F.col("scale") * F.col("propensity"), F.lit(0.0)))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "thash", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return (
        rows.withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("u", u)
        .withColumn("v", F.when(F.col("p") > 0, odds / (1 + odds)))
        .withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("v") * BINS)).cast("int"))
    )


def _crossing(histogram: DataFrame) -> DataFrame:
    """place, part, left: where the running words of a source go beyond what rests, and what rests before that part.

    histogram: place, part (null: no rank), words, rest. left stays a quarter of a word below the
    part's words, so that rounding can't lose a crossing in a finer histogram of the part.
    """
    in_order = Window.partitionBy("place").orderBy(F.col("part").asc_nulls_first())
    running = histogram.withColumn("upto", F.sum("words").over(in_order)).where(F.col("part").isNotNull() & (F.col("upto") > F.col("rest")))
    left = F.least(F.col("rest") - F.col("upto") + F.col("words"), F.col("words") - 0.25)
    first = F.min_by(F.struct("part", left.alias("left")), "part")
    return running.groupBy("place").agg(first.alias("cut")).select("place", F.col("cut.part").cast("int").alias("part"), F.col("cut.left").alias("left"))


def mixing_plan(sizes: DataFrame, weights: Sequence[float], share: float, max_ratio: float, seed: int, scratch: Scratch) -> DataFrame:
    """One row per source: its target and the threshold that its documents are held against."""
    shares = scratch.cut(source_targets(sizes, weights, share, max_ratio), "shares")
    targets = scratch.cut(shares.join(source_scales(sizes, shares, max_ratio), "place", "left"), "targets")
    rows = _ranked(sizes.join(targets, sizes.source.eqNullSafe(targets.source)).drop(targets.source), max_ratio, seed)
    drawn = F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)
    bins = rows.groupBy("place", F.floor(F.col("bin") / FINE).alias("part")).agg(F.sum(drawn).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
    rest = F.col("target") - F.sum("certain").over(Window.partitionBy("place"))
    coarse = scratch.cut(_crossing(bins.join(targets.select("place", "target"), "place").withColumn("rest", rest)), "coarse")
    inside = rows.join(coarse.withColumnsRenamed({"part": "near", "left": "rest"}), "place").where(F.floor(F.col("bin") / FINE) == F.col("near"))
    fine = inside.groupBy("place", "rest", F.col("bin").alias("part")).agg(F.sum("size").alias("words"))
    cuts = scratch.cut(_crossing(fine).withColumnRenamed("part", "cut"), "cuts")
    taken_before = F.sum("size").over(Window.partitionBy("place").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    last = (
        rows.join(cuts, "place")
        .where(F.col("bin") == F.col("cut"))
        .select("place", "size", "left", F.struct("v", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "thash").alias("key"))
        .withColumn("taken", F.coalesce(taken_before, F.lit(0)) + F.col("size") / 2 <= F.col("left"))
        .where("taken")
        .groupBy("place")
        .agg(F.max("key").alias("last"))
    )
    return scratch.cut(targets.join(cuts.drop("left"), "place", "left").join(last, "place", "left"), "plan")


def copies(rows: DataFrame, plan: DataFrame, max_ratio: float, seed: int) -> DataFrame:
    """rows (doc_id, thash, source, propensity, ...) with their source's plan and a column copies.

    The plan has a row per source; Spark broadcasts it if it is small enough, and otherwise
    joins by source, splitting a hot one.
    """
    own = plan.withColumnRenamed("source", "__source")
    joined = _ranked(rows.join(own, rows.source.eqNullSafe(F.col("__source")), "left").drop("__source"), max_ratio, seed)
    key = F.struct("v", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "thash")
    extra = F.col("p").__gt__(0) & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & F.coalesce(key <= F.col("last"), F.lit(False))))
    return joined.withColumn("copies", (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float], share: float, max_ratio: float, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", propensity: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, thash, source, size, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.cut(word_counts(docs, id_col, text_col, source_col, propensity), "sizes")
    plan = mixing_plan(sizes, weights, share, max_ratio, seed, scratch)
    return copies(sizes, plan, max_ratio, seed).select("doc_id", "thash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float], share: float, max_ratio: float, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", propensity: Column | None = None) -> DataFrame:
    """docs as the mix takes them: a row is left out, kept, or repeated; columns unchanged.

    Texts aren't shuffled: each row is decided from its own id and its source's plan.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.cut(word_counts(docs, id_col, text_col, source_col, propensity), "sizes")
    plan = mixing_plan(sizes, weights, share, max_ratio, seed, scratch)
    held = docs.select(
        whole_row(docs).alias("__row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("thash"),
        F.col(source_col).cast("string").alias("source"),
        _rounded(propensity).alias("propensity"),
    )
    return copies(held, plan, max_ratio, seed).where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
