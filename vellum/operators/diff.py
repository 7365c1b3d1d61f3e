"""Differences between two states of a graph, and freshness of a stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph


def stale_documents(current: DataFrame, stored: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """path, reason of documents that the index doesn't match: added, id_changed, modified, deleted.

    current and stored: path, id, hash. paths: every scanned path, so that a file which can't be
    parsed doesn't count as deleted.
    """
    now = current.select("path", F.col("id").alias("current_id"), F.col("hash").alias("current_hash"))
    was = stored.select("path", F.col("id").alias("indexed_id"), F.col("hash").alias("indexed_hash"))
    both = now.join(was, "path", "full_outer")
    if paths is not None:
        both = both.join(paths.select("path").distinct().withColumn("seen", F.lit(True)), "path", "left")
    gone = F.col("current_id").isNull() if paths is None else F.col("current_id").isNull() & F.col("seen").isNull()
    reason = F.when(F.col("indexed_id").isNull(), "added").when(gone, "deleted").when(F.col("current_id").isNull(), F.lit(None)).when(F.col("indexed_id") != F.col("current_id"), "id_changed").when(F.col("indexed_hash") != F.col("current_hash"), "modified")
    return both.withColumn("reason", reason).where("reason is not null").select("path", "reason", "indexed_id", "current_id", "indexed_hash", "current_hash")


def freshness(files: DataFrame, documents: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts by reason, and the first `limit` paths: added or deleted by path, modified by time."""
    now = files.select("path", "modified")
    was = documents.select("path", "indexed_at")
    late = F.col("modified") > F.col("indexed_at") + F.expr("interval 1 millisecond")
    reason = F.when(F.col("indexed_at").isNull(), "added").when(F.col("modified").isNull(), "deleted").when(late, "modified")
    rows = now.join(was, "path", "full_outer").withColumn("reason", reason).where("reason is not null").select("path", "reason")
    return rows.groupBy("reason").agg(F.count("*").alias("n")), rows.orderBy("path").limit(limit)


def document_changes(base: DataFrame, head: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """path, old_path, change: renamed first, then added, modified (hash, status or type) and deleted.

    base and head: path, hash, status, type. renames: old_path, path.
    """
    left = base.select(F.col("path").alias("old_path"), F.col("hash").alias("old_hash"), F.col("status").alias("old_status"), F.col("type").alias("old_type"))
    right = head.select("path", "hash", "status", "type")
    moved = None
    if renames is not None:
        moved = renames.join(left, "old_path").join(right, "path").select("path", "old_path", F.lit("renamed").alias("change"))
        left = left.join(moved.select("old_path"), "old_path", "left_anti")
        right = right.join(moved.select("path"), "path", "left_anti")
    differs = ~(F.col("old_hash").eqNullSafe(F.col("hash")) & F.col("old_status").eqNullSafe(F.col("status")) & F.col("old_type").eqNullSafe(F.col("type")))
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("path").isNull(), "deleted").when(differs, "modified")
    rows = left.join(right, F.col("old_path") == F.col("path"), "full_outer").withColumn("change", change).where("change is not null")
    rows = rows.select(F.coalesce("path", "old_path").alias("path"), F.lit(None).cast("string").alias("old_path"), "change")
    return rows if moved is None else moved.unionByName(rows)


def snapshot(graph: Graph) -> DataFrame:
    """path, hash, status, type, sections, source_refs (REFERENCES_SOURCE only) of each document."""
    sections = graph.sections.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("sections"))
    refs = graph.edges.where("kind = 'REFERENCES_SOURCE'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("source_refs"))
    zero = F.lit(0).cast("long")
    return graph.documents.join(sections, "id", "left").join(refs, "id", "left").select("path", "hash", "status", "type", F.coalesce("sections", zero).alias("sections"), F.coalesce("source_refs", zero).alias("source_refs"))


def count_deltas(base: DataFrame, head: DataFrame, key: str, value: str = "n") -> DataFrame:
    """key, before, after, delta where the counts differ."""
    before = base.select(key, F.col(value).alias("before"))
    rows = before.join(head.select(key, F.col(value).alias("after")), key, "full_outer").na.fill(0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def symmetric_difference(base: DataFrame, head: DataFrame, column: str) -> DataFrame:
    """column, side of values that only one of two tables has."""
    left, right = base.select(column).distinct(), head.select(column).distinct()
    return left.join(right, column, "left_anti").withColumn("side", F.lit("removed")).unionByName(right.join(left, column, "left_anti").withColumn("side", F.lit("added")))


def _top_codes(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code").agg(F.count("*").alias("n"))


def graph_diff(base: Graph, head: Graph, renames: DataFrame | None = None, base_warnings: DataFrame | None = None, head_warnings: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents (with section and source-ref deltas), source_refs, warnings and affected paths."""
    one, two = snapshot(base), snapshot(head)
    changes = document_changes(one, two, renames)
    before = one.select(F.col("path").alias("was"), F.col("sections").alias("s0"), F.col("source_refs").alias("r0"))
    after = two.select("path", F.col("sections").alias("s1"), F.col("source_refs").alias("r1"))
    old: Column = F.coalesce("old_path", "path")
    detailed = changes.join(before, old == F.col("was"), "left").join(after, "path", "left").na.fill(0, ["s0", "s1", "r0", "r1"])
    detailed = detailed.select("path", "old_path", "change", (F.col("s1") - F.col("s0")).alias("section_delta"), (F.col("r1") - F.col("r0")).alias("source_ref_delta"))
    out = {"documents": detailed, "source_refs": symmetric_difference(base.source_refs, head.source_refs, "path")}
    if base_warnings is not None and head_warnings is not None:
        out["warnings"] = count_deltas(_top_codes(base_warnings), _top_codes(head_warnings), "code")
        codes0 = base_warnings.where("path is not null").groupBy("path").agg(F.array_sort(F.collect_set("code")).alias("c0"))
        codes1 = head_warnings.where("path is not null").groupBy("path").agg(F.array_sort(F.collect_set("code")).alias("c1"))
        moved = codes0.join(codes1, "path", "full_outer").where(~F.col("c0").eqNullSafe(F.col("c1"))).select("path")
        out["affected"] = detailed.select("path").unionByName(detailed.where("old_path is not null").select(F.col("old_path").alias("path"))).unionByName(moved).distinct()
    return out


def diff_summary(changes: dict[str, int], warnings: int) -> str:
    """One line for a pull request."""
    parts = [f"{n} {name}" for name, n in sorted(changes.items()) if n]
    text = ", ".join(parts) if parts else "no document changes"
    return f"Documentation graph: {text}; {warnings:+d} warnings." if warnings else f"Documentation graph: {text}."
