"""Node lookup, incident edges, bounded breadth-first paths and k-hop neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path, slugify, trimmed
from ..plans import storage
from ..plans.graph import Graph
from .stats import undirected


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges at a node, best first: weight, confidence, then id."""
    return edges.where((F.col("from_id") == node_id) | (F.col("to_id") == node_id)).orderBy(F.col("weight").desc(), F.col("confidence").desc(), "id")


def resolve_node(graph: Graph, value: str) -> DataFrame:
    """Candidates of the first rule that finds any: id, kind, label, rule, ambiguous, and at, by which they are in order.

    Rules: any node's id; path#anchor, with or without an extension; document path or title;
    source path; section heading or anchor; entity name. Case doesn't count. Only a heading that
    several sections have is ambiguous, and then all of them come back; elsewhere the first
    match by path and line, or by id, is taken.
    """
    docs, sections = graph.documents, graph.sections
    ask = F.lit(value)
    bare = trimmed(ask)
    low = F.lower(bare)

    def rows(df: DataFrame, kind: str, label: str, rule: int, *at: str) -> DataFrame:
        return df.select("id", F.lit(kind).alias("kind"), F.col(label).alias("label"), F.lit(rule).alias("rule"), F.struct(*(F.col(c).cast("string").alias(f"at{k}") for k, c in enumerate((*at, *["id"] * (2 - len(at)))))).alias("at"))

    chunks = graph.chunks.withColumn("label", F.col("id"))
    found = rows(docs.where(F.col("id") == bare), "document", "title", 1)
    for df, kind, label in ((sections, "section", "heading"), (graph.entities, "entity", "name"), (graph.source_refs, "source_ref", "path"), (chunks, "chunk", "label")):
        found = found.unionByName(rows(df.where(F.col("id") == bare), kind, label, 1))
    located = sections.join(docs.select(F.col("id").alias("document_id"), "path"), "document_id").withColumn("line", F.lpad(F.col("start_line").cast("string"), 12, "0"))
    file, hash_, anchor = value.partition("#")
    if hash_ and file.strip() and anchor.strip():
        wanted = F.lower(F.regexp_replace(normalize_path(trimmed(F.lit(file))), r"^\./", ""))
        stem = F.regexp_replace(wanted, r"\.mdx?\z", "")
        paths = F.array(wanted, F.concat(stem, F.lit(".md")), F.concat(stem, F.lit(".mdx")))
        found = found.unionByName(rows(located.where(F.array_contains(paths, F.lower("path")) & (F.lower("anchor") == slugify(F.lit(anchor.strip())))), "section", "heading", 2, "path", "line"))
    found = found.unionByName(rows(docs.where((F.lower("path") == low) | (F.lower("title") == low)), "document", "title", 3, "path"))
    found = found.unionByName(rows(graph.source_refs.where(F.col("normalized_path") == low), "source_ref", "path", 4, "path"))
    found = found.unionByName(rows(located.where((F.lower("heading") == low) | (F.lower("anchor") == slugify(bare))), "section", "heading", 5, "path", "line"))
    found = found.unionByName(rows(graph.entities.where(F.col("normalized_name") == low), "entity", "name", 6, "kind"))
    found = found.where(bare != "")
    per_rule = found.groupBy("rule").agg(F.count("*").alias("n"), F.min(F.struct("at", "id")).alias("first"))
    best = per_rule.agg(F.min(F.struct("rule", "n", "first")).alias("best")).where("best is not null").select("best.*")
    kept = found.join(F.broadcast(best), "rule").withColumn("ambiguous", (F.col("n") > 1) & (F.col("rule") == 5))  # best is one row
    return kept.where(F.col("ambiguous") | (F.struct("at", "id") == F.col("first"))).select("id", "kind", "label", "rule", "ambiguous", "at")


def khop(edges: DataFrame, seeds: DataFrame, depth: int, skip: tuple[str, ...] = ("CONTAINS",), fan_out: int | None = None) -> DataFrame:
    """node_id, depth of all nodes within depth edges of seeds (node_id). fan_out: best edges of a node that are followed.

    Levels are checkpointed, so that none is computed twice; edges are read once a level.
    """
    ends = undirected(edges.where(~F.col("kind").isin(*skip)) if skip else edges)
    if fan_out:
        best = Window.partitionBy("node_id").orderBy((F.col("weight") * F.col("confidence")).desc(), F.col("weight").desc(), F.col("confidence").desc(), "id")
        ends = ends.withColumn("place", F.row_number().over(best)).where(F.col("place") <= fan_out)
    ends = ends.select("node_id", "other_id")
    frontier = reached = storage.cut(seeds.select("node_id").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        step = frontier.join(ends, "node_id").select(F.col("other_id").alias("node_id")).distinct()
        frontier = storage.cut(step.join(reached.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(level)))
        reached = reached.unionByName(frontier)
    return reached


def trace(edges: DataFrame, start: str, target: str, depth: int = 6) -> DataFrame:
    """The shortest undirected path as steps: step, from_id, to_id, edge_id, edge_from, edge_to, kind, direction, confidence, provenance.

    Levels are joined with the edges once each; a new node keeps the parent that was found
    first, then the better edge. A node's place in that order is the list of the edges that led
    to it, so that no level is numbered as a whole. Empty if there is no path of at most depth edges, or if start
    is the target. Levels are checkpointed, so that plans don't grow and none is computed twice.
    """
    spark = edges.sparkSession
    steps_type = "array<struct<weight:double,confidence:double,id:string>>"
    ends = undirected(edges)
    frontier = spark.createDataFrame([(start, None, [], None)], f"node_id string, parent string, place {steps_type}, edge_id string")
    seen = frontier.drop("place")
    for level in range(1, depth + 1):
        if start == target or frontier.isEmpty() or not frontier.where(F.col("node_id") == target).isEmpty():
            break
        step = frontier.select(F.col("node_id").alias("parent"), F.col("place").alias("so_far")).join(ends, F.col("parent") == F.col("node_id")).drop("node_id")
        own = F.struct((-F.col("weight")).cast("double").alias("weight"), (-F.col("confidence")).cast("double").alias("confidence"), F.col("id"))
        best = step.groupBy(F.col("other_id").alias("node_id")).agg(F.min(F.struct(F.concat("so_far", F.array(own)).alias("place"), "parent", F.col("id").alias("edge_id"))).alias("best"))
        new = best.join(seen.select("node_id"), "node_id", "left_anti")
        frontier = storage.cut(new.select("node_id", "best.parent", F.col("best.place").cast(steps_type).alias("place"), "best.edge_id"))
        seen = seen.unionByName(frontier.drop("place"))
    steps = []
    node = target
    for _ in range(depth):
        row = seen.where((F.col("node_id") == node) & F.col("parent").isNotNull()).limit(1).collect() if start != target else []
        if not row:
            break
        steps.append((row[0].parent, node, row[0].edge_id))
        node = row[0].parent
    steps = [(i, *s) for i, s in enumerate(reversed(steps), 1)] if node == start else []
    found = spark.createDataFrame(steps, "step int, from_id string, to_id string, edge_id string")
    details = edges.select(F.col("id").alias("edge_id"), F.col("from_id").alias("edge_from"), F.col("to_id").alias("edge_to"), "kind", "confidence", "provenance")
    direction = F.when(F.col("edge_from") == F.col("from_id"), "forward").otherwise("reverse")
    return F.broadcast(found).join(details, "edge_id").withColumn("direction", direction).select("step", "from_id", "to_id", "edge_id", "edge_from", "edge_to", "kind", "direction", "confidence", "provenance").orderBy("step")
