"""Counts, degrees, frequencies and sizes over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import storage
from ..plans.graph import KEYS, Graph


def table_counts(graph: Graph) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in graph.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_index_time(graph: Graph) -> DataFrame:
    return graph.documents.agg(F.max("indexed_at").alias("indexed_at"))


def owners(graph: Graph) -> DataFrame:
    """node_id, document_id of documents, sections and chunks."""
    return (
        graph.documents.select(F.col("id").alias("node_id"), F.col("id").alias("document_id"))
        .unionByName(graph.sections.select(F.col("id").alias("node_id"), "document_id"))
        .unionByName(graph.chunks.select(F.col("id").alias("node_id"), "document_id"))
    )


def undirected(edges: DataFrame) -> DataFrame:
    """node_id, other_id and the edge, once for each end; a loop comes once."""
    ahead = edges.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("other_id"), "*", F.lit(True).alias("forward"))
    back = edges.where("from_id <> to_id").select(F.col("to_id").alias("node_id"), F.col("from_id").alias("other_id"), "*", F.lit(False).alias("forward"))
    return ahead.unionByName(back)


def document_frequency(edges: DataFrame, node_owner: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """id, documents: distinct documents tied to each node by an edge that isn't containment, in either direction."""
    ends = undirected(edges.where("kind <> 'CONTAINS'")).select(F.col("node_id").alias("id"), F.col("other_id").alias("node_id"))
    if entities is not None:
        ends = ends.join(entities.select("id"), "id", "left_semi")
    pairs = ends.join(node_owner, "node_id").select("id", "document_id").distinct()
    return pairs.groupBy("id").agg(F.count("*").alias("documents"))


def edge_kind_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight"), F.avg("confidence").alias("avg_confidence")).orderBy(F.col("n").desc(), "kind")


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, degree over both endpoints of edges that aren't containment."""
    rows = edges.where("kind <> 'CONTAINS'")
    ends = rows.select(F.col("from_id").alias("node_id")).unionAll(rows.select(F.col("to_id").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.col("degree").desc(), "node_id").limit(limit)


def node_labels(graph: Graph) -> DataFrame:
    """id, kind, label of every node."""
    return (
        graph.documents.select("id", F.lit("document").alias("kind"), F.col("title").alias("label"))
        .unionByName(graph.sections.select("id", F.lit("section").alias("kind"), F.col("heading").alias("label")))
        .unionByName(graph.entities.select("id", F.lit("entity").alias("kind"), F.col("name").alias("label")))
        .unionByName(graph.source_refs.select("id", F.lit("source_ref").alias("kind"), F.col("path").alias("label")))
        .unionByName(graph.chunks.select("id", F.lit("chunk").alias("kind"), F.col("metadata.heading").alias("label")))
    )


def link_stats(edges: DataFrame, node_owner: DataFrame, documents: DataFrame, fan_out: bool = True) -> DataFrame:
    """document_id, links, definitions: edges of each document that aren't containment, and that define.

    node_owner: node_id, document_id and node_type (document, section, chunk). With fan_out the
    counts are those of joining documents, sections, chunks and edges at once: an edge at the
    document counts once for each pair of its sections and chunks, one at k sections or chunks
    k times the number of the other. Without it each edge counts once.
    """
    sizes = node_owner.groupBy("document_id").agg(F.greatest(F.lit(1), F.count(F.when(F.col("node_type") == "section", 1))).alias("s"), F.greatest(F.lit(1), F.count(F.when(F.col("node_type") == "chunk", 1))).alias("c"))
    both = edges.where("kind <> 'CONTAINS'").select("id", "kind", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node_id"))
    met = both.join(node_owner, "node_id").groupBy("document_id", "id", "kind").agg(
        F.max((F.col("node_type") == "document").cast("int")).alias("at_document"), F.count(F.when(F.col("node_type") == "section", 1)).alias("ks"), F.count(F.when(F.col("node_type") == "chunk", 1)).alias("kc")
    )
    joined = met.join(sizes, "document_id")
    either = F.col("ks") * F.col("c") + F.col("kc") * F.col("s") - F.col("ks") * F.col("kc")
    times = F.when(F.col("at_document") == 1, F.col("s") * F.col("c")).otherwise(either) if fan_out else F.lit(1)
    counted = joined.withColumn("times", times.cast("long")).groupBy("document_id").agg(F.sum("times").alias("links"), F.sum(F.when(F.col("kind") == "DEFINES", F.col("times")).otherwise(0)).alias("definitions"))
    return documents.select(F.col("id").alias("document_id")).join(counted, "document_id", "left").select("document_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("definitions", F.lit(0)).cast("long").alias("definitions"))


def typed_owners(graph: Graph) -> DataFrame:
    return (
        graph.documents.select(F.col("id").alias("node_id"), F.col("id").alias("document_id"), F.lit("document").alias("node_type"))
        .unionByName(graph.sections.select(F.col("id").alias("node_id"), "document_id", F.lit("section").alias("node_type")))
        .unionByName(graph.chunks.select(F.col("id").alias("node_id"), "document_id", F.lit("chunk").alias("node_type")))
    )


def definition_collisions(edges: DataFrame, node_owner: DataFrame, active: DataFrame) -> DataFrame:
    """id, documents, paths of entities that more than one active document defines. active: document_id, path."""
    defines = edges.where("kind = 'DEFINES'").select(F.col("from_id").alias("node_id"), F.col("to_id").alias("id"))
    pairs = defines.join(node_owner.select("node_id", "document_id"), "node_id").join(active, "document_id").select("id", "document_id", "path").distinct()
    counted = pairs.groupBy("id").agg(F.count("*").alias("documents"), F.sort_array(F.collect_list("path")).alias("paths"))
    return counted.where("documents > 1")


def top_definitions(definitions: DataFrame, k: int = 3) -> DataFrame:
    """The k best definitions of each entity by weight, path, line and edge id, with their place.

    definitions: entity_id, weight, path, start_line, edge_id.
    """
    best = Window.partitionBy("entity_id").orderBy(F.col("weight").desc(), "path", "start_line", "edge_id")
    return definitions.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def path_groups(chunks: DataFrame) -> DataFrame:
    """path_group, documents, chunks, content_bytes by first path segment. chunks: document_id, path, chunk_id, content."""
    per_document = chunks.groupBy("document_id", "path").agg(F.count_distinct("chunk_id").alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))
    group = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit("."))
    return per_document.groupBy(group.alias("path_group")).agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum(F.octet_length("path") + F.col("chars")).alias("content_bytes"))


def storage_stats(spark: SparkSession, path: str, graph: Graph) -> list[dict]:
    """Rows and bytes of each stored relation; rows come from Parquet footers."""
    return [{"relation": name, "rows": graph.tables()[name].count(), "bytes": storage.size(spark, f"{path}/{name}")} for name in KEYS]


def code_counts(warnings: DataFrame, limit: int = 5) -> DataFrame:
    return warnings.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code").limit(limit)


def label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with the labels of both ends."""
    one = labels.select(F.col("id").alias("from_id"), F.col("label").alias("from_label"))
    two = labels.select(F.col("id").alias("to_id"), F.col("label").alias("to_label"))
    return edges.join(one, "from_id", "left").join(two, "to_id", "left")
