"""Structural exports, their verification, and indexes for sites and diagrams."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EDGE_WEIGHTS, Config
from ..plans import storage
from ..plans.graph import Graph
from .stats import table_counts

FORMAT, FORMAT_VERSION = "vellum-graph", 1
NODE_SCHEMA = "id string, kind string, label string, details string"
EDGE_SCHEMA = "id string, from_id string, to_id string, kind string, weight double, confidence double, provenance string"
NODE_KINDS = ("document", "section", "entity", "source_ref")


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def source_snapshot(config: Config, documents: list[tuple[str, str]]) -> dict[str, str]:
    """Hashes of the configuration, of all documents' paths and hashes, and of both."""
    one = canonical_hash({k: list(v) if isinstance(v, tuple) else v for k, v in vars(config).items()})
    two = canonical_hash([{"hash": h, "path": p} for p, h in sorted(documents)])
    return {"configHash": one, "documentsHash": two, "sourceHash": canonical_hash({"configHash": one, "documentsHash": two})}


def graph_nodes(graph: Graph) -> DataFrame:
    """id, kind, label, sort_a, sort_b and details (a JSON object) of documents, sections, entities and source refs."""
    paths = graph.documents.select(F.col("id").alias("document_id"), F.col("path").alias("doc_path"))
    documents = graph.documents.select("id", F.lit("document").alias("kind"), F.col("title").alias("label"), F.col("path").alias("sort_a"), F.lit(0).alias("sort_b"), F.lit("").alias("sort_c"), F.to_json(F.struct("path", F.col("type").alias("documentType"), "status", F.col("trust_tier").alias("trustTier"))).alias("details"))
    sections = graph.sections.join(paths, "document_id", "left").select("id", F.lit("section").alias("kind"), F.col("heading").alias("label"), F.coalesce("doc_path", F.lit("")).alias("sort_a"), F.col("start_line").alias("sort_b"), F.lit("").alias("sort_c"), F.to_json(F.struct(F.col("document_id").alias("documentId"), "anchor", "level", F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end")).alias("lines"))).alias("details"))
    entities = graph.entities.select("id", F.lit("entity").alias("kind"), F.col("name").alias("label"), F.col("kind").alias("sort_a"), F.lit(0).alias("sort_b"), F.col("normalized_name").alias("sort_c"), F.to_json(F.struct(F.col("kind").alias("entityKind"), F.col("normalized_name").alias("normalizedName"), "namespace")).alias("details"))
    refs = graph.source_refs.select("id", F.lit("source_ref").alias("kind"), F.col("path").alias("label"), F.col("normalized_path").alias("sort_a"), F.lit(0).alias("sort_b"), F.lit("").alias("sort_c"), F.to_json(F.struct("path", F.col("normalized_path").alias("normalizedPath"))).alias("details"))
    return documents.unionByName(sections).unionByName(entities).unionByName(refs)


def structural_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are exported nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def export_graph(graph: Graph, config: Config | None = None) -> dict[str, Any]:
    """The structural graph as one JSON value, nodes and edges in a fixed order, with its own hash.

    For a file that one reader opens; write_structural() exports tables of any size.
    """
    nodes = graph_nodes(graph)
    rank = F.array_position(F.array(*(F.lit(k) for k in NODE_KINDS)), F.col("kind"))
    listed = [{"id": r.id, "kind": r.kind, "label": r.label, **json.loads(r.details)} for r in nodes.orderBy(rank, "sort_a", "sort_b", "sort_c", "id").toLocalIterator()]
    kept = structural_edges(graph.edges, nodes).orderBy("from_id", "to_id", "kind", "id").select("id", "from_id", "to_id", "kind", "weight", "confidence", "provenance")
    edges = [{"id": r.id, "fromId": r.from_id, "toId": r.to_id, "kind": r.kind, "weight": r.weight, "confidence": r.confidence, "provenance": r.provenance} for r in kept.toLocalIterator()]
    by_kind = {k: sum(n["kind"] == k for n in listed) for k in NODE_KINDS}
    names = {"source_refs": "sourceRefs"}
    value: dict[str, Any] = {
        "format": FORMAT,
        "formatVersion": FORMAT_VERSION,
        "schemaVersion": 2,
        "exportProfile": "structural",
        "sourceHash": source_snapshot(config or Config(), [(r.path, r.hash) for r in graph.documents.select("path", "hash").toLocalIterator()])["sourceHash"],
        "counts": {names.get(r.relation, r.relation): r.n for r in table_counts(graph).collect()},
        "exportedCounts": {"documents": by_kind["document"], "sections": by_kind["section"], "entities": by_kind["entity"], "sourceRefs": by_kind["source_ref"], "nodes": len(listed), "edges": len(edges)},
        "nodes": listed,
        "edges": edges,
    }
    return value | {"graphHash": canonical_hash(value)}


def table_digest(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order and partitions: four sums over the rows' SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return canonical_hash([str(x) for x in df.agg(F.count("*"), *lanes).first()])


def structural_manifest(graph: Graph, nodes: DataFrame, edges: DataFrame) -> dict[str, Any]:
    """What a reader holds written tables against: counts by kind and a digest of each table."""
    kinds = {r.kind: r.n for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    return {"format": FORMAT, "formatVersion": FORMAT_VERSION, "exportProfile": "structural-tables", "counts": {r.relation: r.n for r in table_counts(graph).collect()}, "exportedCounts": kinds | {"edges": edges.count()}, "nodesHash": table_digest(nodes), "edgesHash": table_digest(edges)}


def verify_structural(spark: SparkSession, path: str) -> dict[str, Any]:
    """valid and errors (code, subject, at most 1000 of them; errorCount counts all) of tables that write_structural() wrote."""
    manifest = json.loads(storage.read_text(spark, f"{path}/manifest.json"))
    nodes, edges = spark.read.schema(NODE_SCHEMA).json(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).json(f"{path}/edges")
    found = verify_tables(nodes, edges)
    errors = [{"code": f"graph.{r.code}", "subject": r.subject} for r in found.orderBy("code", "subject").limit(1000).collect()]
    total = len(errors) if len(errors) < 1000 else found.count()
    wrong = [name for name, df in (("nodesHash", nodes), ("edgesHash", edges)) if manifest.get(name) != table_digest(df)]
    errors += [{"code": "graph.graph_hash", "subject": name} for name in wrong]
    return {"valid": not errors, "errors": errors, "errorCount": total + len(wrong)}


def write_structural(graph: Graph, path: str) -> dict[str, Any]:
    """nodes and edges as JSON lines, in the order of export, many files, and a manifest beside them, which is returned."""
    nodes = graph_nodes(graph)
    nodes.repartitionByRange("kind", "sort_a", "sort_b", "sort_c", "id").sortWithinPartitions("kind", "sort_a", "sort_b", "sort_c", "id").select("id", "kind", "label", "details").write.mode("overwrite").json(f"{path}/nodes")
    edges = structural_edges(graph.edges, nodes).select("id", "from_id", "to_id", "kind", "weight", "confidence", "provenance")
    edges.repartitionByRange("from_id", "to_id", "kind", "id").sortWithinPartitions("from_id", "to_id", "kind", "id").write.mode("overwrite").json(f"{path}/edges")
    spark = graph.edges.sparkSession
    manifest = structural_manifest(graph, spark.read.schema(NODE_SCHEMA).json(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).json(f"{path}/edges"))
    storage.write_text(spark, f"{path}/manifest.json", canonical_json(manifest))
    return manifest


def verify_tables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """code, subject of every structural error of node (id, kind) and edge (id, from_id, to_id, kind) tables."""
    shaped = nodes.where("id is not null and kind is not null")
    ids = shaped.select("id").distinct()
    found = [
        nodes.where("id is null or kind is null").select(F.lit("node_shape").alias("code"), F.coalesce("id", F.lit("?")).alias("subject")),
        shaped.where(~F.col("kind").isin(*NODE_KINDS)).select(F.lit("node_kind").alias("code"), F.col("id").alias("subject")),
        shaped.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("node_duplicate").alias("code"), F.col("id").alias("subject")),
    ]
    whole = edges.where("id is not null and from_id is not null and to_id is not null and kind is not null")
    found += [
        edges.where("id is null or from_id is null or to_id is null or kind is null").select(F.lit("edge_shape").alias("code"), F.coalesce("id", F.lit("?")).alias("subject")),
        whole.where(~F.col("kind").isin(*EDGE_WEIGHTS)).select(F.lit("edge_kind").alias("code"), F.col("id").alias("subject")),
        whole.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(F.lit("edge_endpoint").alias("code"), F.col("id").alias("subject")),
        whole.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(F.lit("edge_endpoint").alias("code"), F.col("id").alias("subject")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def verify_export(value: Any) -> dict[str, Any]:
    """valid, errors (code, message, subject) and warnings of an export read from a file."""
    errors: list[dict[str, Any]] = []

    def error(code: str, message: str, subject: Any = None) -> None:
        errors.append({"code": f"graph.{code}", "message": message, "subject": subject})

    if not isinstance(value, dict):
        error("not_object", "An export must be a JSON object.")
        return {"valid": False, "errors": errors, "warnings": []}
    if value.get("format") != FORMAT:
        error("format", f"The format must be {FORMAT}.", value.get("format"))
    if value.get("formatVersion") != FORMAT_VERSION:
        error("format_version", f"The format version must be {FORMAT_VERSION}.", value.get("formatVersion"))
    if not _is_count(value.get("schemaVersion")):
        error("schema_version", "The schema version must be a number.", value.get("schemaVersion"))
    shapes = {"counts": ("documents", "sections", "entities", "sourceRefs", "edges", "chunks", "vectors"), "exportedCounts": ("documents", "sections", "entities", "sourceRefs", "nodes", "edges")}
    for name, code in (("counts", "counts"), ("exportedCounts", "exported_counts")):
        if not isinstance(value.get(name), dict) or not all(_is_count(value[name].get(k)) for k in shapes[name]):
            error(code, f"{name} must hold {', '.join(shapes[name])}.")
    for name in ("nodes", "edges"):
        if not isinstance(value.get(name), list):
            error(name, f"{name} must be an array.")
    nodes = value["nodes"] if isinstance(value.get("nodes"), list) else []
    edges = value["edges"] if isinstance(value.get("edges"), list) else []
    seen: set[str] = set()
    for i, node in enumerate(nodes):
        if not isinstance(node, dict) or not all(isinstance(node.get(k), str) for k in ("id", "kind")):
            error("node_shape", "A node needs an id and a kind.", f"nodes[{i}]")
            continue
        if node["kind"] not in NODE_KINDS:
            error("node_kind", f"Unknown node kind {node['kind']}.", node["id"])
        if node["id"] in seen:
            error("node_duplicate", f"Node id {node['id']} comes twice.", node["id"])
        seen.add(node["id"])
    for i, edge in enumerate(edges):
        if not isinstance(edge, dict) or not all(isinstance(edge.get(k), str) for k in ("id", "fromId", "toId", "kind")):
            error("edge_shape", "An edge needs an id, two ends and a kind.", f"edges[{i}]")
            continue
        if edge["kind"] not in EDGE_WEIGHTS:
            error("edge_kind", f"Unknown edge kind {edge['kind']}.", edge["id"])
        for end in ("fromId", "toId"):
            if edge[end] not in seen:
                error("edge_endpoint", f"{end} {edge[end]} of edge {edge['id']} is missing.", edge["id"])
    exported, counts = value.get("exportedCounts"), value.get("counts")
    if isinstance(exported, dict) and all(_is_count(exported.get(k)) for k in shapes["exportedCounts"]):
        actual = {"nodes": len(nodes), "edges": len(edges)} | {k: sum(isinstance(n, dict) and n.get("kind") == kind for n in nodes) for k, kind in zip(("documents", "sections", "entities", "sourceRefs"), NODE_KINDS, strict=True)}
        for k, n in actual.items():
            if exported[k] != n:
                error("count_mismatch", f"exportedCounts.{k} is {exported[k]}, but there are {n}.", k)
    warnings = []
    if isinstance(counts, dict) and isinstance(exported, dict) and _is_count(counts.get("edges")) and _is_count(exported.get("edges")) and exported["edges"] < counts["edges"]:
        warnings.append("Edges at chunks aren't part of a structural export.")
    rest = {k: v for k, v in value.items() if k != "graphHash"}
    if not isinstance(value.get("graphHash"), str):
        error("graph_hash", "graphHash must be present.")
    elif canonical_hash(rest) != value["graphHash"]:
        error("graph_hash", "graphHash doesn't match the content.", value["graphHash"])
    return {"valid": not errors, "errors": errors, "warnings": warnings}


def _is_count(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def site_index(documents: DataFrame, node_owner: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """path and sorted distinct defines, source_refs, outbound and inbound of every document.

    documents: id, path. node_owner: node_id, document_id. labels: id, kind, label.
    """
    owner = node_owner.select("node_id", "document_id")
    ahead = edges.join(owner.select(F.col("node_id").alias("from_id"), F.col("document_id").alias("from_doc")), "from_id", "left").join(owner.select(F.col("node_id").alias("to_id"), F.col("document_id").alias("to_doc")), "to_id", "left")
    named = ahead.join(labels.select(F.col("id").alias("to_id"), "label"), "to_id", "left")
    defines = named.where("kind = 'DEFINES' and from_doc is not null").select(F.col("from_doc").alias("id"), F.lit("defines").alias("list"), F.col("label").alias("value"))
    refs = named.where("kind in ('IMPLEMENTS', 'REFERENCES_SOURCE') and from_doc is not null").select(F.col("from_doc").alias("id"), F.lit("source_refs").alias("list"), F.col("label").alias("value"))
    across = ahead.where("kind <> 'CONTAINS' and from_doc is not null and to_doc is not null and from_doc <> to_doc").select("from_doc", "to_doc").distinct()
    paths = documents.select(F.col("id").alias("other"), F.col("path").alias("value"))
    outbound = across.select(F.col("from_doc").alias("id"), F.col("to_doc").alias("other")).join(paths, "other").select("id", F.lit("outbound").alias("list"), "value")
    inbound = across.select(F.col("to_doc").alias("id"), F.col("from_doc").alias("other")).join(paths, "other").select("id", F.lit("inbound").alias("list"), "value")
    rows = defines.unionByName(refs).unionByName(outbound).unionByName(inbound)
    lists = rows.groupBy("id").agg(*(F.sort_array(F.collect_set(F.when(F.col("list") == name, F.col("value")))).alias(name) for name in ("defines", "source_refs", "outbound", "inbound")))
    none = F.array().cast("array<string>")
    return documents.join(lists, "id", "left").select(*documents.columns, *(F.coalesce(n, none).alias(n) for n in ("defines", "source_refs", "outbound", "inbound")))


def markdown_index(index: DataFrame, graph_hash: str) -> DataFrame:
    """One row of Markdown per document, in order of path, for a vault of linked notes."""
    shown = lambda c: F.when(F.size(c) == 0, F.lit("none")).otherwise(F.array_join(c, ", "))
    text = F.concat(F.lit("### [["), "path", F.lit("]]\n\n- Defines: "), shown("defines"), F.lit("\n- Source refs: "), shown("source_refs"), F.lit("\n- Outbound links: "), shown("outbound"), F.lit("\n- Inbound links: "), shown("inbound"), F.lit("\n"))
    return index.orderBy("path").select(text.alias("value"))


def mermaid(steps: list[dict[str, Any]], message: str = "No path found.") -> str:
    """A left-to-right diagram of a trace."""
    if not steps:
        return "%% " + re.sub(r"\r?\n", " ", message).replace("--", "- -") + "\nflowchart LR"
    node = lambda x: "n_" + re.sub(r"[^A-Za-z0-9_]", "_", x)
    label = lambda x: re.sub(r"\r?\n", " ", x.replace("\\", "\\\\").replace('"', '\\"'))
    names: dict[str, str] = {}
    for s in steps:
        names[s["from_id"]] = s.get("from_label") or s["from_id"]
        names[s["to_id"]] = s.get("to_label") or s["to_id"]
    lines = ["flowchart LR", *(f'  {node(i)}["{label(n)}"]' for i, n in sorted(names.items()))]
    lines += [f'  {node(s["from_id"])} -- "{label(s["kind"])} / {label(s["provenance"])} / {s["confidence"]:.2f}" --> {node(s["to_id"])}' for s in steps]
    return "\n".join(lines)


def source_bridge(source_refs: DataFrame, files: DataFrame) -> DataFrame:
    """path, artifact_path, symbols, matched: each source path and the artifact file of the same path."""
    tidy = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "")
    named = F.array_sort(F.filter("symbols", lambda s: s["name"].isNotNull()))
    right = files.select(F.lower(tidy).alias("normalized_path"), tidy.alias("artifact_path"), named.alias("symbols")).groupBy("normalized_path").agg(F.max(F.struct("artifact_path", "symbols")).alias("f"))
    return source_refs.select("path", "normalized_path").join(right, "normalized_path", "left").select("path", F.col("f.artifact_path").alias("artifact_path"), F.col("f.symbols").alias("symbols"), F.col("f").isNotNull().alias("matched"))
