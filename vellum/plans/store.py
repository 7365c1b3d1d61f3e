"""The graph at rest: Parquet versions, a pointer to the current one, and incremental replacement.

A run writes a whole new version directory and then moves the pointer, so readers see either
state and a failed run leaves the old one. Rows of unchanged documents are carried over by
anti-joins on the ids that changed documents own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .graph import KEYS, Graph

SCHEMA_VERSION = 2
FILE_BYTES = 128 << 20


def _vectors_from_json(name: str, df: DataFrame) -> DataFrame:
    """Schema 1 held a vector as a JSON array."""
    return df.withColumn("vector", F.from_json("vector", "array<float>")) if name == "vectors" else df


#: What a relation of one schema needs to be read as the next.
MIGRATIONS = {1: _vectors_from_json}


class VersionError(RuntimeError):
    """The stored graph was written by a newer engine."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def meta(self) -> dict | None:
        """The pointer: schema version and the current version's directory; None if nothing is stored."""
        at = f"{self.path}/_current.json"
        storage.recover(self.spark, at)
        if not storage.exists(self.spark, at):
            return None
        meta = json.loads(storage.read_text(self.spark, at))
        if meta["schema_version"] > SCHEMA_VERSION:
            raise VersionError(f"stored schema version {meta['schema_version']} is newer than {SCHEMA_VERSION}")
        return meta

    def read(self) -> Graph | None:
        """The current graph, in the present schema whatever version it was written in."""
        meta = self.meta()
        if meta is None:
            return None
        graph = Graph(**{name: self.spark.read.parquet(f"{self.path}/{meta['version']}/{name}") for name in KEYS})
        for version in range(meta["schema_version"], SCHEMA_VERSION):
            graph = graph.map(MIGRATIONS[version])
        return graph

    def compact(self) -> Graph:
        """The current graph as a new version, in files of about FILE_BYTES."""
        graph, at = self.read(), f"{self.path}/{self.meta()['version']}"
        files = {name: max(1, -(-storage.size(self.spark, f"{at}/{name}") // FILE_BYTES)) for name in KEYS}
        return self.write(graph, files)

    def write(self, graph: Graph, files: dict[str, int] | None = None) -> Graph:
        """Store a graph as the next version and make it current; older versions but the last go. files: how many each relation gets."""
        meta = self.meta()
        version = f"v{int(meta['version'][1:]) + 1 if meta else 1:06d}"
        for name, df in graph.tables().items():
            out = (df.coalesce(files[name]) if files else df).write.mode("overwrite")
            (out.partitionBy("kind") if name == "edges" else out).parquet(f"{self.path}/{version}/{name}")
        storage.write_text(self.spark, f"{self.path}/_current.json", json.dumps({"schema_version": SCHEMA_VERSION, "version": version}))
        for old in storage.children(self.spark, self.path):
            if old.startswith("v") and old not in (version, meta and meta["version"]):
                storage.delete(self.spark, f"{self.path}/{old}")
        return self.read()


def changed_documents(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, old_id, new_id, change of each path that differs: added, modified, id_changed or deleted."""
    old = stored.select("path", F.col("id").alias("old_id"), F.col("hash").alias("old_hash"))
    new = current.select("path", F.col("id").alias("new_id"), F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "deleted").when(F.col("old_id") != F.col("new_id"), "id_changed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return old.join(new, "path", "full_outer").withColumn("change", change).where("change is not null").select("path", "old_id", "new_id", "change")


def owned_ids(graph: Graph, documents: DataFrame) -> DataFrame:
    """node_id of the given documents (id), their sections and their chunks."""
    sections = graph.sections.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("node_id"))
    chunks = graph.chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("node_id"))
    return documents.select(F.col("id").alias("node_id")).unionByName(sections).unionByName(chunks).distinct()


def touching(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Edges with an endpoint among nodes (left_semi), or with none (left_anti): one equi-join per endpoint."""
    one, two = nodes.select(F.col("node_id").alias("from_id")), nodes.select(F.col("node_id").alias("to_id"))
    if how == "left_anti":
        return edges.join(one, "from_id", "left_anti").join(two, "to_id", "left_anti")
    return edges.join(one, "from_id", "left_semi").unionByName(edges.join(two, "to_id", "left_semi").join(one, "from_id", "left_anti"))


def keep_one(old: DataFrame, new: DataFrame, keys: list[str], newest: bool) -> DataFrame:
    """Union by key: the new row wins (replace) or the old one does (ignore)."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    order = F.col("__age").desc() if newest else F.col("__age").asc()
    return both.withColumn("__turn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__turn = 1").drop("__turn", "__age")


def prune(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) that some edge touches."""
    ends = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi")


def insert_strict(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union; raises if a key would be stored twice."""
    clash = old.join(new.select(key), key, "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"{key} {clash[0][key]} is already stored")
    return old.unionByName(new)


def replace_documents(old: Graph, new: Graph, changes: DataFrame) -> Graph:
    """old with the rows of changed documents taken from new.

    Everything that changed and deleted documents own goes, with every edge that touches it.
    Then their new rows come in: entities and source refs keep their first spelling, edges take
    the latest values, and what no edge touches any more is pruned.
    """
    gone = changes.where("old_id is not null").select(F.col("old_id").alias("id"))
    came = changes.where("new_id is not null").select(F.col("new_id").alias("id"))
    of_gone, of_came = gone.withColumnRenamed("id", "document_id"), came.withColumnRenamed("id", "document_id")
    fresh_nodes = owned_ids(new, came)
    fresh_edges = touching(new.edges, fresh_nodes, "left_semi")
    edges = keep_one(touching(old.edges, owned_ids(old, gone), "left_anti"), fresh_edges, ["from_id", "to_id", "kind", "provenance"], newest=True)
    ends = fresh_edges.select(F.col("from_id").alias("id")).unionByName(fresh_edges.select(F.col("to_id").alias("id"))).distinct()
    fresh_chunks = new.chunks.join(of_came, "document_id", "left_semi")
    gone_chunks = old.chunks.join(of_gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return Graph(
        documents=old.documents.join(gone, "id", "left_anti").unionByName(new.documents.join(came, "id", "left_semi")),
        sections=old.sections.join(of_gone, "document_id", "left_anti").unionByName(new.sections.join(of_came, "document_id", "left_semi")),
        entities=prune(keep_one(old.entities, new.entities.join(ends, "id", "left_semi"), ["normalized_name", "kind"], newest=False), edges),
        source_refs=prune(keep_one(old.source_refs, new.source_refs.join(ends, "id", "left_semi"), ["normalized_path"], newest=False), edges),
        edges=edges,
        chunks=old.chunks.join(of_gone, "document_id", "left_anti").unionByName(fresh_chunks),
        vectors=old.vectors.join(gone_chunks, "chunk_id", "left_anti").unionByName(new.vectors.join(fresh_chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")),
    )
