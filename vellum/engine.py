"""The public surface: index a tree of Markdown, keep it current, and ask it things."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, merge
from .functions.text import content_hash
from .operators import context as contexts
from .operators import diff, evaluate, export, health, search, stats, traverse
from .plans import storage
from .plans.graph import Graph, build_graph
from .plans.parsed import parse_documents
from .plans.store import Store, changed_documents, replace_documents
from .sources import files as sources

INDEX_TABLES = ("postings", "lengths", "frequencies")
#: Rows of a listing that answers show; a count of all stands beside each.
SHOWN = 1000


def load_config(path: str | None) -> Config:
    """Defaults with the settings of a JSON file, if there is one."""
    return merge(Config(), sources.read_json(path)) if path and Path(path).exists() else Config()


def init_config(path: str, include: Sequence[str] = ()) -> bool:
    """Write the default settings; False if the file is there already."""
    target = Path(path)
    if target.exists():
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    config = merge(Config(), {"include": list(include)}) if include else Config()
    target.write_text(json.dumps(asdict(config), indent=2) + "\n", "utf-8")
    return True


class Engine:
    """A Markdown root and the place where its graph is stored."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.store = Store(spark, store)

    # Index

    def scan(self) -> DataFrame:
        return sources.scan_markdown(self.spark, self.root, self.config)

    def parse(self, name: str = "parsed", anew: bool = False) -> DataFrame:
        """Current files, parsed and written once, as several plans read them.

        Files that the stored version has read already, by path and hash, aren't parsed again unless anew.
        """
        return self._work(self._parsed(None if anew else self._stored_parsed()), name)

    def _parsed(self, known: DataFrame | None) -> DataFrame:
        files = self.scan().select("path", "text")
        if known is None:
            return parse_documents(files)
        hashed = files.withColumn("hash", content_hash(F.coalesce("text", F.lit(""))))
        changed = hashed.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
        same = known.join(hashed.select("path", "hash"), ["path", "hash"], "left_semi")
        return same.unionByName(parse_documents(changed.select("path", "text")))

    def _stored_parsed(self) -> DataFrame | None:
        meta = self.store.meta()
        at = f"{self.store.path}/{meta['version']}/_parsed" if meta else ""
        return self.spark.read.parquet(at) if meta and storage.exists(self.spark, f"{at}/_SUCCESS") else None

    def index(self, full: bool = False) -> dict[str, Any]:
        """Bring the stored graph up to date; only changed documents are parsed and replaced unless full."""
        parsed = self.parse(anew=full)
        failed = parsed.where("error is not null").select("path", "error")
        skipped = [r.asDict() for r in failed.orderBy("path").limit(SHOWN).collect()]
        skipped_count = len(skipped) if len(skipped) < SHOWN else failed.count()
        new = build_graph(parsed, self.config)
        old = self.store.read()
        mode = "full" if full or old is None or old.documents.isEmpty() else "incremental"
        counts: dict[str, int] = {}
        if mode == "full":
            graph = new
        else:
            changes = changed_documents(old.documents, parsed.where("error is null").select("path", "id", "hash"))
            changes = self._work(changes, "changes")
            counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
            graph = replace_documents(old, new, changes) if counts else None
        kept = None if mode == "full" or graph is None else self._kept_postings(old, changes)
        stored = old if graph is None else self.store.write(graph)
        if graph is not None:
            self._write_search_index(stored, kept, changes if kept is not None else None)
            parsed.write.mode("overwrite").parquet(f"{self.store.path}/{self.store.meta()['version']}/_parsed")
        storage.delete(self.spark, f"{self.store.path}/_work")
        return {"mode": mode, "changes": counts, "skipped": skipped, "skippedCount": skipped_count, **{r.relation: r.n for r in stats.table_counts(stored).collect()}}

    def _work(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.store.path}/_work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _index_path(self) -> str:
        return f"{self.store.path}/{self.store.meta()['version']}/_search"

    def _kept_postings(self, old: Graph, changes: DataFrame) -> DataFrame:
        """Postings of the chunks that no changed or deleted document owns."""
        gone = changes.where("old_id is not null").select(F.col("old_id").alias("document_id"))
        chunks = old.chunks.join(gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
        return self.spark.read.parquet(f"{self._index_path()}/postings").join(chunks, "chunk_id", "left_anti")

    def _write_search_index(self, graph: Graph, kept: DataFrame | None = None, changes: DataFrame | None = None) -> None:
        """Postings are sorted by term, so a prefix reads few row groups. kept: postings of unchanged documents, whose texts aren't read again."""
        built = search.build_search_index(graph)
        rows = built.postings
        if kept is not None:
            came = changes.where("new_id is not null").select(F.col("new_id").alias("document_id"))
            rows = search.postings(graph.chunks.join(came, "document_id", "left_semi")).unionByName(kept)
        rows.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{self._index_path()}/postings")
        written = self.spark.read.parquet(f"{self._index_path()}/postings")
        search.chunk_lengths(graph.chunks, written).write.mode("overwrite").parquet(f"{self._index_path()}/lengths")
        built.frequencies.write.mode("overwrite").parquet(f"{self._index_path()}/frequencies")

    def graph(self) -> Graph:
        graph = self.store.read()
        if graph is None:
            raise FileNotFoundError(f"nothing is indexed at {self.store.path}")
        return graph

    def search_index(self) -> search.SearchIndex:
        graph = self.graph()
        return search.SearchIndex(graph, *(self.spark.read.parquet(f"{self._index_path()}/{name}") for name in INDEX_TABLES))

    def compact(self) -> None:
        """Write the stored version anew in as few files as its size asks for, with its search index."""
        parsed = self._stored_parsed()
        self._write_search_index(self.store.compact())
        if parsed is not None:
            parsed.write.mode("overwrite").parquet(f"{self.store.path}/{self.store.meta()['version']}/_parsed")

    # Questions

    def search(self, query: str, limit: int | None = None, mode: str = "auto") -> DataFrame:
        return search.search(self.search_index(), query, self.config, limit, mode)

    def explain(self, query: str, limit: int | None = None, mode: str = "auto") -> dict[str, Any]:
        return search.explain(self.search_index(), query, self.config, limit, mode)

    def context(self, query: str, **options: Any) -> dict[str, Any]:
        return contexts.build_context(self.search_index(), query, self.config, **options)

    def agent_search(self, query: str, limit: int | None = None, mode: str = "auto") -> DataFrame:
        """Search with a limit that suits the question, unless one is asked for."""
        return self.search(query, limit or search.agent_mode(query, self.graph().documents.count(), self.config)["limit"], mode)

    def agent_context(self, query: str, known_files: Sequence[str] = (), debug: bool = False, max_chars: int | None = None) -> dict[str, Any]:
        """Context with limit, depth and budget that suit the question; an asked budget is kept."""
        auto = search.agent_mode(query, self.graph().documents.count(), self.config, len(known_files), max_chars)
        return self.context(query, limit=auto["limit"], max_depth=auto["max_depth"], max_chars=auto["max_chars"], known_files=known_files, debug=debug) | {"mode": auto}

    def node(self, value: str) -> dict[str, Any]:
        """What a name means, with the edges of an unambiguous node: SHOWN at most are listed, all are counted."""
        graph = self.graph()
        candidates = traverse.resolve_node(graph, value)
        found = [r.asDict() for r in candidates.orderBy("at", "id").limit(SHOWN).collect()]
        if not found:
            return {"status": "not_found", "candidates": [], "edges": []}
        if found[0]["ambiguous"]:
            return {"status": "ambiguous", "candidates": found, "candidateCount": len(found) if len(found) < SHOWN else candidates.count(), "edges": []}
        incident = traverse.incident_edges(graph.edges, found[0]["id"])
        edges = stats.label_edges(incident.limit(SHOWN), stats.node_labels(graph)).orderBy(F.col("weight").desc(), F.col("confidence").desc(), "id").collect()
        return {"status": "found", "node": found[0], "edges": [r.asDict() for r in edges], "edgeCount": len(edges) if len(edges) < SHOWN else incident.count()}

    def node_candidates(self, value: str) -> DataFrame:
        """Everything that a name may mean, however much; node() shows the first of them and their number."""
        return traverse.resolve_node(self.graph(), value)

    def trace(self, start: str, target: str, depth: int = 6) -> dict[str, Any]:
        graph = self.graph()
        ends = [traverse.resolve_node(graph, x).orderBy("at", "id").limit(2).collect() for x in (start, target)]
        for name, rows in zip((start, target), ends, strict=True):
            if not rows:
                return {"found": False, "steps": [], "message": f"Node not found: {name}"}
            if rows[0].ambiguous:
                return {"found": False, "steps": [], "message": f"Node is ambiguous: {name}"}
        if ends[0][0].id == ends[1][0].id:
            return {"found": True, "steps": [], "message": None}
        steps = traverse.trace(graph.edges, ends[0][0].id, ends[1][0].id, depth)
        named = steps.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        labels = {r.id: r.label for r in stats.node_labels(graph).join(named, "id", "left_semi").collect()}
        rows = [r.asDict() | {"from_label": labels.get(r.from_id), "to_label": labels.get(r.to_id)} for r in steps.collect()]
        return {"found": bool(rows), "steps": rows, "message": None if rows else f"No path of at most {depth} edges."}

    # Condition

    def status(self, with_storage: bool = False, with_freshness: bool = False) -> dict[str, Any]:
        graph = self.graph()
        out: dict[str, Any] = {"counts": {r.relation: r.n for r in stats.table_counts(graph).collect()}, "indexedAt": stats.latest_index_time(graph).first().indexed_at, "semantic": self.semantic_status()}
        if with_storage:
            version = f"{self.store.path}/{self.store.meta()['version']}"
            out["storage"] = {
                "objects": stats.storage_stats(self.spark, version, graph),
                "edgeKinds": [r.asDict() for r in stats.edge_kind_stats(graph.edges).collect()],
                "highDegree": [r.asDict() for r in stats.top_degrees(graph.edges).collect()],
            }
        if with_freshness:
            counts, first = diff.freshness(self.scan().select("path", "modified"), graph.documents.select("path", "indexed_at"))
            out["freshness"] = {"counts": {r.reason: r.n for r in counts.collect()}, "first": [r.asDict() for r in first.collect()]}
        return out

    def semantic_status(self) -> dict[str, Any]:
        graph = self.graph()
        stored = [r.asDict() for r in stats_vectors(graph).collect()]
        n = sum(s["n"] for s in stored)
        return {"state": search.semantic_status(self.config, n, graph.chunks.count(), stored), "vectors": n, "models": stored}

    def doctor(self, scope: health.Scope | None = None) -> health.Report:
        graph = self.graph()
        version = f"{self.store.path}/{self.store.meta()['version']}"
        total = storage.size(self.spark, version)
        return health.doctor(self.parse("doctor"), graph, self.config, sources.list_files(self.spark, self.root), scope, total, storage.size(self.spark, f"{version}/_search"))

    def evaluate(self, cases: Sequence[evaluate.Case], limit: int | None = None, mode: str = "auto") -> dict[str, Any]:
        return evaluate.evaluate(self.search_index(), cases, self.config, limit, mode)

    # Exchange

    def export_tables(self, path: str) -> dict[str, Any]:
        """The structural graph as tables of any size with a manifest; verify_tables() reads them back."""
        return export.write_structural(self.graph(), path)

    def verify_tables(self, path: str) -> dict[str, Any]:
        return export.verify_structural(self.spark, path)

    def export(self) -> dict[str, Any]:
        """The structural graph as one value on the driver, for a file that one reader opens; export_tables() has no such bound."""
        return export.export_graph(self.graph(), self.config)

    def site_index(self) -> DataFrame:
        graph = self.graph()
        return export.site_index(graph.documents.select("id", "path", "title", "type", "status", "trust_tier"), stats.owners(graph), graph.edges, stats.node_labels(graph))

    def write_markdown_index(self, path: str) -> None:
        """The Markdown index as text files in order of path, written where the rows are."""
        export.markdown_index(self.site_index(), "").write.mode("overwrite").text(path)

    def markdown_index(self) -> str:
        rows = export.markdown_index(self.site_index(), "").toLocalIterator()
        return "# Index\n\n" + "\n".join(r.value for r in rows)

    def source_bridge(self, artifact: str | None) -> dict[str, Any]:
        refs = self.graph().source_refs
        base = {"provider": "code-artifact", "sourceRefs": refs.count()}
        if not artifact or not Path(artifact).exists():
            return base | {"status": "unsupported", "reason": "no artifact" if not artifact else f"artifact not found: {artifact}", "matched": [], "unmatched": sorted(r.path for r in refs.select("path").collect())}
        try:
            sources.read_json(artifact)
        except ValueError as error:
            return base | {"status": "unsupported", "reason": f"artifact can't be read: {error}", "matched": [], "unmatched": sorted(r.path for r in refs.select("path").collect())}
        rows = export.source_bridge(refs, sources.read_artifact(self.spark, artifact)).orderBy("path").collect()
        return base | {"status": "ready", "matched": [r.asDict(True) for r in rows if r.matched], "unmatched": [r.path for r in rows if not r.matched]}

    def diff(self, revision: str) -> dict[str, DataFrame]:
        """The tracked tree at a revision against the current one."""
        shared = f"{self.store.path}/_work/revision-{uuid.uuid4().hex}"
        with tempfile.TemporaryDirectory() as folder:
            sources.export_revision(self.root, revision, f"{folder}/tree")
            Path(folder, "tree").mkdir(exist_ok=True)
            storage.copy_in(self.spark, f"{folder}/tree", f"{shared}/tree")  # executors read it from the store
        base = Engine(self.spark, f"{shared}/tree", f"{shared}/graph", self.config)
        base.index(full=True)
        moved = sources.renames(self.root, revision)
        renames = self.spark.createDataFrame(moved or [("", "")], "old_path string, path string").where("old_path <> ''")
        found = diff.graph_diff(base.graph(), build_graph(self.parse("head"), self.config), renames)
        out = {name: storage.cut(df) for name, df in found.items()}
        storage.delete(self.spark, f"{self.store.path}/_work")
        return out

    def bundle(self, target: str) -> dict[str, Any]:
        """Copy the current version with a manifest of counts and hashes."""
        graph = self.graph()
        for name, df in graph.tables().items():
            df.write.mode("overwrite").parquet(f"{target}/graph/{name}")
        manifest = self._manifest(graph)
        report = self.report()
        text = export.canonical_json(report)
        storage.write_text(self.spark, f"{target}/report.json", text)
        storage.write_text(self.spark, f"{target}/config.json", export.canonical_json({k: list(v) if isinstance(v, tuple) else v for k, v in vars(self.config).items()}))
        manifest["reportHash"] = export.hashlib.sha256(text.encode()).hexdigest()
        storage.write_text(self.spark, f"{target}/manifest.json", export.canonical_json(manifest))
        return manifest

    def _manifest(self, graph: Graph) -> dict[str, Any]:
        documents = [(r.path, r.hash) for r in graph.documents.select("path", "hash").toLocalIterator()]
        return {"format": "vellum-bundle", "formatVersion": 1, "schemaVersion": 2, "counts": {r.relation: r.n for r in stats.table_counts(graph).collect()}, **export.source_snapshot(self.config, documents)}

    def verify_bundle(self, target: str, against_root: bool = False) -> dict[str, Any]:
        """Recompute what the manifest says, and compare with the current tree if asked to."""
        errors = []
        try:
            manifest = json.loads(storage.read_text(self.spark, f"{target}/manifest.json"))
            graph = Graph(**{name: self.spark.read.parquet(f"{target}/graph/{name}") for name in Graph.__dataclass_fields__})
            report = storage.read_text(self.spark, f"{target}/report.json")
        except Exception as error:  # noqa: BLE001  an unreadable bundle is a finding
            return {"valid": False, "errors": [{"code": "bundle.unreadable", "message": str(error).splitlines()[0]}], "warnings": []}
        if manifest.get("format") != "vellum-bundle" or manifest.get("formatVersion") != 1:
            errors.append({"code": "bundle.format", "message": "unknown bundle format"})
        actual = self._manifest(graph)
        errors += [{"code": f"bundle.{k}", "message": f"{k} differs"} for k in ("counts", "documentsHash", "configHash", "sourceHash") if manifest.get(k) != actual[k]]
        if manifest.get("reportHash") != export.hashlib.sha256(report.encode()).hexdigest():
            errors.append({"code": "bundle.reportHash", "message": "report differs"})
        warnings = []
        if against_root:
            current = self.parse("verify").where("error is null").select("path", "id", "hash")
            if not diff.stale_documents(current, graph.documents.select("path", "id", "hash")).isEmpty():
                warnings.append("The bundle is older than the current files.")
        return {"valid": not errors, "errors": errors, "warnings": warnings}

    def report(self, previous: dict[str, Any] | None = None) -> dict[str, Any]:
        """Counts, health and the most frequent warnings, with the trend against an earlier report."""
        found = self.doctor()
        codes = [r.asDict() for r in stats.code_counts(found.warnings).collect()]
        issues = sum(n for name, n in found.summary.items() if name != "documents")
        out: dict[str, Any] = {"summary": found.summary, "issues": issues, "topWarnings": codes, "stale": found.stale, "semantic": self.semantic_status()["state"], "trend": "unknown"}
        if previous:
            before = previous["issues"]
            out["trend"] = "improved" if issues < before else "worse" if issues > before else "unchanged"
        return out


def stats_vectors(graph: Graph) -> DataFrame:
    from .operators.vectors import vector_stats

    return vector_stats(graph.vectors)
