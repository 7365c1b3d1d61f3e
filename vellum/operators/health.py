"""Health rules of a documentation graph: one DataFrame per rule, one union of warnings."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import normalize_entity, normalize_path, trimmed
from ..plans import storage
from ..plans.graph import Graph, explode_parts, link_references, source_ref_id
from ..plans.resolve import collapse, document_aliases, is_external, resolve, section_anchors, url_reference
from ..sources.files import changed_paths
from . import stats
from .diff import stale_documents
from .risks import risk_lines

#: Thresholds, the kinds that must define something, folders of generated files.
DEFINING_KINDS = ("design", "adr", "api", "runbook", "spec")
GENERATED_GROUPS = ("node_modules", "dist", "build", "coverage", ".next", ".cache", "tmp", "temp", "vendor")
OVERSIZED_BYTES = 100 * 1024 * 1024
LARGE_INDEX_BYTES = 50 * 1024 * 1024
INDEX_SHARE = 0.6
HIGH_DEGREE = 50
TAG = r"^[a-z0-9][a-z0-9._/-]*\z"
SEVERITY_RANK = {"error": 0, "warn": 1, "info": 2}
WARNING_COLUMNS = ("code", "severity", "path", "label", "line", "message", "evidence", "remediation")


def is_local_link(url: Column) -> Column:
    return ~url.rlike(r"(?i)^(?:https?:|mailto:|#)") & url.rlike(r"(?i)(?:\.mdx?|#)")


def status_of(status: Column) -> Column:
    return F.lower(trimmed(F.coalesce(status, F.lit("active"))))


def warning(rows: DataFrame, code: Column | str, severity: Column | str, path: Column | str | None, message: Column, remediation: str, line: Column | None = None, label: Column | None = None, **evidence: Column) -> DataFrame:
    """rows as warnings; evidence goes into a map of strings."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    place = F.lit(None).cast("string") if path is None else F.col(path) if isinstance(path, str) else path
    pairs = [p for name, value in evidence.items() for p in (F.lit(name), value.cast("string"))]
    proof = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(
        as_column(code).alias("code"),
        as_column(severity).alias("severity"),
        place.alias("path"),
        (label if label is not None else F.lit(None)).cast("string").alias("label"),
        (line if line is not None else F.lit(None)).cast("int").alias("line"),
        message.alias("message"),
        proof.alias("evidence"),
        F.lit(remediation).alias("remediation"),
    )


def sort_key() -> Column:
    """The order of report: severity, code, place, line and message as one string, so that line 10 comes before 2."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv)), F.col("severity")).cast("string")
    return F.concat_ws("|", rank, "code", F.coalesce("path", "label", F.lit("")), F.coalesce(F.col("line"), F.lit(0)).cast("string"), "message")


def sort_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.orderBy(sort_key())


def dead_links(parsed: DataFrame, aliases: DataFrame, anchors: DataFrame, parts=None) -> DataFrame:
    """path, line, target, kind of local document links and wiki links that lead nowhere."""
    parts = parts or explode_parts(parsed)
    links = link_references(parts, parsed)
    wanted = links.where((F.col("provenance") == "wikilink") | is_local_link(F.col("shown")))
    gone = resolve(wanted, aliases, anchors).where("node_id is null")
    return gone.select(F.col("from_path").alias("path"), "line", F.col("shown").alias("target"), F.when(F.col("provenance") == "wikilink", "wikilink").otherwise("markdown").alias("kind"))


def lifecycle_references(documents: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """code, path, line, target, target_path, superseded_by of active documents that lean on retired ones.

    documents: id, path, status, retired (has a deprecated_by). links: from_id, target_document,
    line, shown. relations: from_id, target_document, kind (SUPERSEDES, DEPRECATED_BY), resolved.
    """
    status = documents.select("id", "path", status_of(F.col("status")).alias("state"), "retired")
    active = status.where("state = 'active'").select("id", "path")
    by = relations.where("target_document is not null and target_document <> from_id")
    paths = status.select(F.col("id").alias("by_id"), F.col("path").alias("by_path"))
    replaced = by.where("kind = 'DEPRECATED_BY'").select(F.col("from_id").alias("id"), F.col("target_document").alias("by_id"))
    superseding = by.where("kind = 'SUPERSEDES'").join(active.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("target_document").alias("id"), F.col("from_id").alias("by_id"))
    named = replaced.unionByName(superseding).join(paths, "by_id").groupBy("id").agg(F.array_sort(F.collect_set("by_path")).alias("superseded_by"))
    retired = status.where("state = 'superseded' or retired").select("id").unionByName(superseding.select("id")).distinct().withColumn("superseded", F.lit(True))
    targets = status.select(F.col("id").alias("target_document"), F.col("path").alias("target_path"), F.col("state").alias("target_state"))
    uses = links.where("target_document is not null and target_document <> from_id").join(active.select(F.col("id").alias("from_id"), "path"), "from_id").join(targets, "target_document")
    uses = uses.join(retired.withColumnRenamed("id", "target_document"), "target_document", "left").join(named.withColumnRenamed("id", "target_document"), "target_document", "left")
    codes = F.array_compact(F.array(F.when(F.col("target_state") == "deprecated", F.lit("document.deprecated_referenced")), F.when(F.col("superseded"), F.lit("document.superseded_referenced"))))
    rows = uses.withColumn("code", F.explode(codes))
    return rows.select("code", "path", "line", F.col("shown").alias("target"), "target_path", F.when(F.col("code") == "document.superseded_referenced", F.col("superseded_by")).alias("superseded_by"))


def missing_decisions(parsed: DataFrame) -> DataFrame:
    """path of active decision records that relate to nothing."""
    local = F.exists("md_links", lambda x: is_local_link(x["url"]))
    tied = (F.size("front.depends_on") > 0) | (F.size("front.supersedes") > 0) | (F.size("front.deprecated_by") > 0) | local | (F.size("wiki_links") > 0)
    return parsed.where((F.col("front.type") == "adr") & (status_of(F.col("front.status")) == "active") & ~tied).select("path")


def bad_tags(documents: DataFrame, tags: str = "tags") -> DataFrame:
    """path, tag of tags that break the convention."""
    return documents.select("path", F.explode(F.array_distinct(F.col(tags))).alias("tag")).where(~F.col("tag").rlike(TAG))


def backslash_links(links: DataFrame) -> DataFrame:
    """path, line, url of local document links with a backslash."""
    return links.where(is_local_link(F.col("url")) & F.contains(F.col("url"), F.lit("\\"))).select("path", "line", "url")


def missing_sources(source_refs: DataFrame, files: DataFrame, named_by: DataFrame | None = None) -> DataFrame:
    """id, path, expected, documents of source paths that leave the root or don't exist."""
    away = (collapse(F.col("path")).rlike(r"^\.\.(?:/|\z)")) | F.col("path").startswith("/")
    there = files.select(F.col("path").alias("there")).unionByName(files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("there"))).distinct()
    rows = source_refs.withColumn("away", away).withColumn("expected", collapse(F.col("path")))
    found = rows.join(there.select(F.col("there").alias("expected")), "expected", "left_semi").where("not away").select("id")
    gone = rows.join(found, "id", "left_anti").select("id", "path", F.when(F.col("away"), "outside project root").otherwise(F.col("expected")).alias("expected"))
    return gone if named_by is None else gone.join(named_by, "id", "left")


def storage_warnings(path_groups: DataFrame, top_degrees: DataFrame, total_bytes: int, index_bytes: int, vectors: int, chunks: int) -> DataFrame:
    spark = path_groups.sparkSession
    out = warning(path_groups.where(F.col("path_group").isin(*GENERATED_GROUPS)), "storage.generated_path_indexed", "warn", "path_group", F.concat(F.lit("Generated or dependency folder is indexed: "), "path_group"), "Exclude this folder unless its Markdown is written by people.", documents=F.col("documents"), chunks=F.col("chunks"), content_bytes=F.col("content_bytes"))
    out = out.unionByName(warning(top_degrees.where(F.col("degree") >= HIGH_DEGREE), "storage.high_degree_node", "info", None, F.concat(F.lit("High-degree graph node: "), F.coalesce("label", "node_id")), "Scope, rename or ignore this name if it is a broad utility concept.", label=F.coalesce("label", "node_id"), degree=F.col("degree")))
    single = []
    if total_bytes > OVERSIZED_BYTES:
        single.append(("storage.database_oversized", "warn", f"The stored graph is larger than {OVERSIZED_BYTES} bytes.", "Review indexed folders and index anew without generated ones."))
    if index_bytes > LARGE_INDEX_BYTES or (total_bytes and index_bytes > total_bytes * INDEX_SHARE):
        single.append(("storage.fts_shadow_large", "info", "The full-text index takes most of the stored bytes.", "Review unusually large Markdown files if the index keeps growing."))
    if vectors and vectors != chunks:
        single.append(("storage.vector_anomaly", "warn", "The number of vectors differs from the number of chunks.", "Index anew with vectors."))
    if single:
        rows = spark.createDataFrame(single, "code string, severity string, message string, fix string")
        out = out.unionByName(rows.select("code", "severity", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("line"), "message", F.create_map().cast("map<string,string>").alias("evidence"), F.col("fix").alias("remediation")))
    return out


@dataclass(frozen=True)
class Scope:
    """All documents, or changed paths and what is one link away from them."""

    mode: str = "all"
    changed: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()

    @property
    def all(self) -> bool:
        return self.mode == "all"


def git_scope(root: str, since: str | None = None) -> Scope:
    changes = changed_paths(root, since or "HEAD")
    docs = [(s, p) for s, p in changes if p.lower().endswith((".md", ".mdx"))]
    return Scope("since" if since else "changed", tuple(p for s, p in docs if s != "D"), tuple(p for s, p in docs if s == "D"))


def scope_paths(scope: Scope, graph: Graph) -> DataFrame:
    """path of the scope's documents and of those one edge away."""
    spark = graph.edges.sparkSession
    named = spark.createDataFrame([(p,) for p in (*scope.changed, *scope.deleted)], "path string")
    owner = stats.owners(graph)
    ids = graph.documents.join(named, "path", "left_semi").select(F.col("id").alias("document_id"))
    nodes = owner.join(ids, "document_id", "left_semi").select("node_id")
    near = stats.undirected(graph.edges.where("kind <> 'CONTAINS'")).join(nodes, "node_id", "left_semi").select(F.col("other_id").alias("node_id")).distinct()
    around = near.join(owner, "node_id").select("document_id").distinct()
    return named.unionByName(graph.documents.join(around.withColumnRenamed("document_id", "id"), "id", "left_semi").select("path")).distinct()


@dataclass
class Report:
    """summary counts, rule tables, all warnings in order, and whether rules were skipped for a stale index."""

    summary: dict[str, int]
    warnings: DataFrame
    rules: dict[str, DataFrame] = field(default_factory=dict)
    stale: bool = False
    health: dict[str, Any] = field(default_factory=dict)


#: Rules that the summary counts, by their name in it.
SUMMARY = ("orphan_documents", "dead_links", "missing_sources", "missing_definitions", "weakly_linked", "contradictions", "content_risks")


def doctor(parsed: DataFrame, graph: Graph, config: Config, files: DataFrame, scope: Scope | None = None, total_bytes: int = 0, index_bytes: int = 0) -> Report:
    """Every rule over current files (parsed) and the stored graph.

    A stale index ends the run with its own warnings, as the other rules would mislead. files:
    path of everything under the root.
    """
    scope = scope or Scope()
    good = parsed.where("error is null")
    paths = None if scope.all else scope_paths(scope, graph)
    scoped = lambda df, column="path": df if paths is None else df.join(paths.select(F.col("path").alias(column)), column, "left_semi")
    failures = warning(scoped(parsed.where("error is not null").select("path", "error")), "document.parse_failed", "error", "path", F.concat(F.lit("Markdown document could not be parsed: "), "path"), "Reduce extreme nesting or size, then index again.", reason=F.col("error"))
    stale = scoped(stale_documents(good.select("path", "id", "hash"), graph.documents.select("path", "id", "hash"), parsed.select("path")))
    stale_rows = warning(stale, "index.stale", "error", "path", F.concat(F.lit("Indexed document is "), "reason", F.lit(": "), "path"), "Index again before relying on health conclusions.", reason=F.col("reason"), indexed_hash=F.col("indexed_hash"), current_hash=F.col("current_hash"))
    n_stale = stale.count()
    deleted = _deleted(graph.edges.sparkSession, scope)
    if n_stale:
        all_rows = stale_rows.unionByName(failures) if deleted is None else stale_rows.unionByName(failures).unionByName(deleted)
        return Report({"documents": scoped(good.select("path")).count(), "stale_index": n_stale} | dict.fromkeys(SUMMARY, 0), sort_warnings(all_rows), {"stale": stale}, stale=True)

    parts = explode_parts(good)
    aliases = document_aliases(good.select("id", "path", "title", F.col("front.id").alias("front_id")))
    anchors = section_anchors(parts.sections)
    linked = storage.cut(scoped(stats.link_stats(graph.edges, stats.typed_owners(graph), graph.documents).join(graph.documents.select(F.col("id").alias("document_id"), "path", "title", "type"), "document_id")))
    stops = [s.strip().removeprefix("`").removesuffix("`").lower() for s in config.stop_entities]
    active = graph.documents.where(status_of(F.col("status")) == "active").select(F.col("id").alias("document_id"), "path")
    collisions = stats.definition_collisions(graph.edges, stats.owners(graph), active).join(graph.entities.select("id", "name"), "id").where(~normalize_entity(F.col("name")).isin(stops))
    if paths is not None:
        touched = collisions.select("id", F.explode("paths").alias("path")).join(paths, "path", "left_semi").select("id").distinct()
        collisions = collisions.join(touched, "id", "left_semi")

    fronted = good.select(F.col("id").alias("from_id"), F.col("path").alias("from_path"), "front")
    relations = None
    for name, kind in (("supersedes", "SUPERSEDES"), ("deprecated_by", "DEPRECATED_BY")):
        rows = fronted.select("from_id", "from_path", F.explode(f"front.{name}").alias("reference"), F.lit(None).cast("string").alias("anchor"), F.lit(kind).alias("kind"))
        relations = rows if relations is None else relations.unionByName(rows)
    resolved_links = resolve(link_references(parts, good), aliases, anchors).where("node_id is not null")
    related = resolve(relations, aliases, anchors).where("node_id is not null")
    states = good.select("id", "path", F.col("front.status").alias("status"), (F.size("front.deprecated_by") > 0).alias("retired"))
    lifecycle = lifecycle_references(states, resolved_links.select("from_id", "target_document", "line", "shown"), related.select("from_id", "target_document", "kind"))
    if paths is not None:
        ours, theirs = (paths.select(F.col("path").alias(c), F.lit(True).alias(f"{c}_inside")) for c in ("path", "target_path"))
        lifecycle = lifecycle.join(ours, "path", "left").join(theirs, "target_path", "left").where("path_inside or target_path_inside").drop("path_inside", "target_path_inside")

    refs = good.select("path", F.explode(F.concat("front.implements", "front.source_refs")).alias("raw")).select("path", source_ref_id(F.lower(normalize_path(trimmed(F.col("raw"))))).alias("id"))
    named_by = refs.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("documents"))
    missing = missing_sources(graph.source_refs.select("id", "path"), files, named_by)
    if paths is not None:
        missing = missing.join(refs.join(paths, "path", "left_semi").select("id").distinct(), "id", "left_semi")

    rules = {
        "orphan_documents": linked.where("links = 0"),
        "weakly_linked": linked.where("links = 1"),
        "missing_definitions": linked.where(F.col("type").isin(*DEFINING_KINDS) & (F.col("definitions") == 0)),
        "dead_links": scoped(dead_links(good, aliases, anchors, parts)),
        "missing_sources": missing,
        "contradictions": collisions,
        "content_risks": scoped(risk_lines(good, "path", "body")),
        "front_matter": scoped(good.select("path", F.explode("diagnostics").alias("d")).select("path", "d.*")),
        "tags": scoped(bad_tags(good.select("path", F.col("front.tags").alias("tags")))),
        "backslash_links": scoped(backslash_links(parts.md_links)),
        "lifecycle": lifecycle,
        "missing_decisions": scoped(missing_decisions(good)),
    }
    # A rule's findings are counted, reported and listed: each is computed once.
    rules = {name: storage.cut(df) for name, df in rules.items()}
    lifecycle = rules["lifecycle"]
    text = F.lit
    warnings = [
        failures,
        warning(rules["orphan_documents"], "document.orphan", "info", "path", F.concat(text("Document has no graph edges besides containment: "), "path"), "Link this document from related ones, or add relationships to its front matter."),
        warning(rules["weakly_linked"], "document.weakly_linked", "info", "path", F.concat(text("Document has few graph edges besides containment: "), "path"), "Add links, source refs or front matter relationships.", edges=F.col("links")),
        warning(rules["missing_definitions"], "definition.missing", "warn", "path", F.concat(text("Document has no definition edges: "), "path"), "Add a defines entry or a heading that names what is defined, or change the type.", type=F.col("type")),
        warning(rules["dead_links"], "link.dead", "error", "path", F.concat(text("Dead "), "kind", text(" link in "), "path"), "Update the target or create the document.", line=F.col("line"), target=F.col("target"), kind=F.col("kind")),
        warning(rules["missing_sources"], "source_ref.missing", "error", "path", F.concat(text("Source path does not exist: "), "path"), "Create the path, or update the front matter that names it.", expected=F.col("expected")),
        warning(rules["contradictions"], "definition.duplicate", "warn", None, F.concat(text("Several active documents define "), "name"), "Keep one definition, or scope the names.", label=F.col("name"), paths=F.concat_ws(", ", "paths")),
        warning(rules["content_risks"], "content.risk", "warn", "path", F.concat(text("Potentially risky content in "), "path"), "Review the line; remove or isolate injection text, active markup, data URIs and hidden characters.", line=F.col("line"), reason=F.col("reason")),
        warning(rules["front_matter"], F.col("code"), "warn", "path", F.concat(text("Front matter of "), "path", text(": "), "message"), "Fix the YAML front matter.", line=F.col("line"), field=F.col("field"), expected=F.col("expected"), actual=F.col("actual")),
        warning(rules["tags"], "tag.invalid_format", "warn", "path", F.concat(text("Tag breaks the naming convention in "), "path", text(": "), "tag"), "Use lower-case letters, digits and . _ / - in tags.", tag=F.col("tag")),
        warning(rules["backslash_links"], "link.non_posix_path", "warn", "path", F.concat(text("Link with a backslash in "), "path"), "Use forward slashes in links.", line=F.col("line"), target=F.col("url")),
        warning(lifecycle, F.col("code"), "warn", "path", F.concat(text("Active document "), "path", text(" references "), "target_path", F.when(F.size(F.coalesce("superseded_by", F.array().cast("array<string>"))) > 0, F.concat(text(". Superseded by: "), F.concat_ws(", ", "superseded_by"), text("."))).otherwise(".")), "Link to the active replacement.", line=F.col("line"), target=F.col("target"), target_path=F.col("target_path")),
        warning(rules["missing_decisions"], "graph.missing_decision_link", "info", "path", F.concat(text("Decision document relates to nothing: "), "path"), "Add depends_on, supersedes, deprecated_by or a link."),
    ]
    if deleted is not None:
        warnings.append(deleted)
    degrees = stats.top_degrees(graph.edges).join(stats.node_labels(graph).select(F.col("id").alias("node_id"), F.col("kind").alias("node_kind"), "label"), "node_id", "left")
    texts = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id", "content").join(graph.documents.select(F.col("id").alias("document_id"), "path"), "document_id", "right")
    if scope.all:
        warnings.append(storage_warnings(stats.path_groups(texts), degrees, total_bytes, index_bytes, graph.vectors.count(), graph.chunks.count()))
    union = warnings[0]
    for more in warnings[1:]:
        union = union.unionByName(more)
    summary = {"documents": linked.count(), "stale_index": 0} | {name: rules[name].count() for name in SUMMARY}
    best = linked.orderBy(F.col("links").desc(), "path").limit(10)
    return Report(summary, sort_warnings(union), rules, False, {"most_connected": best, "top_degrees": degrees})


def _deleted(spark: SparkSession, scope: Scope) -> DataFrame | None:
    if not scope.deleted:
        return None
    rows = spark.createDataFrame([(p,) for p in scope.deleted], "path string")
    return warning(rows, "document.deleted", "info", "path", F.concat(F.lit("Document was deleted: "), "path"), "Index again, and check documents that linked to it.")


def fails(report: Report, strict: bool = False, fail_on: str | None = None) -> bool:
    """Whether a run should end with an error: any counted issue, or a warning at least as severe as fail_on."""
    if strict and any(n for name, n in report.summary.items() if name != "documents"):
        return True
    if fail_on:
        bad = [s for s, rank in SEVERITY_RANK.items() if rank <= SEVERITY_RANK[fail_on]]
        return bool(report.warnings.where(F.col("severity").isin(bad)).limit(1).collect())
    return False


__all__ = ["Report", "Scope", "doctor", "fails", "git_scope", "url_reference", "is_external"]
