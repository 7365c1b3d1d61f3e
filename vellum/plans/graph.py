"""From parsed documents to the seven relations of the graph."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EDGE_WEIGHTS, Config
from ..functions import entities as E
from ..functions.text import normalize_entity, normalize_path, slugify, stable_id, token_estimate, trimmed
from ..operators.vectors import embed_rows
from .resolve import document_aliases, is_external, resolve, section_anchors, url_reference


@dataclass(frozen=True)
class Graph:
    documents: DataFrame
    sections: DataFrame
    entities: DataFrame
    source_refs: DataFrame
    edges: DataFrame
    chunks: DataFrame
    vectors: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def map(self, change) -> Graph:
        return Graph(**{name: change(name, df) for name, df in self.tables().items()})


#: The column that identifies a row of each relation.
KEYS = {"documents": "id", "sections": "id", "entities": "id", "source_refs": "id", "edges": "id", "chunks": "id", "vectors": "chunk_id"}


def edge_weight(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair)), kind)


def with_edge_id(edges: DataFrame) -> DataFrame:
    """Adds id and weight to (from_id, to_id, kind, provenance, confidence)."""
    key = F.concat_ws(":", "from_id", "kind", "to_id", "provenance")
    return edges.withColumn("id", stable_id("edge", key)).withColumn("weight", edge_weight(F.col("kind")))


def dedupe_edges(edges: DataFrame, order: str = "emit_ord") -> DataFrame:
    """One edge per (from, to, kind, provenance): the confidence of the last one emitted."""
    return edges.groupBy("from_id", "to_id", "kind", "provenance").agg(F.max_by("confidence", order).alias("confidence"))


def first_spelling(named: DataFrame, order: str = "emit_ord") -> DataFrame:
    """id, name, normalized_name, kind of each entity: the first spelling wins."""
    rows = named.select(F.col("name"), normalize_entity(F.col("name")).alias("normalized_name"), "kind", F.col(order).alias("__ord"))
    best = rows.groupBy("kind", "normalized_name").agg(F.min_by("name", "__ord").alias("name"))
    return best.select(entity_id(F.col("kind"), F.col("normalized_name")).alias("id"), "name", "normalized_name", "kind")


def entity_id(kind: Column, normalized: Column) -> Column:
    return stable_id("entity", F.concat_ws(":", kind, normalized))


def source_ref_id(normalized: Column) -> Column:
    return stable_id("source_ref", normalized)


def build_sections(parsed: DataFrame) -> DataFrame:
    """id, document_id, anchor, heading, level, lines, content and ord of every section.

    Repeated slugs of a document are numbered in order; a document without headings has one
    root section without an anchor.
    """
    rows = parsed.select(F.col("id").alias("document_id"), F.col("title"), F.coalesce("front.title", "base").alias("fallback"), F.posexplode("sections").alias("ord", "s"))
    rows = rows.select("document_id", "ord", F.col("s.heading").isNull().alias("root"), F.coalesce("s.heading", "fallback").alias("heading"), "s.level", "s.start_line", "s.end_line", "s.content")
    slugged = rows.withColumn("slug", F.when(F.col("root"), F.lit("")).otherwise(slugify(F.col("heading"))))
    turn = F.row_number().over(Window.partitionBy("document_id", "slug").orderBy("ord"))
    anchored = slugged.withColumn("turn", turn).withColumn("anchor", F.when(F.col("root") | (F.col("turn") == 1), F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("turn").cast("string"))))
    key = F.concat_ws(":", "document_id", F.when(F.col("root"), F.lit("root")).otherwise(F.col("anchor")))
    return anchored.withColumn("id", stable_id("section", key)).select("id", "document_id", "anchor", "heading", "level", "start_line", "end_line", "content", "ord")


def place_items(items: DataFrame, sections: DataFrame) -> DataFrame:
    """items (document_id, line, ...) with section_id: the first section that holds the line, else the document's first."""
    spans = sections.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ord", "start_line", "end_line", F.col("id").alias("sid")))).alias("spans"))
    joined = items.join(spans, "document_id", "left")
    holding = F.filter("spans", lambda s: (F.col("line") >= s["start_line"]) & (F.col("line") <= s["end_line"]))
    return joined.withColumn("section_id", F.coalesce(F.get(holding, 0)["sid"], F.get("spans", 0)["sid"])).drop("spans")


def _ord(phase: int, *at: Column) -> Column:
    places = [*at, *[F.lit(0)] * (3 - len(at))]
    return F.struct(F.col("path"), F.lit(phase).alias("phase"), *(p.cast("int").alias(f"at{k}") for k, p in enumerate(places)))


@dataclass(frozen=True)
class Parts:
    """Explodes of the parsed documents that several plans read."""

    sections: DataFrame
    code: DataFrame
    md_links: DataFrame
    wiki_links: DataFrame


def explode_parts(parsed: DataFrame) -> Parts:
    sections = build_sections(parsed)

    def items(name: str) -> DataFrame:
        rows = parsed.select(F.col("id").alias("document_id"), "path", F.posexplode(name).alias("pos", "item")).select("document_id", "path", "pos", "item.*")
        return place_items(rows, sections)

    return Parts(sections, items("code"), items("md_links"), items("wiki_links"))


def emit_entities(parsed: DataFrame, parts: Parts) -> DataFrame:
    """Every name that a document defines or mentions, before any filter, with its place in the order of emission."""
    columns = ["document_id", "section_id", "name", "role", "provenance", "confidence", "emit_ord"]

    def branch(rows: DataFrame, names: Column, role: str, provenance: str, confidence: float, phase: int, *at: str) -> DataFrame:
        exploded = rows.select("*", F.posexplode(names).alias("npos", "name"))
        return exploded.withColumns({"role": F.lit(role), "provenance": F.lit(provenance), "confidence": F.lit(confidence), "emit_ord": _ord(phase, *(F.col(a) for a in at), F.col("npos"))}).select(*columns)

    docs = parsed.select(F.col("id").alias("document_id"), "path", F.lit(None).cast("string").alias("section_id"), F.col("front.defines").alias("defines"))
    in_section = parts.sections.join(parsed.select(F.col("id").alias("document_id"), "path"), "document_id").withColumnRenamed("id", "section_id")
    content, heading = F.col("content"), F.col("heading")
    none = F.array().cast("array<string>")
    per_section = in_section.withColumn(
        "names",
        F.concat(
            F.transform(F.when(E.declares(heading), E.declared_names(content)).otherwise(none), lambda n: F.struct(n.alias("name"), F.lit("definition").alias("role"), F.lit("declared_section").alias("provenance"), F.lit(0.85).alias("confidence"))),
            F.transform(F.when(E.looks_like_entity(heading), F.array(heading)).otherwise(none), lambda n: F.struct(n.alias("name"), F.lit("definition").alias("role"), F.lit("heading").alias("provenance"), F.lit(0.8).alias("confidence"))),
            F.transform(E.high_confidence_names(content), lambda n: F.struct(n.alias("name"), F.lit("reference").alias("role"), F.lit("regex").alias("provenance"), F.lit(0.6).alias("confidence"))),
        ),
    )
    section_rows = per_section.select("document_id", "section_id", "path", "ord", F.posexplode("names").alias("npos", "n")).select("document_id", "section_id", "n.*", _ord(1, F.col("ord"), F.col("npos")).alias("emit_ord")).select(*columns)
    label = F.coalesce("alias", "target")
    inline, blocks = parts.code.where("inline"), parts.code.where("not inline")
    return (
        branch(docs, F.col("defines"), "definition", "frontmatter", 1.0, 0)
        .unionByName(section_rows)
        .unionByName(branch(inline, E.structured_names(F.col("value"), True), "reference", "inline_code", 0.75, 2, "pos"))
        .unionByName(branch(blocks, E.structured_names(F.col("value"), True), "reference", "code_block", 0.7, 3, "pos"))
        .unionByName(branch(parts.md_links, E.structured_names(F.concat_ws(" ", "text", "url"), False), "reference", "markdown_link", 0.7, 4, "pos"))
        .unionByName(branch(parts.wiki_links, F.when(E.looks_like_entity(label), F.array(label)).otherwise(none), "reference", "wikilink", 0.7, 5, "pos"))
    )


def extract_entities(emitted: DataFrame, config: Config) -> DataFrame:
    """Cleaned, kind inferred, stop names gone, first of each (role, kind, name, section, provenance), enabled kinds only."""
    stops = [s.strip().removeprefix("`").removesuffix("`").lower() for s in config.stop_entities]
    rows = emitted.withColumn("name", E.cleanup_name(F.col("name"))).where("name <> ''").withColumn("kind", E.infer_kind(F.col("name"))).withColumn("normalized_name", normalize_entity(F.col("name")))
    stopped = (F.col("role") == "reference") & (F.col("kind") == "symbol") & F.col("normalized_name").isin(stops)
    first = Window.partitionBy("document_id", "role", "kind", "normalized_name", F.coalesce("section_id", F.lit("doc")), "provenance").orderBy("emit_ord")
    kept = rows.where(~stopped).withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    return kept.where(F.col("kind").isin(list(config.enabled_kinds)))


def build_graph(parsed: DataFrame, config: Config | None = None) -> Graph:
    """The graph of parsed documents; documents with an error are left out.

    parsed is read several times: pass a written table.
    """
    config = config or Config()
    parsed = parsed.where("error is null")
    documents = parsed.select(
        "id",
        "path",
        "title",
        F.coalesce("front.type", F.lit("other")).alias("type"),
        F.coalesce("front.status", F.lit("active")).alias("status"),
        "hash",
        F.coalesce("front.trust_tier", F.lit("authored")).alias("trust_tier"),
        F.lit(None).cast("string").alias("updated_at"),
        F.current_timestamp().alias("indexed_at"),
        F.struct(F.col("front.trust_tier").alias("declared_trust_tier"), F.col("front.id").alias("frontmatter_id"), F.col("front.tags").alias("tags")).alias("metadata"),
    )
    parts = explode_parts(parsed)
    sections = parts.sections
    chunks = sections.select(
        stable_id("chunk", F.concat(F.col("id"), F.lit(":content"))).alias("id"),
        "document_id",
        F.col("id").alias("section_id"),
        "content",
        token_estimate(F.col("content")).alias("token_estimate"),
        F.struct("heading", "anchor").alias("metadata"),
    )
    extracted = extract_entities(emit_entities(parsed, parts), config)

    fronted = parsed.select(F.col("id").alias("document_id"), "path", "front")
    sources = None
    for phase, (name, kind) in enumerate((("implements", "IMPLEMENTS"), ("source_refs", "REFERENCES_SOURCE")), 6):
        rows = fronted.select("document_id", "path", F.posexplode(f"front.{name}").alias("pos", "raw")).select("document_id", normalize_path(trimmed(F.col("raw"))).alias("ref"), F.lit(kind).alias("kind"), _ord(phase, F.col("pos")).alias("emit_ord"))
        sources = rows if sources is None else sources.unionByName(rows)
    source_refs = sources.groupBy(F.lower("ref").alias("normalized_path")).agg(F.min_by("ref", "emit_ord").alias("path")).select(source_ref_id(F.col("normalized_path")).alias("id"), "path", "normalized_path", F.current_timestamp().alias("created_at"))

    aliases = document_aliases(parsed.select("id", "path", "title", F.col("front.id").alias("front_id")))
    anchors = section_anchors(sections)
    relations = None
    for phase, (name, kind) in enumerate((("depends_on", "DEPENDS_ON"), ("supersedes", "SUPERSEDES"), ("deprecated_by", "DEPRECATED_BY")), 8):
        rows = fronted.select("document_id", "path", F.posexplode(f"front.{name}").alias("pos", "reference")).select("document_id", "path", "reference", F.lit(kind).alias("kind"), _ord(phase, F.col("pos")).alias("emit_ord"))
        relations = rows if relations is None else relations.unionByName(rows)
    related = resolve(relations.withColumns({"from_id": F.col("document_id"), "from_path": F.col("path"), "anchor": F.lit(None).cast("string")}), aliases, anchors)
    related = related.withColumn("entity_kind", E.infer_kind(F.col("reference")))
    fallback = related.where("node_id is null")

    named = extracted.select("name", "kind", "emit_ord").unionByName(fallback.select(F.col("reference").alias("name"), F.col("entity_kind").alias("kind"), "emit_ord"))
    found = first_spelling(named).withColumn("namespace", F.lit(None).cast("string")).withColumn("created_at", F.current_timestamp())

    links = link_references(parts, parsed)
    resolved = resolve(links, aliases, anchors).where("node_id is not null")
    columns = ["from_id", "to_id", "kind", "provenance", "confidence", "emit_ord"]
    paths = documents.select(F.col("id").alias("document_id"), "path")
    contains = sections.join(paths, "document_id")
    emitted = [
        contains.select(F.col("document_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("CONTAINS").alias("kind"), F.lit("heading").alias("provenance"), F.lit(1.0).alias("confidence"), _ord(-2, F.col("ord")).alias("emit_ord")),
        chunks.join(paths, "document_id").select(F.col("section_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("CONTAINS").alias("kind"), F.lit("heading").alias("provenance"), F.lit(1.0).alias("confidence"), _ord(-1).alias("emit_ord")),
        extracted.select(F.coalesce("section_id", "document_id").alias("from_id"), entity_id(F.col("kind"), F.col("normalized_name")).alias("to_id"), F.when(F.col("role") == "definition", "DEFINES").otherwise("REFERENCES").alias("kind"), "provenance", "confidence", "emit_ord"),
        sources.select(F.col("document_id").alias("from_id"), source_ref_id(F.lower("ref")).alias("to_id"), "kind", F.lit("frontmatter").alias("provenance"), F.lit(1.0).alias("confidence"), "emit_ord"),
        related.select(
            F.col("document_id").alias("from_id"),
            F.coalesce("node_id", entity_id(F.col("entity_kind"), normalize_entity(F.col("reference")))).alias("to_id"),
            "kind",
            F.lit("frontmatter").alias("provenance"),
            F.when(F.col("node_id").isNotNull(), 1.0).otherwise(0.85).alias("confidence"),
            "emit_ord",
        ),
        resolved.select(F.coalesce("section_id", "from_id").alias("from_id"), F.col("node_id").alias("to_id"), F.lit("LINKS_TO").alias("kind"), "provenance", F.lit(0.9).alias("confidence"), "emit_ord"),
    ]
    edges = emitted[0].select(*columns)
    for more in emitted[1:]:
        edges = edges.unionByName(more.select(*columns))
    edges = with_edge_id(dedupe_edges(edges)).withColumn("created_at", F.current_timestamp())

    vectors = embed_rows(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id", "content", config.embedding_dimensions).select(
        "chunk_id",
        F.lit(config.embedding_provider).alias("provider"),
        F.lit(config.embedding_model).alias("model"),
        F.lit(config.embedding_dimensions).alias("dimensions"),
        "vector",
        F.current_timestamp().alias("created_at"),
    )
    return Graph(
        documents=_last_by_id(documents, "path"),
        sections=sections.drop("ord"),
        entities=found.select("id", "name", "normalized_name", "kind", "namespace", "created_at"),
        source_refs=source_refs,
        edges=edges.select("id", "from_id", "to_id", "kind", "weight", "confidence", "provenance", "created_at"),
        chunks=chunks,
        vectors=vectors if config.embeds else vectors.where(F.lit(False)),
    )


def _last_by_id(rows: DataFrame, order: str) -> DataFrame:
    last = Window.partitionBy("id").orderBy(F.col(order).desc())
    return rows.withColumn("__turn", F.row_number().over(last)).where("__turn = 1").drop("__turn")


def link_references(parts: Parts, parsed: DataFrame) -> DataFrame:
    """Markdown and wiki links as references to resolve: from_id, from_path, section_id, reference, anchor, provenance, line, emit_ord."""
    reference, anchor = url_reference(F.col("url"))
    links = parts.md_links.where(~is_external(F.col("url"))).select(F.col("document_id").alias("from_id"), F.col("path").alias("from_path"), "section_id", reference.alias("reference"), anchor.alias("anchor"), F.lit("markdown_link").alias("provenance"), "line", F.col("url").alias("shown"), _ord(11, F.col("pos")).alias("emit_ord"))
    wikis = parts.wiki_links.select(F.col("document_id").alias("from_id"), F.col("path").alias("from_path"), "section_id", F.col("target").alias("reference"), "anchor", F.lit("wikilink").alias("provenance"), "line", F.col("raw").alias("shown"), _ord(12, F.col("pos")).alias("emit_ord"))
    return links.unionByName(wikis)
