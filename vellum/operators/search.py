"""Ranked search: definitions, BM25 over postings, hashed vectors, and their fusion.

Content stays out of ranking: channels work on ids and scores, and texts are joined back for
the few rows that are left.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import CJK, cjk_ngrams, exploded_terms, fold_text, like_prefix, prefix_terms
from ..plans import storage
from ..plans.graph import Graph
from .stats import document_frequency, owners, top_definitions
from .vectors import embed_text, similar_vectors

#: Fixed values of scoring.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF_K, RRF_WEIGHT = 60, 1000
TIER_BOOST = {"validated": 8.0, "authored": 5.0, "generated": -5.0, "external": -10.0, "untrusted": -30.0}
STATUS_BOOST = {"deprecated": -20.0, "superseded": -20.0, "draft": -8.0, "archived": -8.0}
PENALTY, MOST_PENALTY = 20, 60
#: Characters for a question that needs no more depth.
SHALLOW_CHARS = 16_000


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """term, chunk_id, tf, n: words of each text; a word that only an added CJK n-gram has is there with tf 0."""
    return term_rows(chunks, id_col, text_col).groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"), F.sum("n").alias("n"))


def term_rows(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """postings() with a row for each occurrence: as good for one question, without the shuffle that an index is worth."""
    texts = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    words = exploded_terms(texts, F.col("text"), "chunk_id").withColumn("tf", F.lit(1))
    with_cjk = texts.where(F.col("text").rlike(f"[{CJK}]"))
    grams = exploded_terms(with_cjk, F.concat_ws(" ", cjk_ngrams(F.col("text"))), "chunk_id").withColumn("tf", F.lit(0))
    return words.unionByName(grams).select("term", "chunk_id", "tf", F.lit(1).alias("n"))


def chunk_lengths(chunks: DataFrame, index: DataFrame, id_col: str = "id") -> DataFrame:
    """chunk_id, length in index words, added n-grams included, from the postings of chunks."""
    totals = index.groupBy("chunk_id").agg(F.sum("n").alias("length"))
    return chunks.select(F.col(id_col).alias("chunk_id")).join(totals, "chunk_id", "left").select("chunk_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def bm25(index: DataFrame, lengths: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """chunk_id, rank: the sum over prefixes of idf times saturated frequency, negated, so that smaller is better.

    A prefix counts as one word: its frequency and document count are those of all words that
    begin with it. Only the postings of matching terms are read.
    """
    prefixes = [fold_text(p) for p in prefixes]
    hits = index.where(like_prefix(F.col("term"), prefixes))
    which = F.filter(F.array(*(F.lit(p) for p in prefixes)), lambda p: F.col("term").startswith(p))
    per = hits.select("chunk_id", "tf", F.explode(which).alias("prefix")).groupBy("prefix", "chunk_id").agg(F.sum("tf").alias("tf")).where("prefix is not null and chunk_id is not null")
    # Counting tf, which is never null, keeps the plan of per as it is below, so that its exchange is reused.
    counts = per.groupBy("prefix").agg(F.count("tf").alias("n"))
    corpus = lengths.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    idf = F.ln((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    # counts has a row per prefix of the query, corpus has one row.
    weights = counts.join(F.broadcast(corpus)).select("prefix", "mean", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    scored = per.join(F.broadcast(weights), "prefix").join(lengths, "chunk_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # Added from the smallest, not as rows arrive: equal texts tie to the last bit, so that ids decide.
    parts = F.sort_array(F.collect_list(part))
    return scored.groupBy("chunk_id").agg(parts.alias("parts")).select("chunk_id", (-F.aggregate("parts", F.lit(0.0), lambda total, x: total + x)).alias("rank"))


def full_text(index: DataFrame, lengths: DataFrame, query: str, limit: int) -> DataFrame:
    """chunk_id, rank of the best `limit` chunks for a query; empty without query words. Ties by id."""
    prefixes = prefix_terms(query)
    if not prefixes:
        return lengths.select("chunk_id", F.lit(0.0).alias("rank")).where(F.lit(False))
    return bm25(index, lengths, prefixes).orderBy("rank", "chunk_id").limit(limit)


def query_entity_candidates(query: str) -> list[str]:
    """Names in a query that may be entities: code spans, capitalised and dotted words, capitals, paths."""
    spans = re.findall(r"`([^`]+)`", query)
    words = re.findall(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?(?![A-Za-z0-9_])", query)
    capitals = re.findall(r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]{2,}(?![A-Za-z0-9_])", query)
    paths = re.findall(r"/[A-Za-z0-9_./:{}-]+", query)
    return list(dict.fromkeys(x.strip() for x in [*spans, *words, *capitals, *paths] if x.strip()))


def boost(column: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for value, score in table.items():
        out = F.when(column == value, F.lit(score)).otherwise(out)
    return out


def adjust(score: Column, tier: Column, status: Column, penalty: Column | None = None) -> Column:
    """Base score with trust tier and status, less a penalty."""
    out = score + boost(tier, TIER_BOOST) + boost(status, STATUS_BOOST)
    return out if penalty is None else out + penalty


def frequency_penalty(frequencies: Column, threshold: int) -> Column:
    """-20 for each matched entity in more documents than the threshold, -60 at most."""
    over = F.size(F.filter(frequencies, lambda n: n > threshold))
    return (-F.least(F.lit(MOST_PENALTY), PENALTY * over)).cast("double")


def fuse(results: DataFrame) -> DataFrame:
    """Adds boost and fused score to (channel, rank, key, score): reciprocal ranks, each channel once per key.

    Windows over one partitioning by key, so that the ranked rows are computed once.
    """
    key = Window.partitionBy("key")
    first = F.row_number().over(Window.partitionBy("key", "channel").orderBy("rank")) == 1
    marked = results.repartition("key").withColumn("first", first)
    best = F.when(F.col("first"), F.concat(F.col("channel"), F.lit("#"), F.col("rank").cast("string")))
    fused = marked.withColumns(
        {
            "boost": F.round(F.sum(F.when(F.col("first"), 1.0 / (RRF_K + F.col("rank")))).over(key) * RRF_WEIGHT, 4),
            "channels": F.concat_ws(", ", F.array_sort(F.collect_list(best).over(key))),
        }
    ).drop("first")
    return fused.withColumn("score", F.round(F.col("score") + F.col("boost"), 4))


def dedupe_results(results: DataFrame) -> DataFrame:
    """One row per key: the best score (the earlier of equals), reasons and entities of all rows in order without repeats.

    results: key, ord, score, reason, matched (array of structs with an id), and others.
    """
    others = [c for c in results.columns if c not in ("key", "ord", "score", "reason", "matched")]
    best = F.max_by(F.struct(*others), F.struct("score", -F.col("ord"))) if others else None
    gathered = results.groupBy("key").agg(
        F.max("score").alias("score"),
        F.min("ord").alias("ord"),
        F.sort_array(F.collect_list(F.struct("ord", "reason", "matched"))).alias("rows"),
        *([best.alias("best")] if others else []),
    )
    reasons = F.array_distinct(F.filter(F.flatten(F.transform("rows", lambda r: F.split(r["reason"], "; "))), lambda x: x != ""))
    entities = F.array_distinct(F.flatten(F.transform("rows", lambda r: r["matched"])))
    return gathered.select("key", "score", "ord", F.concat_ws("; ", reasons).alias("reason"), entities.alias("matched"), *(["best.*"] if others else []))


@dataclass(frozen=True)
class SearchIndex:
    """What queries read: the graph, its postings and chunk lengths, written once per index run."""

    graph: Graph
    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame


def build_search_index(graph: Graph) -> SearchIndex:
    """Postings are read by every channel and by the lengths: write them first where a graph is large."""
    index = postings(graph.chunks)
    return SearchIndex(graph, index, chunk_lengths(graph.chunks, index), document_frequency(graph.edges, owners(graph), graph.entities))


def passing_search_index(graph: Graph) -> SearchIndex:
    """A search index for a question or two to a graph that is stored nowhere: occurrences stay in the plan, lengths and frequencies are computed once."""
    index = term_rows(graph.chunks)
    return SearchIndex(graph, index, storage.cut(chunk_lengths(graph.chunks, index)), storage.cut(document_frequency(graph.edges, owners(graph), graph.entities)))


def section_chunks(graph: Graph) -> DataFrame:
    """The first chunk of each section or document that edges start from: node_id, chunk_id, document_id, section_id."""
    in_section = graph.chunks.groupBy(F.col("section_id").alias("node_id")).agg(F.min("id").alias("chunk_id"))
    starts = graph.chunks.join(graph.sections.select(F.col("id").alias("section_id"), "start_line"), "section_id", "left")
    in_document = starts.groupBy(F.col("document_id").alias("node_id")).agg(F.min_by("id", F.struct("start_line", "id")).alias("chunk_id"))
    return in_section.unionByName(in_document)


def definition_rows(graph: Graph, entities: DataFrame, k: int = 3) -> DataFrame:
    """chunk_id, rank_score, weight of the best definitions of the given entities (id, turn)."""
    defines = graph.edges.where("kind = 'DEFINES'").join(entities.select(F.col("id").alias("to_id"), "turn"), "to_id")
    placed = defines.join(section_chunks(graph).withColumnRenamed("node_id", "from_id"), "from_id")
    lines = graph.sections.select(F.col("id").alias("from_id"), "start_line")
    paths = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id").join(graph.documents.select(F.col("id").alias("document_id"), "path"), "document_id")
    rows = placed.join(lines, "from_id", "left").join(paths, "chunk_id").withColumnsRenamed({"to_id": "entity_id", "id": "edge_id"})
    return top_definitions(rows, k).select("chunk_id", "weight", "turn", "place")


def search(index: SearchIndex, query: str, config: Config | None = None, limit: int | None = None, mode: str = "auto") -> DataFrame:
    """The best sections or documents for a query: key, score, reason, matched, semantic, document and section columns, content.

    mode: keyword leaves vectors out; semantic and auto use them where the configuration has them.
    """
    config = config or Config()
    limit = limit or config.search_limit
    graph, spark = index.graph, index.graph.documents.sparkSession
    names = [n.strip().removeprefix("`").removesuffix("`").lower() for n in query_entity_candidates(query)]
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "normalized_name string, turn int")
    found = graph.entities.join(F.broadcast(wanted), "normalized_name").select("id", "name", "kind", "normalized_name", "turn")
    # One entity at most for each name in the query and each kind: a list as long as the query travels with the plan.
    named = [r.asDict() for r in found.join(index.frequencies, "id", "left").orderBy("turn", "id").collect()]
    matched_ids = spark.createDataFrame([(r["id"], i) for i, r in enumerate(named)], "id string, turn int")

    text = full_text(index.postings, index.lengths, query, 2 * limit).select("chunk_id", F.row_number().over(Window.orderBy("rank", "chunk_id")).alias("rank"), (100 - F.col("rank")).alias("base"), F.lit("fts").alias("channel"), F.lit(None).cast("double").alias("similarity"))
    channels = text
    if named:
        defined = definition_rows(graph, matched_ids)
        channels = defined.select("chunk_id", F.row_number().over(Window.orderBy("turn", "place")).alias("rank"), (200 + F.col("weight")).alias("base"), F.lit("definition").alias("channel"), F.lit(None).cast("double").alias("similarity")).unionByName(channels)
    if config.embeds and mode != "keyword":
        vector = embed_text(query, config.embedding_dimensions)
        near = similar_vectors(graph.vectors, vector, 2 * limit, config.embedding_provider, config.embedding_model)
        channels = channels.unionByName(near.select("chunk_id", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "chunk_id")).alias("rank"), (80 + 50 * F.col("similarity")).alias("base"), F.lit("semantic").alias("channel"), "similarity"))

    # At most 4 * limit rows and three per named entity from here on.
    chunk = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id", "section_id", "content")
    document = graph.documents.select(F.col("id").alias("document_id"), "path", "title", "type", "status", "trust_tier", F.col("metadata.declared_trust_tier").alias("declared_tier"))
    section = graph.sections.select(F.col("id").alias("section_id"), "heading", "anchor", "level", "start_line", "end_line")
    rows = F.broadcast(channels).join(chunk, "chunk_id").join(document, "document_id").join(section, "section_id", "left")
    known = F.array(*(F.struct(F.lit(r["id"]).alias("id"), F.lit(r["name"]).alias("name"), F.lit(r["kind"]).alias("kind"), F.lit(r["normalized_name"]).alias("normalized_name"), F.lit(int(r["documents"] or 0)).alias("documents")) for r in named))
    none = F.array().cast("array<struct<id:string,name:string,kind:string,normalized_name:string,documents:int>>")
    lowered = F.lower("content")
    rows = rows.withColumn("matched", F.filter(known, lambda e: F.contains(lowered, e["normalized_name"])) if named else none)
    penalty = frequency_penalty(F.transform("matched", lambda e: e["documents"]), config.high_frequency_threshold)
    is_definition = F.col("channel") == "definition"
    frequent = F.filter("matched", lambda e: e["documents"] > config.high_frequency_threshold)
    reason = F.when(is_definition, F.lit("the query names what is defined here")).when(F.col("channel") == "fts", F.lit("full-text content match")).otherwise(F.format_string("local semantic vector match (%.3f)", "similarity"))
    reason = F.when(~is_definition & (F.size(frequent) > 0), F.concat(reason, F.lit("; high-frequency entity penalty ("), F.concat_ws(", ", F.transform(frequent, lambda e: e["name"])), F.lit(")"))).otherwise(reason)
    scored = rows.withColumns({"score": adjust(F.col("base"), F.col("trust_tier"), F.col("status"), F.when(is_definition, 0.0).otherwise(penalty)), "reason": reason, "key": F.coalesce("section_id", "document_id")})
    order = F.when(is_definition, 0).when(F.col("channel") == "fts", 1).otherwise(2) * 1_000_000 + F.col("rank")
    semantic = F.when(F.col("channel") == "semantic", F.struct(F.lit("chunk_vector").alias("source"), F.lit(config.embedding_provider).alias("provider"), F.lit(config.embedding_model).alias("model"), F.round("similarity", 4).alias("confidence")))
    fused = fuse(scored).withColumns({"reason": F.concat(F.col("reason"), F.lit("; RRF fusion ("), F.col("channels"), F.lit(")")), "ord": order, "semantic": semantic})
    keep = ["key", "ord", "score", "reason", "matched", "semantic", "document_id", "path", "title", "type", "status", "trust_tier", "declared_tier", "section_id", "heading", "anchor", "level", "start_line", "end_line", "content"]
    return dedupe_results(fused.select(*keep)).orderBy(F.col("score").desc(), "ord").limit(limit)


def explain(index: SearchIndex, query: str, config: Config | None = None, limit: int | None = None, mode: str = "auto") -> dict:
    """How a query was read: entity candidates, prefixes, channels that answered, document frequencies."""
    config = config or Config()
    candidates = query_entity_candidates(query)
    rows = search(index, query, config, limit, mode).collect()
    channels = list(dict.fromkeys(d.split("#")[0] for r in rows for m in re.findall(r"RRF fusion \(([^)]+)\)", r.reason) for d in m.split(", ")))
    matched = {e["id"]: e for r in rows for e in r.matched}
    return {
        "query": query,
        "entityCandidates": candidates,
        "ftsQuery": " OR ".join(f"{p}*" for p in prefix_terms(query)),
        "channels": channels,
        "entityDocumentFrequencies": [{"id": e["id"], "name": e["name"], "documents": e["documents"]} for e in matched.values()],
        "results": [r.asDict(True) for r in rows],
    }


def agent_mode(query: str, documents: int, config: Config, known_files: int = 0, max_chars: int | None = None) -> dict[str, int]:
    """Limit, depth and character budget that suit a question and the size of the collection; an asked budget is kept."""
    default = config.search_limit
    half = -(-default // 2)
    words = len(query.split())
    limit = default + (half if words > 6 or len(query) > 80 else 0) + (default if documents >= 1000 else half if documents >= 100 else 0)
    deeper = known_files > 0 or words > 6 or documents >= 100
    return {"limit": max(4, min(24, limit)), "max_depth": min(4, config.max_depth + 1) if deeper else config.max_depth, "max_chars": max_chars or (config.max_context_chars if deeper else min(config.max_context_chars, SHALLOW_CHARS))}


def semantic_status(config: Config, vectors: int, chunks: int, stored: Sequence[dict]) -> str:
    """disabled, unsupported, missing, stale or ready."""
    if not config.embedding_enabled:
        return "disabled"
    if not config.embeds:
        return "unsupported"
    if not vectors:
        return "missing"
    fits = all(s["provider"] == config.embedding_provider and s["model"] == config.embedding_model and s["dimensions"] == config.embedding_dimensions for s in stored)
    return "ready" if fits and vectors == chunks else "stale"
