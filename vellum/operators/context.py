"""Context packing: search seeds, best-first expansion, round-robin order, character budget.

Only the queue runs on the driver: it takes a few dozen nodes at most, and fetches the best edges
of all waiting nodes in one join. Texts are fetched for the nodes that were kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import normalize_path
from ..plans import storage
from ..plans.graph import Graph
from .risks import risks_of
from .search import SearchIndex, search
from .stats import node_labels, undirected
from .traverse import resolve_node

LEAST_NODES = 16
#: What a debug answer counts of the walk.
COUNTERS = ("seedNodes", "visitedNodes", "expandedEdges", "skippedVisitedNodes", "skippedByNodeLimit", "skippedByDepth")
KNOWN_FILE_SCORE = 10_000.0


def node_chunks(graph: Graph) -> DataFrame:
    """node_id, chunk_id: a chunk itself, a section's first, a document's first by line."""
    lines = graph.sections.select(F.col("id").alias("section_id"), "start_line")
    placed = graph.chunks.join(lines, "section_id", "left").select("id", "document_id", "section_id", F.coalesce("start_line", F.lit(0)).alias("line"))
    of_document = placed.groupBy(F.col("document_id").alias("node_id")).agg(F.min_by("id", F.struct("line", "id")).alias("chunk_id"))
    of_section = placed.where("section_id is not null").groupBy(F.col("section_id").alias("node_id")).agg(F.min("id").alias("chunk_id"))
    return placed.select(F.col("id").alias("node_id"), F.col("id").alias("chunk_id")).unionByName(of_section).unionByName(of_document)


def in_turns(rows: DataFrame, path: str, score: str, tie: str) -> tuple[DataFrame, list[Column]]:
    """rows with what their order needs, and that order: one row of each path in turn, paths in the order of their best row."""
    by_path = Window.partitionBy(path).orderBy(F.col(score).desc(), tie)
    ranked = rows.withColumn("__round", F.row_number().over(by_path)).withColumn("__best", F.max(F.col(score)).over(Window.partitionBy(path))).withColumn("__tie", F.first(tie).over(by_path))
    return ranked, [F.col("__round"), F.col("__best").desc(), F.col("__tie"), F.col(path)]


def round_robin(rows: DataFrame, path: str, score: str, tie: str) -> DataFrame:
    """Adds pos: the place of each row when paths take turns."""
    ranked, order = in_turns(rows, path, score, tie)
    return storage.numbered(ranked, order, "pos").drop("__round", "__best", "__tie")


def pack_budget(rows: DataFrame, length: Column, budget: int, order: list[Column], partition: list[Column] | None = None) -> DataFrame:
    """Adds kept: the characters of each row that fit into the budget, in order."""
    before = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.coalesce(F.sum(length).over(before), F.lit(0))
    return rows.withColumn("kept", F.greatest(F.lit(0), F.least(length, F.lit(budget) - prefix)))


def trim_to_budget(text: str, most: int) -> str:
    """The text, or as much as fits with an ellipsis."""
    if len(text) <= most:
        return text
    return text[:most] if most <= 3 else (text[: most - 3].rstrip() + "...")[:most]


def _best_edges(graph: Graph, labels: DataFrame, nodes: list[str], most: int) -> dict[str, list[dict]]:
    """The best edges of each node, containment left out, with labels."""
    spark = graph.edges.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(n,) for n in nodes], "node_id string"))
    score = F.col("weight") * F.col("confidence")
    best = Window.partitionBy("node_id").orderBy(score.desc(), F.col("weight").desc(), F.col("confidence").desc(), "id")
    ends = undirected(graph.edges.where("kind <> 'CONTAINS'")).join(wanted, "node_id")
    rows = ends.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).withColumn("score", score)
    named = rows.join(labels.select(F.col("id").alias("node_id"), F.col("label").alias("node_label")), "node_id", "left").join(labels.select(F.col("id").alias("other_id"), F.col("label").alias("other_label")), "other_id", "left")
    out: dict[str, list[dict]] = {n: [] for n in nodes}
    for r in named.orderBy("node_id", "place").collect():
        out[r.node_id].append(r.asDict())
    return out


def _step(edge: dict) -> dict[str, Any]:
    return {
        "fromId": edge["node_id"],
        "fromLabel": edge["node_label"] or edge["node_id"],
        "toId": edge["other_id"],
        "toLabel": edge["other_label"] or edge["other_id"],
        "edgeFromId": edge["from_id"],
        "edgeToId": edge["to_id"],
        "edgeKind": edge["kind"],
        "traversalDirection": "forward" if edge["forward"] else "reverse",
        "confidence": edge["confidence"],
        "provenance": edge["provenance"],
    }


def _shown(step: dict) -> str:
    via = f"{step['edgeKind']}/{step['provenance']}/{step['confidence']:g}"
    return f"{step['fromLabel']} --{via}--> {step['toLabel']}" if step["traversalDirection"] == "forward" else f"{step['fromLabel']} <--{via}-- {step['toLabel']}"


def _candidate(row: dict, **more: Any) -> dict[str, Any]:
    has = row.get("section_id") is not None
    return {
        "nodeId": row["section_id"] or row["document_id"],
        "documentId": row["document_id"],
        "sectionId": row["section_id"],
        "anchor": row["anchor"],
        "path": row["path"],
        "title": row["title"],
        "heading": row["heading"],
        "lines": {"start": row["start_line"], "end": row["end_line"]} if has else None,
        "status": row["status"],
        "trustTier": row["trust_tier"],
        "declaredTier": row["declared_tier"],
        "content": row["content"],
        "matchedEntities": [],
        "edgePath": None,
        **more,
    }


def _chunk_rows(graph: Graph, nodes: Sequence[str]) -> dict[str, dict]:
    """The representative chunk of each node that has one, with its document and section."""
    if not nodes:
        return {}
    spark = graph.edges.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(n,) for n in nodes], "node_id string"))
    chosen = node_chunks(graph).join(wanted, "node_id")
    chunks = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id", "section_id", "content")
    documents = graph.documents.select(F.col("id").alias("document_id"), "path", "title", "status", "trust_tier", F.col("metadata.declared_trust_tier").alias("declared_tier"))
    sections = graph.sections.select(F.col("id").alias("section_id"), "heading", "anchor", "start_line", "end_line")
    rows = F.broadcast(chosen).join(chunks, "chunk_id").join(documents, "document_id").join(sections, "section_id", "left")
    return {r.node_id: r.asDict() for r in rows.collect()}


def _add(candidates: dict[str, dict], new: dict) -> None:
    old = candidates.get(new["nodeId"])
    if old is None or new["score"] > old["score"] or (new["direct"] and not old["direct"]):
        candidates[new["nodeId"]] = new


def order_candidates(candidates: Sequence[dict]) -> list[dict]:
    """Direct ones first, each part by score and then one of each path in turn."""
    out = []
    for direct in (True, False):
        by_path: dict[str, list[dict]] = {}
        for c in sorted((c for c in candidates if c["direct"] is direct), key=lambda c: -c["score"]):
            by_path.setdefault(c["path"], []).append(c)
        for turn in range(max(map(len, by_path.values()), default=0)):
            out += [rows[turn] for rows in by_path.values() if len(rows) > turn]
    return out


def _source_refs(graph: Graph, candidates: Sequence[dict]) -> dict[str, list[dict]]:
    """Source paths tied to each node by implementation or source-reference edges."""
    nodes = {x for c in candidates for x in (c["nodeId"], c["documentId"])}
    if not nodes:
        return {}
    spark = graph.edges.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(n,) for n in sorted(nodes)], "node_id string"))
    ends = undirected(graph.edges.where(F.col("kind").isin("IMPLEMENTS", "REFERENCES_SOURCE"))).join(wanted, "node_id")
    rows = ends.join(graph.source_refs.select(F.col("id").alias("other_id"), "path"), "other_id").select("node_id", "path", "kind", "provenance", "confidence").collect()
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r.node_id, []).append({"path": r.path, "edgeKind": r.kind, "provenance": r.provenance, "confidence": r.confidence})
    return out


def _risk_notes(c: dict) -> list[str]:
    notes = []
    status = (c["status"] or "").strip().lower()
    if status and status != "active":
        notes.append(f"document status: {c['status']}")
    if c["trustTier"] not in ("authored", "validated"):
        notes.append(f"trust tier: {c['trustTier']}")
    if c["trustTier"] == "validated" and c["declaredTier"]:
        notes.append("trust tier: validated (front matter declared)")
    first = c["lines"]["start"] if c["lines"] else 1
    return notes + [f"content risk: {reason} at line {first + line - 1}" for line, reason in risks_of(c["content"])[:3]]


def _known_files(graph: Graph, names: Sequence[str], budget: int) -> list[dict]:
    """Chunks of files that the asker knows, and of what a known source path is tied to, as far as a budget of characters can hold."""
    found = []
    spark = graph.edges.sparkSession
    for i, name in enumerate(names):
        tidy = spark.range(1).select(normalize_path(F.lit(name)).alias("n")).first().n
        hit = next((rows[0] for rows in (resolve_node(graph, q).limit(2).collect() for q in dict.fromkeys([name, tidy])) if rows and not rows[0].ambiguous), None)
        if hit is None:
            continue
        if hit.kind != "source_ref":
            found += [_candidate(r, reason=f"known file {name}", score=KNOWN_FILE_SCORE - i, direct=True) for r in _chunk_rows(graph, [hit.id]).values()]
            continue
        ends = undirected(graph.edges).where(F.col("node_id") == hit.id).withColumn("order", F.struct((-F.col("weight")).alias("w"), (-F.col("confidence")).alias("c"), "id"))
        owner = graph.documents.select(F.col("id").alias("document_id"), "path")
        sizes = graph.chunks.where("content <> ''").select(F.col("id").alias("chunk_id"), "document_id", F.coalesce("section_id", "document_id").alias("owner"))
        met = ends.join(node_chunks(graph).withColumnRenamed("node_id", "other_id"), "other_id").join(sizes, "chunk_id").join(owner, "document_id")
        best = met.groupBy("owner", "path").agg(F.min_by(F.struct("other_id", "kind", "provenance"), "order").alias("e"), F.min("order").alias("order")).withColumn("same", F.lit(0))
        ranked, order = in_turns(best, "path", "same", "order")
        # An item takes a character at least, so no more than the budget's can be packed.
        kept = ranked.orderBy(*order).limit(budget).select("e.*").collect()
        rows = _chunk_rows(graph, [e.other_id for e in kept])
        found += [_candidate(rows[e.other_id], reason=f"known file {name} via {e.kind}/{e.provenance}", score=KNOWN_FILE_SCORE - i, direct=True) for e in kept if e.other_id in rows]
    return found


@dataclass(frozen=True)
class _Walk:
    """A node that was reached, how far from a seed, what it is worth, and the steps to it."""

    node: str
    score: float
    depth: int = 0
    path: tuple[dict, ...] = ()


def _walk(graph: Graph, labels: DataFrame, seeds: Sequence[_Walk], max_depth: int, room: int) -> tuple[list[_Walk], Counter]:
    """Nodes beyond the seeds, best first: `room` of them at most. Ties go to what was found first."""
    counts = Counter({"seedNodes": len(seeds)})
    visited = {s.node for s in seeds}
    edges: dict[str, list[dict]] = {}
    ticket = count()
    waiting = [(-s.score, next(ticket), s) for s in seeds]
    heapify(waiting)
    reached: list[_Walk] = []
    most = room + len(visited) + 1
    while waiting:
        _, _, at = heappop(waiting)
        if at.depth >= max_depth:
            counts["skippedByDepth"] += 1
            continue
        if at.node not in edges:
            soon = [w.node for _, _, w in waiting if w.depth < max_depth and w.node not in edges]
            edges |= _best_edges(graph, labels, [at.node, *soon], most)
        new: dict[str, dict] = {}
        for edge in edges[at.node]:
            if edge["other_id"] not in visited:
                new.setdefault(edge["other_id"], edge)
        taken = list(new.values())[: room - len(reached)]
        visited.update(e["other_id"] for e in taken)
        beyond = sum(e["other_id"] not in visited for e in edges[at.node])
        counts.update(expandedEdges=len(taken), skippedByNodeLimit=beyond, skippedVisitedNodes=len(edges[at.node]) - len(taken) - beyond)
        for e in taken:
            depth = at.depth + 1
            reached.append(_Walk(e["other_id"], at.score + e["score"] - 2 * depth, depth, (*at.path, _step(e))))
            heappush(waiting, (-reached[-1].score, next(ticket), reached[-1]))
    counts["visitedNodes"] = len(visited)
    return reached, counts


def build_context(index: SearchIndex, query: str, config: Config | None = None, limit: int | None = None, max_depth: int | None = None, max_chars: int | None = None, known_files: Sequence[str] = (), mode: str = "auto", debug: bool = False) -> dict[str, Any]:
    """Items that fit the character budget, most useful first, with paths, source refs and risk notes."""
    config = config or Config()
    max_depth = config.max_depth if max_depth is None else max_depth
    max_chars = max_chars or config.max_context_chars
    graph = index.graph
    labels = node_labels(graph)
    results = [r.asDict(True) for r in search(index, query, config, limit, mode).collect()]
    candidates: dict[str, dict] = {}
    seeds: dict[str, _Walk] = {}
    again = 0
    for r in results:
        names = [f"{e['name']} ({e['kind']})" for e in r["matched"]]
        _add(candidates, _candidate(r, reason=r["reason"], score=r["score"], direct=True, matchedEntities=names))
        nodes = dict.fromkeys([r["document_id"], *([r["section_id"]] if r["section_id"] else []), *(e["id"] for e in r["matched"])])
        again += sum(n in seeds for n in nodes)
        for n in nodes:
            seeds.setdefault(n, _Walk(n, r["score"]))
    reached, counts = _walk(graph, labels, list(seeds.values()), max_depth, max(LEAST_NODES, 2 * config.search_limit))
    counts["skippedVisitedNodes"] += again
    chunks = _chunk_rows(graph, [w.node for w in reached])
    for w in reached:
        if w.node in chunks:
            _add(candidates, _candidate(chunks[w.node], reason="reached through " + " | ".join(map(_shown, w.path)), score=w.score, direct=False, edgePath=list(w.path)))
    for c in _known_files(graph, known_files, max_chars):
        _add(candidates, c)
    ordered = order_candidates(list(candidates.values()))
    refs = _source_refs(graph, ordered)
    items, used, cut, skipped = [], 0, 0, 0
    for i, c in enumerate(ordered):
        if used >= max_chars:
            skipped += len(ordered) - i
            break
        text = trim_to_budget(c["content"], max_chars - used)
        if not text:
            skipped += 1
            continue
        cut += len(text) < len(c["content"])
        used += len(text)
        own = {(r["path"], r["edgeKind"]): r for n in (c["nodeId"], c["documentId"]) for r in refs.get(n, [])}
        keep = ("nodeId", "documentId", "sectionId", "anchor", "path", "title", "heading", "lines", "reason", "matchedEntities", "edgePath")
        items.append({k: c[k] for k in keep} | {"sourceRefs": [own[k] for k in sorted(own)], "riskNotes": _risk_notes(c), "content": text})
    paths = list(dict.fromkeys(i["path"] for i in items))
    result: dict[str, Any] = {"query": query, "maxChars": max_chars, "usedChars": used, "knownFiles": list(known_files), "items": items, "suggestedNextQueries": _suggestions(items, paths, known_files)}
    if debug:
        direct = sum(c["direct"] for c in ordered)
        result["debug"] = {name: counts[name] for name in COUNTERS} | {
            "candidateCount": len(ordered),
            "directCandidates": direct,
            "expandedCandidates": len(ordered) - direct,
            "packedItems": len(items),
            "packedUniqueDocuments": len(paths),
            "packingDiversityRatio": round(len(paths) / len(items), 4) if items else 0,
            "budgetTruncatedItems": cut,
            "budgetSkippedItems": skipped,
        }
    return result


def _suggestions(items: list[dict], paths: list[str], known_files: Sequence[str]) -> list[str]:
    names = [n.rsplit(" (", 1)[0] for i in items for n in i["matchedEntities"]]
    out = [f'node "{paths[0]}"'] if paths else []
    out += [f'trace "{known_files[0]}" "{paths[0]}"'] if known_files and paths else []
    return out + ([f'search "{names[0]}"'] if names else [])
