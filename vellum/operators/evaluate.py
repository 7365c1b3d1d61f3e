"""Retrieval evaluation: recall, precision and coverage of query sets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import slugify
from .context import build_context
from .search import SearchIndex, search
from .traverse import resolve_node, trace


@dataclass(frozen=True)
class Case:
    """A question and what its answer should hold."""

    id: str
    query: str
    documents: tuple[str, ...] = ()
    sections: tuple[tuple[str, str], ...] = ()
    entities: tuple[str, ...] = ()
    edges: tuple[str, ...] = ()
    source_refs: tuple[str, ...] = ()
    trace: tuple[str, str, int, tuple[str, ...]] | None = None


def coverage(expected: Column, observed: Column) -> Column:
    """Share of expected values that were observed, four decimals; 1 if nothing is expected."""
    wanted = F.size(F.array_distinct(expected))
    return F.when(wanted == 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(expected, observed)) / wanted, 4))


def precision(expected: Column, observed: Column) -> Column:
    """Share of observed values, repeats counted, that were expected; 0 if there are none."""
    hits = F.size(F.filter(observed, lambda x: F.array_contains(expected, x)))
    return F.when(F.size(observed) == 0, F.lit(0.0)).otherwise(hits / F.size(observed))


def covered(expected: Iterable[str], observed: Iterable[str]) -> float:
    wanted, seen = list(expected), set(observed)
    return round(sum(x in seen for x in wanted) / len(wanted), 4) if wanted else 1.0


@dataclass
class CaseResult:
    case: Case
    metrics: dict[str, Any] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        full = ("document_recall", "section_recall", "entity_recall", "source_ref_recall", "edge_coverage")
        return all(self.metrics[m] == 1 for m in full) and self.metrics["budget_fit"] and self.metrics["reason_coverage"] and self.metrics["fusion_coverage"] and self.metrics["trace_success"] is not False


def evaluate_case(index: SearchIndex, case: Case, config: Config | None = None, limit: int | None = None, mode: str = "auto") -> CaseResult:
    config = config or Config()
    graph = index.graph
    spark = graph.documents.sparkSession
    rows = search(index, case.query, config, limit, mode).collect()
    packed = build_context(index, case.query, config, mode=mode, debug=True)

    def slug_keys(pairs: Iterable[tuple[str, str | None]]) -> list[str]:
        listed = [(p, h or "") for p, h in pairs]
        return [r.k for r in spark.createDataFrame(listed, "p string, h string").select(F.concat_ws("#", "p", slugify(F.col("h"))).alias("k")).collect()] if listed else []

    def found(values: Iterable[str], kind: str) -> list[str]:
        return [v for v in values if not resolve_node(graph, v).where(F.col("kind") == kind).isEmpty()]

    steps, success = [], None
    if case.trace:
        start, end, depth, kinds = case.trace
        ends = [resolve_node(graph, x).orderBy("at", "id").limit(1).collect() for x in (start, end)]
        steps = trace(graph.edges, ends[0][0].id, ends[1][0].id, depth).collect() if all(ends) else []
        same = all(ends) and ends[0][0].id == ends[1][0].id
        success = bool(steps or same) and covered(kinds, [s.kind for s in steps]) == 1
    kinds_seen = [r.kind for r in graph.edges.select("kind").distinct().collect()] if case.edges else []
    items = packed["items"]
    metrics = {
        "document_recall": covered(case.documents, [r.path for r in rows]),
        "section_recall": covered(slug_keys(case.sections), slug_keys((i["path"], i["heading"]) for i in items)),
        "context_precision": sum(i["path"] in case.documents for i in items) / len(items) if items else 0,
        "entity_recall": covered(case.entities, found(case.entities, "entity")),
        "source_ref_recall": covered(case.source_refs, found(case.source_refs, "source_ref")),
        "edge_coverage": covered(case.edges, [*kinds_seen, *(s.kind for s in steps)]),
        "trace_success": success,
        "returned_chars": packed["usedChars"],
        "budget_fit": packed["usedChars"] <= packed["maxChars"],
        "reason_coverage": all(r.reason for r in rows) and all(i["reason"] for i in items),
        "fusion_coverage": all("RRF fusion" in r.reason for r in rows),
        "context_diversity": packed["debug"]["packingDiversityRatio"],
        "fanout": {k: packed["debug"][k] for k in ("seedNodes", "visitedNodes", "expandedEdges", "skippedByNodeLimit", "skippedByDepth")},
    }
    return CaseResult(case, metrics)


MEANS = ("document_recall", "section_recall", "context_precision", "entity_recall", "source_ref_recall", "edge_coverage", "context_diversity")


def evaluate(index: SearchIndex, cases: Iterable[Case], config: Config | None = None, limit: int | None = None, mode: str = "auto") -> dict[str, Any]:
    results = [evaluate_case(index, c, config, limit, mode) for c in cases]
    n = len(results)
    passed = sum(r.passed for r in results)
    summary = {"cases": n, "passed": passed, "failed": n - passed} | {m: round(sum(r.metrics[m] for r in results) / n, 4) if n else 0 for m in MEANS}
    return {"summary": summary, "results": results}


def summarise(results: DataFrame) -> DataFrame:
    """Means of metric columns and passed counts over a table of case results."""
    return results.agg(F.count("*").alias("cases"), F.sum(F.col("passed").cast("int")).alias("passed"), *(F.round(F.avg(m), 4).alias(m) for m in MEANS if m in results.columns))
