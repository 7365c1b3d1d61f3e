"""Command line: python -m vellum.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, init_config, load_config
from .operators import evaluate, export, health, paired
from .operators.query_sets import SETS, query_set
from .sources.files import ignore_store, read_json


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vellum")
    top.add_argument("--root", default=".")
    top.add_argument("--store", default=None, help="default: ROOT/.vellum/graph")
    top.add_argument("--json", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags: Any) -> None:
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
        for flag, kind in flags.items():
            option = "--" + flag.replace("_", "-")
            sub.add_argument(option, action="store_true") if kind is bool else sub.add_argument(option, type=kind)

    add("init")
    add("index", full=bool)
    add("status", storage=bool, freshness=bool)
    add("search", "query", limit=int, keyword=bool, semantic=bool, explain=bool)
    add("context", "query", limit=int, max_chars=int, max_depth=int, known_file=str, debug=bool)
    add("node", "name")
    add("trace", "start", "target", depth=int)
    add("eval", "cases", limit=int)
    add("benchmark", "runs")
    add("semantic-status")
    add("bundle-create", "target")
    add("bundle-verify", "target", against_root=bool)
    add("export", "kind", start=str, target=str, artifact=str, out=str)
    add("import-verify", "file")
    add("diff", base=str)
    add("report", previous=str)
    add("doctor", strict=bool, fail_on=str, changed=bool, since=str)
    add("serve")
    add("watch", debounce=str)
    return top


def _show(value: Any, as_json: bool) -> None:
    if isinstance(value, DataFrame):
        value = [r.asDict(True) for r in value.collect()]
    if isinstance(value, str):
        print(value)
    else:
        print(json.dumps(value, indent=None if as_json else 2, default=str, ensure_ascii=False))


def read_cases(path: str) -> list[evaluate.Case]:
    def one(c: dict[str, Any]) -> evaluate.Case:
        t = c.get("trace")
        return evaluate.Case(
            c["id"], c["query"], tuple(c.get("documents", ())), tuple((s["path"], s["heading"]) for s in c.get("sections", ())), tuple(c.get("entities", ())), tuple(c.get("edges", ())), tuple(c.get("source_refs", ())), (t["from"], t["to"], t.get("depth", 2), tuple(t.get("edge_kinds", ()))) if t else None
        )

    return [one(c) for c in read_json(path)]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    folder = Path(args.root, ".vellum")
    if args.command == "init":
        _show({"created": init_config(str(folder / "config.json")), "ignored": ignore_store(args.root)}, args.json)
        return 0
    spark = spark or SparkSession.builder.appName("vellum").getOrCreate()
    engine = Engine(spark, args.root, args.store or str(folder / "graph"), load_config(str(folder / "config.json")))
    command, code = args.command, 0
    if command == "index":
        out: Any = engine.index(args.full)
    elif command == "status":
        out = engine.status(args.storage, args.freshness)
    elif command == "search":
        mode = "keyword" if args.keyword else "semantic" if args.semantic else "auto"
        out = engine.explain(args.query, args.limit, mode) if args.explain else engine.search(args.query, args.limit, mode)
    elif command == "context":
        out = engine.context(args.query, limit=args.limit, max_chars=args.max_chars, max_depth=args.max_depth, known_files=[args.known_file] if args.known_file else (), debug=args.debug)
    elif command == "node":
        out = engine.node(args.name)
        code = int(out["status"] != "found")
    elif command == "trace":
        out = engine.trace(args.start, args.target, args.depth or 6)
        code = int(not out["found"])
    elif command == "eval":
        found = engine.evaluate(query_set(args.cases) if args.cases in SETS else read_cases(args.cases), args.limit)
        out = found["summary"] | {"cases": [{"id": r.case.id, "passed": r.passed, **r.metrics} for r in found["results"]]}
        code = int(found["summary"]["failed"] > 0)
    elif command == "benchmark":
        deltas, skipped = paired.pair_runs(paired.run_metrics(paired.read_runs(spark, args.runs)))
        out = {"aggregate": paired.aggregate_deltas(deltas).first().asDict(), "pairs": [r.asDict() for r in deltas.collect()], "skipped": [r.asDict() for r in skipped.collect()]}
    elif command == "semantic-status":
        out = engine.semantic_status()
    elif command == "bundle-create":
        out = engine.bundle(args.target)
    elif command == "bundle-verify":
        out = engine.verify_bundle(args.target, args.against_root)
        code = int(not out["valid"])
    elif command == "export":
        if args.kind == "graph" and args.out:
            out = engine.export_tables(args.out)
        elif args.kind == "markdown-index" and args.out:
            engine.write_markdown_index(args.out)
            out = {"written": args.out}
        elif args.kind == "graph":
            out = export.canonical_json(engine.export())
        elif args.kind == "mermaid":
            found = engine.trace(args.start, args.target)
            out = export.mermaid(found["steps"], found["message"] or "No path found.")
        elif args.kind == "markdown-index":
            out = engine.markdown_index()
        elif args.kind == "docs-site":
            out = engine.site_index().orderBy("path")
        elif args.kind == "source-bridge":
            out = engine.source_bridge(args.artifact)
        else:
            print(f"unknown export {args.kind}", file=sys.stderr)
            return 2
    elif command == "import-verify":
        out = engine.verify_tables(args.file) if Path(args.file).is_dir() else export.verify_export(read_json(args.file))
        code = int(not out["valid"])
    elif command == "diff":
        out = {name: [r.asDict(True) for r in df.collect()] for name, df in engine.diff(args.base or "HEAD").items()}
    elif command == "report":
        out = engine.report(read_json(args.previous) if args.previous else None)
    elif command == "doctor":
        scope = health.git_scope(args.root, args.since) if args.changed or args.since else None
        found = engine.doctor(scope)
        out = {"summary": found.summary, "stale": found.stale, "warnings": [r.asDict(True) for r in found.warnings.collect()]}
        code = int(health.fails(found, args.strict, args.fail_on))
    elif command == "serve":
        from .serve import serve

        serve(engine)
        return 0
    else:
        from .streaming.watch import DEBOUNCE, watch

        query = watch(engine, str(folder / "watch"), args.debounce or DEBOUNCE, on_indexed=lambda r: _show(r, True))
        query.awaitTermination()
        return 0
    _show(out, args.json)
    return code


if __name__ == "__main__":
    sys.exit(main())
