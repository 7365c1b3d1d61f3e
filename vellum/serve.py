"""Five read-only tools as plain functions and over JSON-RPC lines."""

from __future__ import annotations

import json
import sys
from pathlib import Path
from typing import Any, TextIO

from .config import Limits
from .engine import Engine, load_config

LINE_BYTES = 1024 * 1024
_TEXT = {"type": "string", "minLength": 1, "maxLength": 4000}
#: Tool -> its arguments; objects are closed.
TOOLS: dict[str, dict[str, Any]] = {
    "search": {"required": ["query"], "properties": {"query": _TEXT, "limit": {"type": "integer", "minimum": 1, "maximum": Limits.SEARCH_LIMIT}, "mode": {"enum": ["auto", "keyword", "semantic"]}, "project": _TEXT}},
    "context": {"required": ["query"], "properties": {"query": _TEXT, "known_files": {"type": "array", "maxItems": 50}, "max_chars": {"type": "integer", "minimum": 1, "maximum": Limits.CONTEXT_CHARS}, "debug": {"type": "boolean"}, "project": _TEXT}},
    "node": {"required": ["name"], "properties": {"name": _TEXT, "project": _TEXT}},
    "trace": {"required": ["start", "target"], "properties": {"start": _TEXT, "target": _TEXT, "depth": {"type": "integer", "minimum": 1, "maximum": Limits.DEPTH}, "project": _TEXT}},
    "status": {"required": [], "properties": {"storage": {"type": "boolean"}, "freshness": {"type": "boolean"}, "project": _TEXT}},
}


class ToolError(ValueError):
    """Arguments that a tool doesn't take."""


def check_arguments(tool: str, arguments: dict[str, Any]) -> None:
    if tool not in TOOLS:
        raise ToolError(f"unknown tool {tool}")
    schema = TOOLS[tool]
    for name in schema["required"]:
        if name not in arguments:
            raise ToolError(f"{name} is missing")
    for name, value in arguments.items():
        rule = schema["properties"].get(name)
        if rule is None:
            raise ToolError(f"unknown argument {name}")
        kind = rule.get("type")
        fits = (
            value in rule["enum"] if "enum" in rule
            else isinstance(value, str) and rule["minLength"] <= len(value) <= rule["maxLength"] if kind == "string"
            else isinstance(value, int) and not isinstance(value, bool) and rule["minimum"] <= value <= rule["maximum"] if kind == "integer"
            else isinstance(value, bool) if kind == "boolean"
            else isinstance(value, list) and len(value) <= rule["maxItems"] and all(isinstance(x, str) for x in value)
        )
        if not fits:
            raise ToolError(f"bad value for {name}")


def call(engine: Engine, tool: str, arguments: dict[str, Any]) -> Any:
    check_arguments(tool, arguments)
    engine = project_engine(engine, arguments["project"]) if arguments.get("project") else engine
    if tool == "search":
        return [r.asDict(True) for r in engine.agent_search(arguments["query"], arguments.get("limit"), arguments.get("mode", "auto")).collect()]
    if tool == "context":
        return engine.agent_context(arguments["query"], arguments.get("known_files", ()), arguments.get("debug", False), arguments.get("max_chars"))
    if tool == "node":
        return engine.node(arguments["name"])
    if tool == "trace":
        return engine.trace(arguments["start"], arguments["target"], arguments.get("depth", 6))
    return engine.status(arguments.get("storage", False), arguments.get("freshness", False))


def respond(engine: Engine, line: str) -> dict[str, Any] | None:
    """The answer to one JSON-RPC line; None for a notification."""
    if len(line.encode()) > LINE_BYTES:
        return _error(None, -32600, "line is too long")
    try:
        message = json.loads(line)
    except ValueError:
        return _error(None, -32700, "not JSON")
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return _error(message.get("id") if isinstance(message, dict) else None, -32600, "not a request")
    method, key, params = message["method"], message.get("id"), message.get("params") or {}
    if key is None:
        return None
    if method == "initialize":
        return _result(key, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "vellum", "version": "1"}})
    if method == "ping":
        return _result(key, {})
    if method == "tools/list":
        return _result(key, {"tools": [{"name": n, "inputSchema": {"type": "object", "additionalProperties": False, **s}} for n, s in TOOLS.items()]})
    if method == "tools/call":
        try:
            value = call(engine, params.get("name", ""), params.get("arguments") or {})
        except ToolError as error:
            return _error(key, -32602, str(error))
        except FileNotFoundError as error:
            return _result(key, {"isError": True, "content": [{"type": "text", "text": str(error)}]})
        return _result(key, {"content": [{"type": "text", "text": json.dumps(value, default=str)}]})
    return _error(key, -32601, f"unknown method {method}")


def _result(key: Any, value: Any) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": key, "result": value}


def _error(key: Any, code: int, message: str) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": message}}


def serve(engine: Engine, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if line.strip() and (answer := respond(engine, line)) is not None:
            print(json.dumps(answer), file=out, flush=True)


def project_engine(engine: Engine, path: str) -> Engine:
    """The engine of a project folder, which must lie under the served root; the root itself is the engine's own."""
    root = Path(engine.root).resolve()
    folder = Path(root, path).resolve()
    if not folder.is_relative_to(root) or not folder.is_dir():
        raise ToolError(f"project must be a folder inside {root}")
    if folder == root:
        return engine
    return Engine(engine.spark, str(folder), str(folder / ".vellum" / "graph"), load_config(str(folder / ".vellum" / "config.json")))
