"""Entity patterns and the rules that read a kind from a name. Word boundaries are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cleanup_name, trimmed

_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: The grammar of names that count as entities in text.
ROUTE_PATH = r"/[A-Za-z0-9_./:{}-]+"
VERBS = "GET|POST|PUT|PATCH|DELETE"
TOOLS = "npm|pnpm|yarn|go|cargo|docker|kubectl|node|npx"
EXTENSIONS = "ts|tsx|js|jsx|md|mdx|json|yaml|yml|toml|rs|go|py|java|cs|sql"
_IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
DOTTED_KEY = r"[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,}"
CAPS_KEY = r"[A-Z][A-Z0-9_]{2,}"
ERROR_NAMES = r"[A-Z][A-Za-z0-9]+Error|ERR_[A-Z0-9_]+|[A-Z]+_[0-9]{3,}|[A-Z]+_[A-Z0-9_]*ERROR[A-Z0-9_]*"

API_ROUTE = rf"{_L}(?:{VERBS})\s+{ROUTE_PATH}|{ROUTE_PATH}"
ERROR_CODE = rf"{_L}(?:{ERROR_NAMES}){_R}"
CONFIG_KEY = rf"{_L}(?:{CAPS_KEY}|{DOTTED_KEY}){_R}"
FILE_PATH = rf"(?:^|\s)([A-Za-z0-9_@.-]+/[A-Za-z0-9_@./-]+\.(?:{EXTENSIONS}))"
COMMAND = rf"{_L}(?:{TOOLS})\s+[^\n`]+"
CALL = rf"{_L}{_IDENTIFIER}(?:\.{_IDENTIFIER})?\(\)"
SYMBOL = rf"{_L}[A-Z][A-Za-z0-9]+(?:\.{_IDENTIFIER})?{_R}"


def found(content: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), group)


def _distinct(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(names, trimmed), lambda n: n != ""))


def high_confidence_names(content: Column) -> Column:
    """Routes, error codes and configuration keys in prose."""
    return _distinct(F.concat(found(content, API_ROUTE), found(content, ERROR_CODE), found(content, CONFIG_KEY)))


def structured_names(content: Column, symbols: bool) -> Column:
    """All kinds of names in code or link text; symbols only where asked for."""
    parts = [found(content, p) for p in (API_ROUTE, ERROR_CODE, CONFIG_KEY, COMMAND, CALL)] + [found(content, FILE_PATH, 1)]
    return _distinct(F.concat(*parts, *([found(content, SYMBOL)] if symbols else [])))


def declared_names(content: Column) -> Column:
    """Names of a list of definitions: code spans of bullets, then `- name:` bullets."""
    return _distinct(F.concat(found(content, r"[-*]\s+`([^`]+)`", 1), found(content, r"(?m)^[-*]\s+([A-Za-z0-9_.:/-]+)\s*:", 1)))


def declares(heading: Column) -> Column:
    return F.lower(trimmed(heading)).rlike(r"^(?:defines?|definitions?|定义)\z")


def looks_like_entity(value: Column) -> Column:
    name = cleanup_name(value)
    whole = rf"^{ROUTE_PATH}\z|^(?:{VERBS})\s+/|^[A-Z][A-Za-z0-9]+(?:\.{_IDENTIFIER})?\z|^{CAPS_KEY}\z|^{DOTTED_KEY}\z"
    return (name != "") & name.rlike(whole)


def infer_kind(name: Column) -> Column:
    """The kind of a name; the first rule that holds decides."""
    n = trimmed(name)
    rules = [
        (rf"^(?:{VERBS})\s+/|^/", "api_route"),
        (FILE_PATH, "file_path"),
        (rf"^(?:{TOOLS})\s+", "command"),
        (ERROR_CODE, "error_code"),
        (rf"^{CAPS_KEY}\z|^{DOTTED_KEY}\z", "config_key"),
        (r"^@?[a-z0-9_.-]+/[a-z0-9_.-]+\z", "package"),
        (r"(?i)^ADR-?[0-9]+\z", "decision"),
    ]
    kind = F.lit("symbol")
    for pattern, value in reversed(rules):
        kind = F.when(n.rlike(pattern), F.lit(value)).otherwise(kind)
    return kind
