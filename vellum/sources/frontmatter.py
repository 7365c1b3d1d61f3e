"""YAML front matter of a Markdown text: split, parse, normalise, diagnose."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..config import DOCUMENT_KINDS, TRUST_TIERS

TEXT_FIELDS = ("id", "title", "status")
LIST_FIELDS = ("tags", "defines", "depends_on", "implements", "supersedes", "deprecated_by", "source_refs")
_DELIMITER = re.compile(r"---[ \t]*\r?\n?\Z")


@dataclass
class FrontMatter:
    body: str
    line_offset: int = 0
    data: dict[str, Any] = field(default_factory=dict)
    diagnostics: list[dict[str, Any]] = field(default_factory=list)


def _issue(code: str, message: str, line: int, name: str | None = None, expected: str | None = None, actual: str | None = None) -> dict[str, Any]:
    return {"code": f"front_matter.{code}", "message": message, "line": line, "field": name, "expected": expected, "actual": actual}


def split(raw: str) -> FrontMatter:
    """The body after the closing delimiter, and what the mapping before it says."""
    text = raw.removeprefix("\ufeff")
    lines = text.split("\n")
    if not _DELIMITER.fullmatch(lines[0]):
        return FrontMatter(text)
    for n, line in enumerate(lines[1:], 1):
        if _DELIMITER.fullmatch(line):
            data, issues = _mapping("\n".join(lines[1:n]))
            return FrontMatter("\n".join(lines[n + 1 :]), n + 1, data, issues + diagnose(data, field_lines(lines[1:n])))
    return FrontMatter(text, diagnostics=[_issue("unclosed", "YAML front matter was opened but not closed.", 1)])


def _mapping(source: str) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    if not source.strip():
        return {}, []
    import yaml

    class PlainLoader(yaml.SafeLoader):
        """Dates stay text, and yes/no stay words, as in YAML 1.2."""

    PlainLoader.yaml_implicit_resolvers = {
        first: [(tag, pattern) for tag, pattern in rules if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    PlainLoader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    try:
        data = yaml.load(source, PlainLoader)
    except yaml.YAMLError as error:
        return {}, [_issue("invalid_yaml", str(error), 2)]
    if not isinstance(data, dict):
        return {}, [_issue("not_mapping", "YAML front matter must be a mapping.", 2)]
    return {str(k): v for k, v in data.items()}, []


def field_lines(lines: list[str]) -> dict[str, int]:
    found: dict[str, int] = {}
    for n, line in enumerate(lines, 2):
        if m := re.match(r"([A-Za-z0-9_-]+)\s*:", line):
            found.setdefault(m[1], n)
    return found


def text_field(value: Any) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def choice_field(value: Any, allowed: tuple[str, ...]) -> str | None:
    word = value.strip().lower() if isinstance(value, str) else None
    return word if word in allowed else None


def list_field(value: Any) -> list[str]:
    values = value if isinstance(value, list) else [value]
    return [v.strip() for v in values if isinstance(v, str) and v.strip()]


def _is_texts(value: Any) -> bool:
    return isinstance(value, str) or (isinstance(value, list) and all(isinstance(v, str) for v in value))


def diagnose(data: dict[str, Any], lines: dict[str, int]) -> list[dict[str, Any]]:
    rules = [(name, "non-empty string", lambda v: text_field(v) is not None) for name in TEXT_FIELDS]
    rules.append(("type", "known document kind string", lambda v: choice_field(v, DOCUMENT_KINDS) is not None))
    rules.append(("trust_tier", "known trust tier string", lambda v: choice_field(v, TRUST_TIERS) is not None))
    rules += [(name, "string or string array", _is_texts) for name in LIST_FIELDS]
    return [
        _issue("invalid_field", f"Front matter field '{name}' should be a {expected}.", lines.get(name, 2), name, expected, type(data[name]).__name__)
        for name, expected, holds in rules
        if name in data and not holds(data[name])
    ]


def normalise(data: dict[str, Any]) -> dict[str, Any]:
    front: dict[str, Any] = {name: text_field(data.get(name)) for name in TEXT_FIELDS}
    front["type"] = choice_field(data.get("type"), DOCUMENT_KINDS)
    front["trust_tier"] = choice_field(data.get("trust_tier"), TRUST_TIERS)
    front |= {name: list_field(data.get(name)) for name in LIST_FIELDS}
    return front
