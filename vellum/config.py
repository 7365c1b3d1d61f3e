"""Engine configuration: defaults, hard limits, and merging of partial settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

#: Fixed values of the data model.
DOCUMENT_KINDS = ("spec", "design", "adr", "api", "runbook", "incident", "meeting", "guide", "memory", "other")
TRUST_TIERS = ("authored", "generated", "validated", "external", "untrusted")
ENTITY_KINDS = ("symbol", "api_route", "error_code", "config_key", "file_path", "command", "package", "concept", "decision")
EDGE_WEIGHTS = {
    "CONTAINS": 5.0,
    "DEFINES": 10.0,
    "REFERENCES": 4.0,
    "DEPENDS_ON": 9.0,
    "LINKS_TO": 7.0,
    "IMPLEMENTS": 8.0,
    "REFERENCES_SOURCE": 6.0,
    "SUPERSEDES": 8.0,
    "DEPRECATED_BY": 8.0,
    "SAME_AS": 7.0,
    "RELATED_TO": 2.0,
    "CONTRADICTS": 6.0,
}
#: Folders that are left out.
EXCLUDED = (
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/coverage/**",
    "**/.git/**",
    "**/.next/**",
    "**/.turbo/**",
    "**/.cache/**",
    "temp/**",
    "**/temp/**",
    "tmp/**",
    "**/tmp/**",
)


class Limits:
    """Hard caps; a setting beyond one is an error."""

    FILE_BYTES = 10 * 1024 * 1024
    SEARCH_LIMIT = 100
    DEPTH = 12
    CONTEXT_CHARS = 200_000
    FREQUENCY_THRESHOLD = 100_000
    DIMENSIONS = 4096
    AST_NODES = 10_000
    AST_DEPTH = 256
    JSON_BYTES = 50 * 1024 * 1024
    JSON_DEPTH = 128
    JSON_NODES = 1_000_000
    JSON_ARRAY = 1_000_000


class ConfigError(ValueError):
    """A setting is of the wrong kind or out of range."""


#: The defaults.
@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ("docs/**/*.md", "**/*.md")
    exclude: tuple[str, ...] = EXCLUDED
    parse_mdx: bool = False
    follow_gitignore: bool = True
    max_file_bytes: int = 512 * 1024
    search_limit: int = 8
    max_depth: int = 2
    max_context_chars: int = 28_000
    high_frequency_threshold: int = 50
    enabled_kinds: tuple[str, ...] = field(default_factory=lambda: tuple(k for k in ENTITY_KINDS if k != "decision"))
    stop_entities: tuple[str, ...] = ("Config", "Error", "Service", "API", "User", "Data")
    embedding_enabled: bool = False
    embedding_provider: str = "local-hash"
    embedding_model: str = "vellum-local-hash-v1"
    embedding_dimensions: int = 128

    @property
    def embeds(self) -> bool:
        return self.embedding_enabled and self.embedding_provider == "local-hash"


#: Setting -> the largest value it may have.
_BOUNDED = {
    "max_file_bytes": Limits.FILE_BYTES,
    "search_limit": Limits.SEARCH_LIMIT,
    "max_depth": Limits.DEPTH,
    "max_context_chars": Limits.CONTEXT_CHARS,
    "high_frequency_threshold": Limits.FREQUENCY_THRESHOLD,
    "embedding_dimensions": Limits.DIMENSIONS,
}


def merge(base: Config, override: Mapping[str, Any]) -> Config:
    """base with the settings of override; an absent or empty list keeps the base's, a bad number is an error."""
    changes: dict[str, Any] = {}
    for name, value in override.items():
        if value is None:
            continue
        if not hasattr(base, name):
            raise ConfigError(f"unknown setting {name}")
        was = getattr(base, name)
        if name in _BOUNDED:
            if isinstance(value, bool) or not isinstance(value, int) or not 0 < value <= _BOUNDED[name]:
                raise ConfigError(f"{name} must be an integer from 1 to {_BOUNDED[name]}")
            changes[name] = value
        elif isinstance(was, tuple):
            if not isinstance(value, (list, tuple)):
                continue
            kept = tuple(v.strip() for v in value if isinstance(v, str) and v.strip())
            if kept:
                changes[name] = kept
        elif isinstance(value, type(was)):
            changes[name] = value
    return replace(base, **changes)
