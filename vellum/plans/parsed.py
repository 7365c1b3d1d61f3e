"""Markdown texts to parsed documents: one nested row each. The only Python stage of an index run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, stable_id
from ..sources import markdown

_S, _I = pa.string(), pa.int32()
_STRINGS = pa.list_(_S)
_FRONT = pa.struct([*((n, _S) for n in ("id", "title", "status", "type", "trust_tier")), *((n, _STRINGS) for n in ("tags", "defines", "depends_on", "implements", "supersedes", "deprecated_by", "source_refs"))])
_PARSED = pa.schema(
    [
        ("path", _S),
        ("hash", _S),
        ("error", _S),
        ("body", _S),
        ("body_line_offset", _I),
        ("front", _FRONT),
        ("diagnostics", pa.list_(pa.struct([("code", _S), ("message", _S), ("line", _I), ("field", _S), ("expected", _S), ("actual", _S)]))),
        ("first_h1", _S),
        ("sections", pa.list_(pa.struct([("heading", _S), ("level", _I), ("start_line", _I), ("end_line", _I), ("content", _S)]))),
        ("md_links", pa.list_(pa.struct([("text", _S), ("url", _S), ("title", _S), ("line", _I)]))),
        ("wiki_links", pa.list_(pa.struct([("raw", _S), ("target", _S), ("anchor", _S), ("alias", _S), ("line", _I)]))),
        ("code", pa.list_(pa.struct([("language", _S), ("value", _S), ("line", _I), ("inline", pa.bool_())]))),
    ]
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "hash")), strict=True):
            row = {"path": path, "hash": digest}
            try:
                row |= markdown.parse(text or "")
            except markdown.BudgetError as error:
                row["error"] = str(error)
            rows.append(row)
        yield from pa.Table.from_pylist(rows, schema=_PARSED).to_batches()


def parse_documents(files: DataFrame) -> DataFrame:
    """files (path, text) as parsed documents, with id and title. A document over a budget has an error and nothing else."""
    from pyspark.sql.pandas.types import from_arrow_schema

    raw = files.select("path", "text", content_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    parsed = raw.mapInArrow(_run, from_arrow_schema(_PARSED))
    base = F.element_at(F.split("path", "/"), -1)
    return parsed.withColumns(
        {
            "id": stable_id("document", F.coalesce("front.id", F.lower("path"))),
            "title": F.coalesce("front.title", "first_h1", F.regexp_replace(base, r"(?<=.)\.[^.]*\z", "")),
            "base": base,
        }
    )
