"""The driver contract."""

from __future__ import annotations

import importlib
import os
import sys

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"


def test_names_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_entry_works_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "vellum.llm", None)
    for name in [m for m in sys.modules if m.startswith("vellum.llm.") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    try:
        entry = importlib.reload(__spark_entry__)
        assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and "fts_bm25_topk" in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables")
def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: -r.score)
