from __future__ import annotations

import importlib
import sys

import __spark_entry__
import pytest


def test_host_queries_without_a_library_of_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("hostlake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning, match="without corpus operators"):
        assert len(importlib.reload(__spark_entry__).queries()) > 100
    with pytest.warns(UserWarning):
        assert __spark_entry__.oracle_sql()
