"""What the driver calls: with the subpackage llm, without it, and with a fault in it."""

from __future__ import annotations

import sys
import types

import pytest

import __spark_entry__ as entry
from quern.queries import ORACLE_SQL, QUERIES


def test_core_queries_stand_alone(monkeypatch):
    monkeypatch.setitem(sys.modules, "quern.llm", None)
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quern.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLE_SQL


def test_a_fault_is_no_absence(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", types.ModuleType("corpus_pipeline"))
    monkeypatch.setitem(sys.modules, "quern.llm", types.ModuleType("quern.llm"))
    broken = types.ModuleType("quern.llm.queries")
    monkeypatch.setitem(sys.modules, "quern.llm.queries", broken)  # it has no QUERIES
    with pytest.raises(ImportError):
        entry.queries()


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(k.split("_")[0].islower() for k in entry.queries())
