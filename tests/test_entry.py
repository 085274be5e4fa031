"""The driver's contract, with and without the corpus operators."""

import importlib
import sys

import __spark_entry__ as entry
from trackloom.plans import registry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(registry.queries()) <= set(q) and set(o) <= set(q)
    assert entry.entry(spark).count() > 0


def test_import_without_the_corpus_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("trackloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(registry.queries())
        assert set(alone.oracle_sql()) == set(registry.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
