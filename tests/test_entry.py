"""The driver contract."""

import importlib
import sys

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o", "c"] and df.count() > 0


def test_without_training_data_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    module = importlib.reload(__spark_entry__)
    assert module.queries() and not [n for n in module.queries() if n.startswith("op") and n[2].isdigit()]
    assert set(module.oracle_sql()) <= set(module.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
