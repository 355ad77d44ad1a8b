import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("name", ["p6_found", "p7_found"])
def test_query_gives_what_its_sql_gives(against_sql, name):
    assert against_sql(name) > 0


def test_a_missing_module_is_not_swallowed(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "kernelweave.llm.queries", None)
    monkeypatch.delattr("kernelweave.llm.queries", raising=False)
    with pytest.raises(ImportError):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)
    assert {"p6_found", "p7_found"} <= set(queries())
