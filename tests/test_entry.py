import importlib
import os
import sys

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_llm_subpackage(monkeypatch):
    """The entry must load, with the other queries, where that subpackage is gone."""
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    import tidemark

    monkeypatch.delattr(tidemark, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "daily_panel" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f)).read(), f


def test_flagship(spark):
    import __spark_entry__

    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    assert __spark_entry__.entry(spark).count() > 0


def _norm(df):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 5) + 0.0 if isinstance(v, int | float) else str(v)

    return sorted(map(repr, (tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))))


def _names():
    from tidemark import plans, registry  # noqa: F401

    return sorted(registry.QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, name):
    from tidemark import registry

    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        return
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)
