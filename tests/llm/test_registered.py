"""The registered queries: rows against their SQL, and the entry file with and without this subpackage."""

import importlib
import sys

import pytest

from checks.compare import connect, difference
from fenceline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, name, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    result = connect(sf_dir).execute(ORACLES[name])
    assert difference(frame.columns, [tuple(r) for r in frame.collect()], [c[0] for c in result.description], result.fetchall()) is None


def test_one_query_per_operator():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_entry_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # an import of it fails
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(name.startswith("op1_") or name == "pipeline" for name in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
