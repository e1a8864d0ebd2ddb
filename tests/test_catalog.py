"""The registered queries: all of them run, and those with SQL give its rows."""

import datetime
import sys

import pytest

import __spark_entry__ as entry
from quarry.plans import every as catalog


def norm(value):
    if isinstance(value, float):
        return round(value + 0.0, 4)
    return value.isoformat() if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert name in {"bit_matrix_rank", "bit_spectral", "bit_linear_complexity", "bit_verdicts"}
        return
    result = duck.execute(catalog.ORACLES[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    wanted = [tuple(norm(r[found.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quarry.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quarry.llm", None)
    monkeypatch.setitem(sys.modules, "quarry.llm.queries", None)
    assert set(entry.queries()) == set(catalog.QUERIES)
