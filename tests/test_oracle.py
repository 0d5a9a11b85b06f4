"""Every core query against its SQL on the smallest tables."""

import pytest
from oracle import differences

from redsift.plans import catalog, dataset, experiments, problems

QUERIES = problems.QUERIES | catalog.QUERIES | dataset.QUERIES | experiments.QUERIES
SQL = problems.SQL | catalog.SQL | dataset.SQL | experiments.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert differences(QUERIES[name](spark, data), SQL[name], data) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry_without_llm(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_llm", None)
    assert set(e.queries()) == set(QUERIES)
    assert e.entry(spark).count() > 0
