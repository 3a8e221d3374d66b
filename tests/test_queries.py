from __future__ import annotations

import pytest

from lakeweave.plans import registry

from .compare import connection, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, duck.sql(SQL[name]))
    else:
        assert df.columns
        df.collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_imports_without_the_corpus_subpackage(monkeypatch):
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name.startswith("lakeweave.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(__spark_entry__.queries()) == set(QUERIES)
