import importlib
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def same(spark, name, query, sql):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, expected = query(spark, SF).toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    text = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert text(got) == text(expected), name


def test_queries_against_sql(spark):
    from tidewright.plans import catalog, running  # noqa: F401

    for name, sql in catalog.ORACLE_SQL.items():
        same(spark, name, catalog.QUERIES[name], sql)


def test_import_without_training_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert "page_rows" in e.queries() and not any(q.startswith("op") for q in e.queries())
    sys.modules.pop("__spark_entry__", None)


@pytest.mark.parametrize("name", ["map_widen"])
def test_schema_is_stable(spark, name):
    from tidewright.plans import catalog

    assert catalog.QUERIES[name](spark, SF).columns == ["seq", "block_number", "kind", "purchase_value", "click_user"]
