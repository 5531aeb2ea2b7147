"""Queries against DuckDB on the small tables, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__
from spanloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("tokenize_terms", "fixed_chunks", "sentence_spans", "bm25_search", "dense_topk", "exact_dedup_corpus", "locate_quotes", "rrf_hybrid", "bootstrap_ci", "kappa", "parse_citations", "failure_pivot", "stale_documents", "index_consistency", "cost_by_window")


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    return None if value is None or value != value else round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)[:64]


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)) if len(frame) else []


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = rows(registry.queries()[name](spark, SF).toPandas()), rows(con.sql(registry.oracle_sql()[name]).df())
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert got[0] == want[0] and sorted(got[1], key=key) == sorted(want[1], key=key)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
