"""Every query that has SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from velora.plans import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((plain(tuple(r)) for r in df.collect()), key=repr)
    q = duck.execute(catalog.ORACLES[name])
    cols = [c[0] for c in q.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert got == sorted((plain(tuple(r[i] for i in at)) for r in q.fetchall()), key=repr)


#: Queries without SQL; tests/test_queries_by_force.py and, for kid, tests/test_operators.py have plain versions of them.
BY_FORCE = {"chunk_merge", "chunks", "context_assembly", "fid", "kid", "lexicon_lookup", "pa_mpjpe", "page_clean", "prompt_grammar", "seq_scores", "template_fill"}


def test_every_query_has_sql_or_a_plain_version():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == BY_FORCE


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
