"""Every registered query against its comparison SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidefolio.plans.registry import ORACLES as REGISTERED_SQL, QUERIES as REGISTERED

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(REGISTERED) == set(REGISTERED_SQL)
    assert set(REGISTERED) <= set(QUERIES) and set(REGISTERED_SQL) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = _ordered(tuple(r[c] for c in cols) for r in df.collect())
    answer = duck.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == cols
    places = [names.index(c) for c in cols]
    want = _ordered(tuple(r[i] for i in places) for r in answer.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
