"""The registry, and each graph query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from motifold.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET max_temp_directory_size='2GB'")
    for t in ("lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_registry():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: As many rows as the cliques of five are too many for the tests; they run on the orders of the first parts.
SMALL = {"cliques_4", "cliques_5", "clique_list_3", "clique_list_4", "fish", "tadpoles"}


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """A folder with the lines of some orders."""
    folder = tmp_path_factory.mktemp("few")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.sql(f"COPY (SELECT * FROM '{DATA}/{t}.parquet' {'WHERE l_orderkey % 6 = 0' if t == 'lineitem' else ''}) TO '{folder}/{t}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, few, name):
    data = DATA
    if name in SMALL:
        data, duck = few, duckdb.connect()
        for t in ("lineitem", "part"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{few}/{t}.parquet'")
    got = QUERIES[name](spark, data)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
