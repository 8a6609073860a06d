"""Every core query with an oracle gives what SQL gives on the smallest test tables."""

import os

import pytest

from quillspark.plans import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_oracles_have_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    r = sql.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(names, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_oracle_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).limit(5).count() > 0
