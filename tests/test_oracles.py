"""Every query against its DuckDB oracle, on the smallest tables."""

import duckdb
import pytest

from vigilframe.plans import finding_oracles, finding_queries, oracles, queries, raw_queries
from vigilframe.plans.queries import entry_funnel

QUERIES = {**queries.QUERIES, **finding_queries.QUERIES, **raw_queries.QUERIES}
SQL = {**oracles.SQL, **finding_oracles.SQL, **raw_queries.SQL}


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("customer", "part", "supplier", "orders", "lineitem", "events", "pages"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark, sf_dir):
    assert entry_funnel(spark, sf_dir).count() == 5
