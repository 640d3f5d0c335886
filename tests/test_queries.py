"""Every query of the engine against its DuckDB counterpart at sf0.01."""

import duckdb
import pytest

from ordina import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return columns, sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, FOLDER).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_flagship(spark):
    found = queries.flagship(spark, "/root/testdata/sf0.001").toPandas()
    assert len(found) == 1500 and found["o_orderkey"].is_monotonic_increasing
