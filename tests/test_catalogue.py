"""Every catalogue entry against its SQL statement, on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

from tests.conftest import SMALL
from turnera.plans import queries as catalogue

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")


def load():
    spec = importlib.util.spec_from_file_location("spark_entry", ENTRY)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


driver = load()
# The subpackage for training data, which may be absent, has its own tests.
QUERIES = {name: query for name, query in driver.queries().items() if name in catalogue.CATALOGUE}
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "customer", "documents"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    rows = frame.collect()
    assert rows
    if name in SQL:
        answer = duck.execute(SQL[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == sorted(frame.columns)
        expected = sorted((tuple(map(dict(zip(names, row)).get, frame.columns)) for row in answer.fetchall()), key=repr)
        assert sorted(map(tuple, rows), key=repr) == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
