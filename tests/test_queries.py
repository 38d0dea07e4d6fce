"""Every registered query against its SQL twin on the smallest data."""

import math
import os

import duckdb
import pytest

from webmill.plans.oracle import ORACLES
from webmill.plans.registry import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = table(frame.columns, frame.collect())
    if name not in ORACLES:
        assert got[1]
        return
    cursor = duck.execute(ORACLES[name])
    assert got == table([c[0] for c in cursor.description], cursor.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
