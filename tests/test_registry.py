"""Every registered query against its oracle on the small tables."""

import math
import os

import duckdb
import pytest

from wayline.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, data, name):
    found = QUERIES[name](spark, data)
    names = sorted(found.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in found.collect())
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == names
    at = [wanted.columns.index(c) for c in names]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
