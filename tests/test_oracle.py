"""Every registered query against its SQL oracle on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tests.helpers import table
from tidemark.registry.base import TABLES

QUERIES, ORACLES = entry_mod.queries(), entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == table(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry_mod.entry(spark).count() > 0
