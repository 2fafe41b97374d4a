"""Every query with SQL against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pytest

from colloquy.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def normal(rows):
    plain = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, DIR)
    theirs = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    picked = theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert normal(tuple(r) for r in ours.select(*columns).collect()) == normal(picked)
