"""Every registered query against its SQL twin."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, limited, rows
from conftest import SF

# random draws have no SQL twin; they are tested on their own
ROWS_ONLY = {"sample_restore_random"}


def own(names) -> list[str]:
    """Queries of the reference's operators; those of stowcheck.llm have tests of their own."""
    return sorted(n for n in names if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_all_queries_have_oracles():
    assert set(own(queries())) - set(oracle_sql()) == ROWS_ONLY


@pytest.mark.parametrize("name", own(oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    cursor = duck.execute(limited(oracle_sql()[name]))
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), names)


def test_entry(spark):
    assert entry(spark).count() == 4
