"""Every query that has SQL gives the rows that DuckDB gives."""

import __spark_entry__
import oracle
import pytest

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if n in SQL and not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert oracle.compare(spark, duck, QUERIES[name], SQL[name], sf_dir) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_text():
    assert all(isinstance(sql, str) for sql in SQL.values())
