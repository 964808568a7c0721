"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as registry
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    own = set(registry.queries())
    assert set(SQL) <= own
    if registry.text_queries is not None:
        own -= set(registry.text_queries.QUERIES) - set(registry.text_queries.ORACLE_SQL)
    assert own == set(SQL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, con, key):
    df = registry.queries()[key](spark, SF_DIR)
    assert differences(df, con, SQL[key]) == []
    assert df.limit(1).count() == 1


def test_entry_runs(spark):
    rows = connect("/root/testdata/sf0.001").sql(SQL["refill_predictions"]).fetchall()
    assert registry.entry(spark).count() == len(rows) > 0


def test_all_urgency_classes_occur(con):
    found = con.sql(f"SELECT DISTINCT Urgency FROM ({SQL['refill_predictions']})").fetchall()
    assert len(found) == 6
