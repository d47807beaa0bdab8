"""Every registered query outside the training-data subpackage against its SQL, at the smallest scale."""

import pytest

from sparkolyte.plans import catalogue

from .comparing import duck, of_duck, of_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, connection, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql()[name]
    assert sorted(df.columns) == sorted(connection.sql(sql).columns)
    assert of_spark(df) == of_duck(connection, sql)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


WITHOUT_SQL = sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()))
DEAR = {"cars_select", "icc_cars_select", "mi_select", "discovery_ranking"}


@pytest.mark.parametrize("name", [n for n in WITHOUT_SQL if n not in DEAR])
def test_queries_without_sql_give_sound_rows(spark, name):
    """Their operators are held against plain versions elsewhere; here every row has numbers where numbers belong."""
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    assert rows, name
    numbers = [n for n, t in df.dtypes if t == "double"]
    assert all(v is None or abs(v) < float("inf") for r in rows for v in (r[n] for n in numbers))
    assert all(any(r[n] is not None for r in rows) for n in numbers)


def test_entry(spark):
    import __spark_entry__

    assert "channel" in __spark_entry__.entry(spark).columns
