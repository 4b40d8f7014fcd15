"""Every query with SQL against DuckDB, the others for rows, over the smallest tables."""

import pytest

from cuewright.plans.oracles import ORACLE_SQL
from cuewright.plans.queries import QUERIES

from .compare import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    mine, other = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_without_corpus_operators():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["merge_metadata", "decode_text", "write_subtitles", "step_status_table", "playout_timeline"])
def test_on_a_session_without_settings(spark, con, name):
    plain = spark.newSession()
    assert plain.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    assert rows(QUERIES[name](plain, SF).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())
