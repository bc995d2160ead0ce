"""Every query on the smallest tables, against DuckDB where SQL can express it."""

import pytest

from checks.compare import differences, duck
from checks.oracle import ORACLE
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert differences(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_every_expected_result_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())
