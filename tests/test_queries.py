"""Every registered query against its check SQL on the smallest tables."""

import oracle
import pytest

from wareloom.plans import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return oracle.check_engine(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    if name in CHECKS:
        assert oracle.differences(df, engine, CHECKS[name]) == ""
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
