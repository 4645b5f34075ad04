"""Every registered query of the library proper against its SQL on the smallest tables."""

import pytest
from conftest import DATA
from oracle import spark_rows, sql_rows

from joblattice.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(SQL[name], DATA)


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
