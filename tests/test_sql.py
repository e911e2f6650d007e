"""Every query that has SQL gives its rows."""

from __future__ import annotations

import pytest

from serieslab import catalogue
from tests.against_sql import same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
