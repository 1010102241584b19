"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables")
def test_the_flagship_query_runs(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns == ["mk", "player_1", "player_2", "h2h_count", "h2h_balance"]
