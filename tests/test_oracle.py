"""Every registered query with an oracle equals DuckDB on the sf0.001 tables.

(The driver repeats this at sf0.01; ``python -m tests.oracle_harness`` runs
that locally.)"""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare

NAMES = sorted(E.oracle_sql())


def test_contract_shapes():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 91


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8 and set(df.columns) >= {"column_name", "count", "mean", "p50"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck_small, name):
    info = compare(spark, duck_small, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert info["schema"], info
    assert info["count"], info
    assert info["values"], info
