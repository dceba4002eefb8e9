"""The queries of this package that have SQL against DuckDB on the smallest data, and the others for being there."""

import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(D), reason="no test data")
def test_queries_equal_sql(spark):
    import selfcheck
    from spandrel.llm import oracle

    assert selfcheck.main(D, *oracle.oracle_sql()) == 0


def test_registered():
    import __spark_entry__ as e
    from spandrel.llm import oracle, queries

    assert set(queries.queries()) <= set(e.queries()) and set(oracle.oracle_sql()) <= set(queries.queries())
