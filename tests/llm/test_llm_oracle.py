"""The llm queries that SQL can express, against DuckDB; the others must run."""

import pytest

from tests import oracle
from weftline.llm import queries

PAIRS = [(n, f, queries.SQL.get(n)) for n, f in queries.QUERIES.items()]
pytestmark = pytest.mark.skipif(not oracle.FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize(("name", "query", "sql"), PAIRS, ids=[p[0] for p in PAIRS])
def test_query(spark, name, query, sql):
    if sql:
        oracle.same(spark, oracle.connect(), query, sql)
    else:
        assert query(spark, str(oracle.FOLDER)).count() >= 0
