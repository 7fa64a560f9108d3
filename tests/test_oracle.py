"""Every query of the core that SQL can express, against DuckDB; the others must run and give rows of one schema."""

import pytest

from tests import oracle
from weftline.plans import evidence, graphs, parts, places, problems, relational, remaining, scalar, sequences, streams, summaries, worlds

MODULES = [problems, scalar, relational, graphs, streams, worlds, remaining, places, summaries, parts, sequences, evidence]
PAIRS = [(n, f, m.SQL.get(n)) for m in MODULES for n, f in m.QUERIES.items()]
pytestmark = pytest.mark.skipif(not oracle.FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize(("name", "query", "sql"), PAIRS, ids=[p[0] for p in PAIRS])
def test_query(spark, con, name, query, sql):
    if sql:
        oracle.same(spark, con, query, sql)
    else:
        df = query(spark, str(oracle.FOLDER))
        assert len(set(df.columns)) == len(df.columns)
        assert df.count() >= 0
