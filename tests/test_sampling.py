"""Roots of the sampling trees."""

from weftline.operators import graph
from weftline.plans import graphs


def test_roots_are_of_the_largest_component(spark):
    star = [(i, 0, i, 0) for i in range(1, 300)]
    pairs = [(1000 + i, 1000 + 2 * i, 1001 + 2 * i, 0) for i in range(100)]
    e = spark.createDataFrame(star + pairs, "eid long, a long, b long, rel int")
    roots = graphs.sample_roots(e).collect()
    assert sorted(r.tree for r in roots) == list(range(255))
    assert len({r.node for r in roots}) == 255 and all(r.node < 300 for r in roots)
    small = graphs.sample_roots(e.where("eid < 6 OR eid >= 1000")).collect()
    assert sorted(r.node for r in small) == [0, 1, 2, 3, 4, 5]


def test_query_ranks_by_all_trees(spark):
    from tests.oracle import FOLDER
    from weftline.plans import fixtures as fx

    d = str(FOLDER)
    e = fx.edges(spark, d)
    trees = graphs.sample_roots(e)
    got = {r.eid: r["rank"] for r in graphs.gr_sample_rank(spark, d).collect()}
    want = {r.eid: r["rank"] for r in graph.sample_trees(e, trees).collect()}
    n = trees.count()
    assert n == min(255, fx.nodes(spark, d).count()) and n > 16
    assert got == {k: want.get(k, n) for k in got} and max(want.values()) > 16
