"""Loops of the graph operators end when nothing changes, or say that they didn't."""

import pytest

from weftline.operators import graph


def test_a_bound_that_is_too_small_is_an_error(spark):
    n = 12
    e = spark.createDataFrame([(i, i, i + 1, -1, 1.0) for i in range(n)], "eid long, a long, b long, rel int, cost double").cache()
    start = spark.createDataFrame([(0, 0.0)], "node long, start double")
    for run in (
        lambda k: graph.customer_cones(e, k, kernel=False),
        lambda k: graph.coreness(e, k, kernel=False),
        lambda k: graph.components(e, rounds=k),
        lambda k: graph.shortest_costs(e, start, "cost", k),
        lambda k: graph.sample_trees(e, spark.createDataFrame([(0, 0)], "tree int, node long"), k, kernel=False),
        lambda k: graph.routes(e, spark.createDataFrame([(0, n)], "src long, dst long"), k, kernel=False),
    ):
        with pytest.raises(RuntimeError, match="not settled"):
            run(1)
    assert graph.shortest_costs(e, start, "cost").agg({"dist": "max"}).first()[0] == n


def test_costs_below_zero_are_refused(spark):
    e = spark.createDataFrame([(0, 0, 1, 0, -1.0)], "eid long, a long, b long, rel int, cost double")
    with pytest.raises(ValueError, match="below zero"):
        graph.shortest_costs(e, spark.createDataFrame([(0, 0.0)], "node long, start double"), "cost")
