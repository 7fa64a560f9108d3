"""The two ways of graph operators on a larger graph, tiles in blocks, and sources that end ways."""

import random

from weftline.operators import graph, raster


def test_both_ways_on_a_wide_and_deep_graph(spark):
    """Chains hundreds deep and a broad tree with peers: the arrays and the joins give the same rows."""
    rng, rows = random.Random(2), []
    for k in range(1, 4000):
        rows.append((len(rows), rng.randrange(k), k, -1))
    for _ in range(3000):
        a, b = rng.randrange(4000), rng.randrange(4000)
        rows.append((len(rows), a, b, 0))
    for k in range(4000, 4060):
        rows.append((len(rows), k, k + 1, -1))
    e = spark.createDataFrame(rows, "eid long, a long, b long, rel int")
    for f in (graph.customer_cones, graph.coreness):
        x, y = ({tuple(r) for r in f(e, kernel=w).collect()} for w in (True, False))
        assert x == y
    roots = spark.createDataFrame([(0, 5), (1, 4030), (2, 77)], "tree int, node long")
    x, y = ({tuple(r) for r in graph.sample_trees(e, roots, kernel=w).collect()} for w in (True, False))
    assert x == y


def test_blocks_of_a_tile_add_up(spark):
    rng = random.Random(3)
    links = spark.createDataFrame([(*(rng.random() for _ in range(4)), 1.0, 0.5, 0.2) for _ in range(300)], "ax double, ay double, bx double, by double, r double, g double, b double")
    whole = {(r.z, r.x, r.y): (r.lit, bytes(r.png)) for r in raster.render_tiles(links, [0, 1], 64).collect()}
    parts = {(r.z, r.x, r.y): (r.lit, bytes(r.png)) for r in raster.render_tiles(links, [0, 1], 64, block=20).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 5
    assert all(abs(whole[k][0] - parts[k][0]) <= 1 for k in whole)


def test_ways_never_lead_through_another_source(spark):
    e = spark.createDataFrame([(1, 1, 2, 0, 1.0), (2, 2, 3, 0, 1.0), (3, 1, 3, 0, 9.0)], "eid long, a long, b long, rel int, cost double")
    src = spark.createDataFrame([(1, 0.0), (2, 5.0)], "node long, start double")
    assert {tuple(r) for r in graph.shortest_costs(e, src, "cost").collect()} == {(1, 0.0, 1), (2, 5.0, 2), (3, 6.0, 2)}
