"""Core numbers of graphs that are cut into blocks: long chains, and nodes whose neighbours lie in other blocks, against plain peeling."""

import random

import pytest

from weftline.operators import graph


def plain_cores(links):
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    degree, core, k = {n: len(x) for n, x in near.items()}, {}, 0
    while degree:
        n = min(degree, key=degree.get)
        k = max(k, degree.pop(n))
        core[n] = k
        for other in near[n]:
            if other in degree:
                degree[other] -= 1
    return core


def strip(n):
    """Each node linked with the next four: it comes off from its ends, a node at a time."""
    return [(i, i + k) for i in range(n) for k in (1, 2, 3, 4) if i + k < n] + [(10_000, i) for i in range(n)]


def frame(spark, links):
    return spark.createDataFrame([(i, a, b, 0) for i, (a, b) in enumerate(links)], "eid long, a long, b long, rel int")


def test_a_long_strip_takes_few_rounds(spark):
    links = strip(600)
    assert {tuple(r) for r in graph.coreness(frame(spark, links), 4, kernel=False).collect()} == set(plain_cores(links).items())


@pytest.mark.parametrize("block", [150, 700])
def test_blocks_agree_with_plain_peeling(spark, block):
    """Several blocks, parallel links, a hub over more than a block, and links to itself, which don't count."""
    rng = random.Random(block)
    links = strip(60) + [(rng.randrange(200), rng.randrange(200)) for _ in range(400)] + [(300, i) for i in range(190)] + [(7, 8)] * 5
    rows = {tuple(r) for r in graph.coreness(frame(spark, [*links, (9, 9)]), kernel=False, block=block).collect()}
    assert rows == set(plain_cores([x for x in links if x[0] != x[1]]).items())


def test_no_links(spark):
    assert graph.coreness(frame(spark, [(1, 1)]), kernel=False).collect() == []
