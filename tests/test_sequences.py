"""Ordered rows against plain walks, and the propagator's codes."""

import random

import numpy as np

from weftline.operators import orbit
from weftline.operators.sequences import circle_islands, densest_stretches, locate_along


def test_islands_on_a_circle(spark):
    angles = [350.0, 355.0, 2.0, 8.0, 100.0, 104.0, 109.0, 200.0]
    df = spark.createDataFrame([(1, a, i, "clash") for i, a in enumerate(angles)] + [(2, 5.0, 99, "clash")], "g int, a double, k int, x string")
    got = {}
    for r in circle_islands(df, "g", "a", "k", 20.0).collect():
        got.setdefault((r.g, r.island), []).append((r.pos, r.a))
    parts = sorted([a for _, a in sorted(v)] for v in got.values())
    assert parts == [[5.0], [100.0, 104.0, 109.0], [200.0], [350.0, 355.0, 2.0, 8.0]]
    assert circle_islands(df.where("g = 9"), "g", "a", "k", 20.0).count() == 0


def test_densest_are_taken_out_in_turn(spark):
    rng = random.Random(4)
    vals = [round(rng.uniform(0, 60), 1) for _ in range(150)] + [30.0] * 20 + [None]
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate(vals)], "g int, v double, k int")
    left, want = sorted(v for v in vals if v is not None), []
    while True:
        best = max(((sum(lo <= x <= lo + 6 for x in left), -lo) for lo in left), default=(0, 0))
        if best[0] < 10:
            break
        lo = -best[1]
        want.append((1, len(want), lo, best[0]))
        left = [x for x in left if x < lo or x > lo + 6]
    assert sorted(map(tuple, densest_stretches(df, "g", "v", "k", 6.0, 10).collect())) == want


def test_located_hops_anchor_later_ones(spark):
    rows = [(1, 1, [9.0, 1.0]), (1, 2, [5.0]), (1, 3, [0.0, 8.0]), (1, 4, [20.0, 2.0]), (1, 5, None), (2, 1, [1.0, 2.0]), (2, 2, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "g int, o int, opts array<double>, x string")
    got = {(r.g, r.o): r.at for r in locate_along(df, "g", "o", "opts", "at").collect()}
    assert got == {(1, 1): 9.0, (1, 2): 5.0, (1, 3): 8.0, (1, 4): 2.0, (1, 5): None, (2, 1): None, (2, 2): None}


def test_propagator_says_what_it_cannot_do(spark):
    low = (15.06, 0.0001, 53.0, 10.0, 90.0, 0.0, 0.0001)
    rows = [(1, *low, 10.0), (2, 2.0, 0.01, 55.0, 1.0, 1.0, 1.0, 0.0, 10.0), (3, 15.06, 1.2, 53.0, 1.0, 1.0, 1.0, 0.0, 10.0), (4, 16.4, 0.02, 53.0, 1.0, 1.0, 1.0, 0.05, 9000.0), (5, None, 0.01, 55.0, 1.0, 1.0, 1.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "sat long, mean_motion double, ecc double, incl double, node double, argp double, mean double, bstar double, minutes double")
    got = {r.sat: r for r in orbit.propagate(df).collect()}
    assert got[1].code == 0 and 6700 < np.hypot(np.hypot(got[1].x, got[1].y), got[1].z) < 7100
    assert got[2].code == 1 and got[2].x is None
    assert all(got[k].code > 0 and got[k].x is None and got[k].vz is None for k in (3, 4, 5))
