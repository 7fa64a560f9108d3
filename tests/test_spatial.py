import random

import numpy as np

from weftline.operators.spatial import Quadtree, RTree, great_circle, near_pairs, nearest, reach

SCHEMA = "id long, lat double, lon double, km string"


def run(spark, a, b, km, **kw):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    return near_pairs(left, right, {"id": "a"}, {"id": "b"}, km, **kw)


def brute(a, b, km):
    ok = lambda r: r[1] is not None and r[2] is not None and r[1] == r[1] and abs(r[1]) <= 90
    return sorted((x[0], y[0]) for x in a if ok(x) for y in b if ok(y) and great_circle(x[1], x[2], y[1], y[2]) <= km)


def scatter(n, seed, first=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            rows.append((first + i, rng.uniform(-90, 90), rng.choice([-1, 1]) * rng.uniform(179, 180), "c"))
        elif kind < 0.6:
            rows.append((first + i, rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-360, 360), "c"))
        elif kind < 0.8:
            rows.append((first + i, 10.0, 20.0, "c"))  # a crowd at one place
        else:
            rows.append((first + i, rng.uniform(-90, 90), rng.uniform(-180, 180), None))
    return rows


def test_equals_brute_force_with_splits(spark):
    a, b = scatter(300, 1), scatter(200, 2)
    a += [(900, None, 1.0, None), (901, float("nan"), 1.0, None), (902, 91.0, 1.0, None), a[0]]
    b += [(900, 1.0, None, None), b[3]]
    for km in (0.0, 40.0, 300.0, 12_000.0):
        got = sorted((r.a, r.b) for r in run(spark, a, b, km, leaf=16).select("a", "b").collect())
        assert got == brute(a, b, km)


def test_empty_sides(spark):
    some = [(1, 0.0, 0.0, None)]
    assert run(spark, [], some, 5.0).count() == 0 and run(spark, some, [], 5.0).count() == 0 and run(spark, [], [], 5.0).count() == 0


def test_nearest_breaks_ties_by_key(spark):
    pairs = run(spark, [(1, 0.0, 0.0, None)], [(8, 0.0, 1.0, None), (7, 0.0, -1.0, None), (9, 0.0, 2.0, None)], 500.0)
    assert [r.b for r in nearest(pairs, ["a"], ["b"]).collect()] == [7]


def test_index_parts():
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500)
    boxes, own = reach(lat, lon, 200.0, 6371.0)
    p, q = RTree(boxes).probe(lat[:100], lon[:100])
    found = set(zip(p.tolist(), own[q].tolist(), strict=True))
    for i in range(100):
        for j in np.flatnonzero(great_circle(lat[i], lon[i], lat, lon) <= 200.0):
            assert (i, int(j)) in found
    tree = Quadtree(lat, lon, 20)
    leaves = tree.of_points(lat, lon)
    rows, touched = tree.of_boxes(np.c_[lat, lon, lat, lon])
    assert {(i, int(k)) for i, k in enumerate(leaves)} <= set(zip(rows.tolist(), touched.tolist(), strict=True))


def test_regions_that_contain_points(spark):
    from weftline.operators.spatial import containing_regions, inside_ring

    pts = scatter(300, 3) + [(800, 0.5, 0.5, None), (801, 0.5, 179.9, None), (802, 0.5, -179.9, None), (803, None, 1.0, None)]
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    over = [(-5.0, 170.0), (-5.0, 190.0), (5.0, 190.0), (5.0, 170.0)]
    notch = [(-80.0, -170.0), (80.0, -170.0), (0.0, -60.0), (80.0, 100.0), (-80.0, 100.0)]
    rings = {1: square, 2: over, 3: notch, 4: square[:2], 5: [(-89.0, -180.0), (-89.0, 180.0), (89.0, 180.0), (89.0, -180.0)], 6: None}
    r = spark.createDataFrame([(k, None if v is None else [{"lat": y, "lon": x} for y, x in v], "clash") for k, v in rings.items()], "zone int, ring array<struct<lat:double,lon:double>>, id string")
    got = sorted((x.a, x.zone) for x in containing_regions(spark.createDataFrame(pts, SCHEMA), r, {"id": "a"}, {"zone": "zone"}, leaf=32).collect())
    want = []
    for i, lat, lon, _ in pts:
        if lat is not None:
            lon = (lon + 180) % 360 - 180
            for k, v in rings.items():
                if v and len(v) > 2:
                    y, x = np.array(v).T
                    want += [(i, k) for s in (-360, 0, 360) if inside_ring(np.array([lat]), np.array([lon + s]), y, x)[0]]
    assert got == sorted(want) and {(800, 1), (801, 2), (802, 2)} <= set(got)
    assert containing_regions(spark.createDataFrame([], SCHEMA), r, {"id": "a"}, {"zone": "zone"}).count() == 0


def test_very_many_rows_at_one_place(spark):
    a = spark.range(20_000).selectExpr("id", "48.1 + id / 1e7 AS lat", "11.5 AS lon").unionByName(spark.range(100_000, 100_050).selectExpr("id", "(id - 100000) * 1.0 AS lat", "(id - 100000) * 2.0 AS lon"))
    b = spark.range(5_000).selectExpr("id AS other", "48.1 AS lat", "11.5 + id / 1e7 AS lon")
    got = near_pairs(a, b, {"id": "id"}, {"other": "other"}, 50.0)
    assert got.count() == 20_000 * 5_000
    assert got.agg({"km": "max"}).first()[0] < 1


def test_nearest_of_any_number_by_growing_rings(spark):
    from weftline.operators.spatial import nearest_points

    rng = random.Random(21)
    a = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(100, None, 1.0)]
    b = [(i, rng.uniform(40, 41), rng.uniform(10, 11)) for i in range(40)] + [(50, -80.0, 170.0), (51, -80.0, 170.0)]
    x, y = spark.createDataFrame(a, "id int, lat double, lon double"), spark.createDataFrame(b, "o int, lat double, lon double")
    got = {}
    for r in nearest_points(x, y, {"id": "id"}, {"o": "o"}, 2).collect():
        got.setdefault(r.id, []).append((r["rank"], r.o))
    for i, la, lo in a:
        if la is None:
            assert i not in got
            continue
        want = sorted((float(great_circle(la, lo, p, q)), o) for o, p, q in b)[:2]
        assert [o for _, o in sorted(got[i])] == [o for _, o in want]
    assert nearest_points(x, y.where("false"), {"id": "id"}, {"o": "o"}).count() == 0
