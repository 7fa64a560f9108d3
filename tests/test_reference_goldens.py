"""Small inputs with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import net, text
from weftline.operators import graph, intervals, layout, orbit, profiles, raster
from weftline.operators.ranking import dense_codes, global_rank
from weftline.sources import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_overlap_join_pairs_and_sizes(spark):
    a = spark.createDataFrame([(0, 0, 99), (1, 50, 149), (2, 150, 249)], "i int, start long, end long")
    b = spark.createDataFrame([(0, 0, 49), (1, 50, 99), (2, 100, 199)], "i int, start long, end long")
    got = rows(intervals.overlap_join(a, b).select("i", "b_i", "overlap"))
    assert got == [(0, 0, 50), (0, 1, 50), (1, 1, 50), (1, 2, 50), (2, 2, 50)]


def test_overlap_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    make = lambda n, w: [(i, int(s), int(s + rng.integers(0, w))) for i, s in enumerate(rng.integers(-500, 5000, n))]
    x, y = make(150, 4000), make(150, 30)
    y += [(900, 7, 3), x[0]]
    a, b = spark.createDataFrame(x, "i int, start long, end long"), spark.createDataFrame(y, "i int, start long, end long")
    want = sorted((i, j, min(t, v) - max(s, u) + 1) for i, s, t in x for j, u, v in y if s <= v and u <= t and u <= v)
    assert sorted(map(tuple, intervals.overlap_join(a, b).select("i", "b_i", "overlap").collect())) == want
    assert intervals.overlap_join(a.limit(0), b).count() == 0


def test_boundaries_against_a_sequential_walk(spark):
    rng = np.random.default_rng(2)
    for trial in range(4):
        r = [(int(s), int(s + rng.integers(0, 300)), int(rng.integers(1, 4))) for s in rng.integers(0, 3000, 60)]
        r.sort()
        marks, end = [], -1
        for s, e, o in r:
            if e <= end:
                continue
            s = max(s, end + 1)
            if s > end + 1:
                marks.append((end + 1, 0))
            marks.append((s, o))
            end = e
        marks.append((end + 1, 0))
        want = [m for i, m in enumerate(marks) if i == 0 or m[1] != marks[i - 1][1]]
        got = intervals.boundaries(spark.createDataFrame(r, "start long, end long, asn long"), cell=64).orderBy("start")
        assert [tuple(x) for x in got.collect()] == want, trial


def test_last_before_in_groups_with_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, None, 7), (4, "b", 9), (5, "a", None), (6, "a", 1000)], "i int, g string, at long")
    right = spark.createDataFrame([("a", 6, 60), ("a", 10, 100), (None, 1, 11), ("a", 30, None)], "g string, t long, v long")
    got = rows(intervals.last_before(left, right, "at", "t", "v", ["g"], cell=8).select("i", "v"))
    assert got == [(1, 100), (2, None), (3, 11), (4, None), (5, None), (6, None)]
    ahead = rows(intervals.last_before(left, right, "at", "t", "v", ["g"], cell=8, forward=True).select("i", "v"))
    assert ahead == [(1, 100), (2, 60), (3, None), (4, None), (5, None), (6, None)]


def test_longest_prefix(spark):
    table = spark.createDataFrame([(0, 0, "all"), (167772160, 8, "ten"), (167837696, 16, "ten-one")], "lo long, plen int, name string")
    p = spark.createDataFrame([(1, 167837697), (2, 167772161), (3, 5), (4, None)], "i int, n long")
    assert rows(intervals.longest_prefix(p, "n", table).select("i", "name")) == [(1, "ten-one"), (2, "ten"), (3, "all"), (4, None)]


def test_range_to_prefixes():
    assert list(net.range_cidrs(10 << 24, (10 << 24) + 384)) == [(10 << 24, 24), ((10 << 24) + 256, 25), ((10 << 24) + 384, 32)]
    assert list(net.range_cidrs(0, (1 << 32) - 1)) == [(0, 0)]


def test_profile_of_three_prefixes(spark):
    pfx = spark.createDataFrame([(0, 999, 1), (1000, 1999, 2), (2000, 2999, 2)], "start long, end long, asn long")
    geo = spark.createDataFrame([(0, 999, 48.85, 2.35, "FR", "Paris"), (1000, 2499, 35.68, 139.69, "JP", "Tokyo"), (2500, 2999, 52.52, 13.4, "DE", "Berlin")], "start long, end long, lat double, lon double, cc string, city string")
    got = {r.asn: r for r in profiles.profile_networks(pfx, geo).collect()}
    assert (got[1].addresses, got[1].country, got[1].concentration) == (1000, "FR", 1.0)
    assert (got[2].addresses, got[2].country, got[2].sites[0].city) == (2000, "JP", "Tokyo")
    assert got[2].lat == pytest.approx(35.68) and got[2].concentration == pytest.approx(0.75)


@pytest.fixture(scope="module")
def topology(spark):
    pairs = [(0, 1, 0), (0, 2, -1), (0, 3, -1), (1, 4, -1), (2, 5, -1), (3, 6, -1), (0, 4, -1), (3, 5, -1)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "eid long, a long, b long, rel int")


def test_cones_degrees_and_backbone(spark, topology):
    cones = graph.customer_cones(topology)
    assert dict(map(tuple, cones.collect())) == {0: 6, 1: 2, 2: 2, 3: 3, 4: 1, 5: 1, 6: 1}
    d = {r.node: r for r in graph.degrees(topology).collect()}
    assert (d[0].degree, d[0].customers, d[0].peers, d[5].providers) == (4, 3, 1, 2)
    level = graph.levels(cones, graph.coreness(topology))
    assert rows(graph.backbone(topology, cones, level, 2.0)) == [(0,), (1,), (2,), (3,), (5,), (6,), (7,)]


def test_cycles_end(spark):
    e = spark.createDataFrame([(1, 1, 2, -1), (2, 2, 3, -1), (3, 3, 1, -1)], "eid long, a long, b long, rel int")
    assert dict(map(tuple, graph.customer_cones(e).collect())) == {1: 3, 2: 3, 3: 3}


def test_routes_are_valley_free(spark, topology):
    pairs = spark.createDataFrame([(5, 6), (4, 6), (5, 5), (4, 1), (2, 1)], "src long, dst long")
    got = {(r.src, r.dst): (r.hops, r.valley_free, list(r.nodes)) for r in graph.routes_with_fallback(topology, pairs).collect()}
    assert got[5, 6] == (2, True, [5, 3, 6]) and got[5, 5] == (0, True, [5]) and got[4, 6] == (3, True, [4, 0, 3, 6]) and got[2, 1] == (2, True, [2, 0, 1])


def _random_graph(spark, n, m, seed):
    rng = np.random.default_rng(seed)
    e = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, n, (m, 2)) if p[0] != p[1]})
    cost = rng.permutation(len(e)) + 1.0
    return e, cost, spark.createDataFrame([(i, a, b, 0, float(c)) for i, ((a, b), c) in enumerate(zip(e, cost, strict=True))], "eid long, a long, b long, rel int, cost double")


def test_components_forest_core_and_costs_against_plain_code(spark):
    n = 40
    e, cost, df = _random_graph(spark, n, 55, 3)
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    forest = set()
    for i in np.argsort(cost):
        a, b = map(find, e[i])
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.add(int(i))
    assert {r.eid for r in graph.spanning_forest(df, "cost").collect()} == forest
    label = {r.node: r.component for r in graph.components(df).collect()}
    assert all((label[a] == label[b]) == (find(a) == find(b)) for a in label for b in label)

    near = {v: set() for p in e for v in p}
    for a, b in e:
        near[a].add(b)
        near[b].add(a)
    core, left, k = {}, {v: set(x) for v, x in near.items()}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    assert {r.node: r.core for r in graph.coreness(df).collect()} == core

    dist = {0: 0.0}
    for _ in range(n):
        for (a, b), c in zip(e, cost, strict=True):
            for u, v in ((a, b), (b, a)):
                if u in dist and dist[u] + c < dist.get(v, np.inf):
                    dist[v] = dist[u] + c
    got = graph.shortest_costs(df, spark.createDataFrame([(0, 0.0)], "node long, start double"), "cost")
    assert {r.node: r.dist for r in got.collect()} == dist


def test_sample_trees_span(spark):
    e, _, df = _random_graph(spark, 30, 80, 5)
    one = graph.sample_trees(df, spark.createDataFrame([(0, e[0][0])], "tree int, node long"))
    label = {r.node: r.component for r in graph.components(df).collect()}
    assert one.count() == sum(c == label[e[0][0]] for c in label.values()) - 1


def test_fan_out_of_one_place(spark):
    p = spark.createDataFrame([(i, 10.0, 20.0, float(i)) for i in range(20)], "k int, lat double, lon double, w double")
    got = {r.k: (r.lat, r.lon) for r in profiles.fan_out(p, "k", "w").collect()}
    assert len(set(got.values())) == 20 and got[19] == (10.0, 20.0)


def test_cluster_and_tree_of_sites(spark):
    s = spark.createDataFrame([(1, 40.7, -74.0, 0.5, "New York"), (1, 40.8, -74.1, 0.1, "Newark"), (1, 51.5, -0.1, 0.35, "London"), (1, 0.0, 0.0, 0.001, "Null"), (1, 35.7, 139.7, 0.04, "Tokyo")], "asn long, lat double, lon double, share double, city string")
    c = graph.cluster_sites(s, "asn")
    assert [(r.city, round(r.share, 3)) for r in c.orderBy("site").collect()] == [("New York", 0.6), ("London", 0.35), ("Tokyo", 0.04)]
    assert rows(graph.tree_of_points(c, "asn", "site").select("u", "v")) == [(0, 1), (1, 2)]


def test_global_rank_and_codes(spark):
    df = spark.createDataFrame([(i * 37 % 100,) for i in range(100)], "v long")
    assert rows(global_rank(df, [F.col("v")], "k").select("v", "k")) == rows(df.select("v", F.col("v") + 1))
    assert rows(dense_codes(df.union(df), "v", "code")) == rows(df.select("v", F.col("v")))
    assert global_rank(df.limit(0), [F.col("v")], "k").count() == 0


def test_router_links(spark):
    lines = spark.createDataFrame([(1, "link L1:  N1:1.1.1.1 N2 N3"), (2, "link L2:  " + " ".join(f"N{i}" for i in range(9))), (3, "# no link"), (4, "link L9: N1")], "line long, value string")
    got = rows(feeds.router_links(lines))
    assert [g for g in got if g[0] == 1] == [(1, 1, 2), (1, 1, 3), (1, 2, 3)] and [g for g in got if g[0] == 2] == [(2, 0, i) for i in range(1, 9)] and len(got) == 11


def test_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text("# feed\n10.0.0.5/24,us,us-ca,Town,\n10.0.0.0/24,de,,Other,\nnope,us\n2001:DB8::/32,fr,,,\n")
    lines = feeds.numbered_lines(spark, f"file://{tmp_path}/f.csv")
    got = rows(feeds.geofeed(lines).select("prefix", "version", "country", "region", "city"))
    assert got == [("10.0.0.0/24", 4, "US", "US-CA", "Town"), ("2001:db8::/32", 6, "FR", "", "")]
    good = lines.where(F.col("value").rlike("^[0-9]"))
    assert feeds.bad_lines(lines, good).first().bad == 1


def test_pasted_trace(spark):
    t = ["traceroute to x (1.2.3.4), 30 hops max", " 1  192.168.1.1  1.2 ms", " 2  core-10-1-2-3.example.net  5 ms", " 2  10.9.9.9", " 3.|-- edge.example.org (8.8.8.8) 0.0%", " 4  * * *"]
    got = rows(feeds.pasted_trace(spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "trace int, line long, value string")).select("hop", "ip", "host"))
    assert got == [(1, "192.168.1.1", ""), (2, "10.1.2.3", "core-10-1-2-3.example.net"), (3, "8.8.8.8", "edge.example.org"), (4, None, "")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Saint-Étienne (Loire)", ["1", "1", "{2,3}", "{2,3}", "1"], "a=1&B=2&c=x", "48.5, 2.25")], "n string, p array<string>, q string, at string")
    r = df.select(text.fold_name("n").alias("n"), text.fold_path("p").alias("p"), text.format_params(text.parse_params("q")).alias("q"), text.parse_position("at").alias("at"), text.host_tokens(F.lit("ae1.fra02-core.isp.net")).alias("h")).first()
    assert r.n == "stetienne" and [(x.hop, x.n) for x in r.p] == [("1", 2), ("{2,3}", 1), ("{2,3}", 1), ("1", 1)]
    assert r.q == "a=1&c=x" and tuple(r["at"]) == (48.5, 2.25) and list(r.h) == ["ae1", "fra02", "core"]
    empty = spark.createDataFrame([(None, None, None, "91,0")], "n string, p array<string>, q string, at string")
    r = empty.select(text.fold_name("n").alias("n"), text.fold_path("p").alias("p"), text.format_params(text.parse_params("q")).alias("q"), text.parse_position("at").alias("at")).first()
    assert r.n is None and list(r.p) == [] and r.q == "" and r["at"] is None


def test_propagator_gives_the_published_vector():
    one = [np.full(2, x) for x in (10.82419157, 0.1859667, 34.2682, 348.7242, 331.7664, 19.3264, 0.28098e-4)]
    p, v = orbit.sgp4(*one, np.array([0.0, 360.0]))
    assert np.allclose(p[0], [7022.46529266, -1400.08296755, 0.03995155], atol=1e-5)
    assert np.allclose(p[1], [-7154.03120202, -3783.17682504, -3536.19412294], atol=1e-5)
    assert np.allclose(v[0], [1.893841015, 6.405893759, 4.534807250], atol=1e-7)


def test_grid_has_at_most_four_links_each(spark):
    rows_ = []
    for p in range(4):
        for k in range(6):
            t, o = np.radians(k * 60), np.radians(p * 90)
            rows_.append((0, p * 6 + k, p, float(k * 60), 7000 * np.cos(t) * np.cos(o), 7000 * np.cos(t) * np.sin(o), 7000 * np.sin(t)))
    m = spark.createDataFrame([tuple(map(lambda x: x.item() if hasattr(x, "item") else x, r)) for r in rows_], "shell int, sat long, plane int, u double, x double, y double, z double")
    links = orbit.ring_links(m, ["shell", "plane"]).select("a", "b").union(orbit.cross_links(m, ["shell"], 20_000.0).select("a", "b")).collect()
    degree = np.bincount([x for r in links for x in (r.a, r.b)], minlength=24)
    assert degree.max() <= 4 and len(links) >= 24


def test_layout_spreads_spokes_and_holds_pins(spark):
    star = spark.createDataFrame([(i, 0, i, 0) for i in range(1, 13)], "eid long, a long, b long, rel int")
    pins = spark.createDataFrame([(0, 5.0, 7.0)], "node long, px double, py double")
    lay = layout.tree_layout(star, 30, pins)
    hub = lay.where("node = 0").first()
    assert (hub.x, hub.y) == (5.0, 7.0)
    free = layout.tree_layout(star, 30)
    assert layout.spread_of(free, star).where("node = 0").first().evenness > 0.85
    fit = layout.fit_square(free).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert min(fit) >= 0 and max(fit) <= 1


def test_tiles(spark, tmp_path):
    links = spark.createDataFrame([(1, 0, 0.1, 0.1, 0.9, 0.9, 1.0, 0.5, 0.2)], "eid long, rel int, ax double, ay double, bx double, by double, r double, g double, b double")
    t = raster.render_tiles(links, [0, 1], 64)
    got = {(r.z, r.x, r.y): bytes(r.png) for r in t.collect()}
    # the line goes through the middle, where all four tiles meet
    assert set(got) == {(0, 0, 0), (1, 0, 0), (1, 1, 1), (1, 0, 1), (1, 1, 0)} and all(p[:8] == b"\x89PNG\r\n\x1a\n" for p in got.values())
    raster.write_tiles(t, f"file://{tmp_path}")
    assert (tmp_path / "1" / "1" / "1.png").read_bytes() == got[1, 1, 1]
    light = raster.splat(np.array([[8.0, 8.0, 24.0, 8.0]]), np.ones((1, 3)), 32)
    assert light[..., 0].sum() == pytest.approx(16) and raster.tone(light, 0.5).dtype == np.uint8


def test_longest_prefix_of_both_families(spark):
    t = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("2001:db8::/32", "c"), ("2001:db8:1::/48", "d")], "c string, pop string").withColumn("p", net.cidr("c"))
    t = t.select(F.col("p.lo").alias("lo"), (F.col("p.plen") + F.when(F.col("p.version") == 4, 96).otherwise(0)).alias("plen"), "pop")
    a = spark.createDataFrame([(1, "10.1.2.3"), (2, "10.2.2.3"), (3, "2001:db8:1::5"), (4, "2001:db8:2::5"), (5, "::1"), (6, None), (7, "junk")], "i int, ip string").withColumn("a", net.address_bytes("ip"))
    got = rows(intervals.longest_prefix_any(a, "a", t).select("i", "pop"))
    assert got == [(1, "b"), (2, "a"), (3, "d"), (4, "c"), (5, None), (6, None), (7, None)]


def test_array_kernels_equal_the_joins(spark):
    for seed in (7, 8):
        e, _, df = _random_graph(spark, 60, 110, seed)
        roots = spark.createDataFrame([(i, x[0]) for i, x in enumerate(e[:6])] + [(9, 10_000)], "tree int, node long")
        down = df.withColumn("rel", F.lit(-1))
        for f in (lambda k: graph.coreness(df, kernel=k), lambda k: graph.customer_cones(down, kernel=k), lambda k: graph.sample_trees(df, roots, kernel=k)):
            assert rows(f(None)) == rows(f(False))
        mixed = df.withColumn("rel", (F.col("eid") % 3 - 1).cast("int"))
        pairs = spark.createDataFrame([(x[0], y[1]) for x in e[:8] for y in e[-8:]] + [(e[0][0], 10_000), (10_000, e[0][0])], "src long, dst long")
        for vf in (True, False):
            assert rows(graph.routes(mixed, pairs, valley_free=vf)) == rows(graph.routes(mixed, pairs, valley_free=vf, kernel=False))
    none = df.where("eid < 0")
    assert graph.customer_cones(none).count() == 0 and graph.coreness(none).count() == 0 and graph.sample_trees(none, roots).count() == 0
