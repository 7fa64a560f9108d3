"""Queries over graph operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.geo import fixed
from weftline.operators import graph, profiles
from weftline.plans import fixtures as fx
from weftline.plans.fixtures import with_sql
from weftline.plans.relational import _pop_links
from weftline.session import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_sql(uses, sql).replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return add


_FIX = "floor(({0}) * 1000000.0 + 0.5) / 1000000.0"
_CONE = "r(top, low) AS (SELECT a, b FROM fx_edges WHERE rel = -1 UNION SELECT r.top, e.b FROM r JOIN fx_edges e ON e.a = r.low AND e.rel = -1), cone AS (SELECT node, 1 + count(low) FILTER (low <> node) AS cone FROM fx_nodes LEFT JOIN r ON r.top = node GROUP BY 1)"
# core numbers as the fixpoint of the h-index of the neighbours' values; sixty rounds are more than these graphs need
_CORE = "both_ends AS MATERIALIZED (SELECT a AS node, b AS other FROM fx_edges WHERE a <> b UNION ALL SELECT b, a FROM fx_edges WHERE a <> b), kk(node, core, it) AS (SELECT node, count(*), 0 FROM both_ends GROUP BY 1 UNION ALL SELECT node, max(least(core, r)), max(it) + 1 FROM (SELECT n.node, k.core, k.it, row_number() OVER (PARTITION BY n.node ORDER BY k.core DESC) AS r FROM both_ends n JOIN kk k ON k.node = n.other) WHERE it < 60 GROUP BY 1), core AS (SELECT node, core FROM kk WHERE it = 60)"
_LEVEL = f"{_CONE}, {_CORE}, lv AS (SELECT node, cone, least(1.0, greatest(0.0, 0.65 * ln(1 + cone - 1) / (SELECT max(ln(1 + cone - 1)) FROM cone) + 0.35 * pow(core / (SELECT max(core) FROM core)::DOUBLE, 1.5))) AS level FROM cone JOIN core USING (node))"


@query(f"WITH {_CONE} SELECT node, cone FROM cone", "fx_nodes")
def gr_cone(s, d):
    return graph.customer_cones(fx.edges(s, d))


def _levels(s, d):
    """The links, and each node's cone and level; all three written once, as they are read several times."""
    e = staged(fx.edges(s, d), "edges")
    cones = staged(graph.customer_cones(e), "cones")
    return e, cones, staged(graph.levels(cones, graph.coreness(e)), "levels")


@query(f"WITH {_LEVEL} SELECT node, {_FIX.format('level')} AS level FROM lv", "fx_nodes")
def gr_level(s, d):
    """Place of each node in the hierarchy: the blend of its cone and its core number."""
    return _levels(s, d)[2].select("node", fixed("level").alias("level"))


@query(f"WITH {_LEVEL}, best AS (SELECT eid FROM (SELECT eid, row_number() OVER (PARTITION BY b ORDER BY cone DESC, eid) AS k FROM fx_edges JOIN cone ON node = a WHERE rel = -1) WHERE k = 1), cust AS (SELECT DISTINCT b FROM fx_edges WHERE rel = -1) SELECT eid FROM best UNION SELECT eid FROM fx_edges JOIN lv x ON x.node = a JOIN lv y ON y.node = b WHERE x.level > 0.75 AND y.level > 0.75 UNION SELECT eid FROM fx_edges WHERE a NOT IN (SELECT b FROM cust) OR b NOT IN (SELECT b FROM cust)", "fx_nodes")
def gr_backbone(s, d):
    return graph.backbone(*_levels(s, d))


@query(f"WITH {_CORE} SELECT node, core::BIGINT AS core FROM core", "fx_edges")
def gr_coreness(s, d):
    return graph.coreness(fx.edges(s, d))


_LABEL = "ways AS MATERIALIZED (SELECT a AS node, b AS other FROM fx_edges UNION SELECT b, a FROM fx_edges UNION SELECT a, a FROM fx_edges UNION SELECT b, b FROM fx_edges), ll(node, label, it) AS (SELECT DISTINCT node, node, 0 FROM ways UNION ALL SELECT w.node, min(l.label), max(l.it) + 1 FROM ways w JOIN ll l ON l.node = w.other WHERE l.it < 20 GROUP BY 1), component AS (SELECT node, label AS component FROM ll WHERE it = 20)"


@query(f"WITH {_LABEL} SELECT node, component, component = (SELECT component FROM component GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) AS giant FROM component", "fx_edges")
def gr_components(s, d):
    """Components over all links, and which nodes are in the largest (of equals the one with the least node)."""
    label = graph.components(fx.edges(s, d))
    giant = F.broadcast(giant_component(label).withColumn("giant", F.lit(True)))
    return label.join(giant, "component", "left").select("node", "component", F.coalesce("giant", F.lit(False)).alias("giant"))


@query("WITH n AS (SELECT a AS node, b AS other, eid FROM fx_edges UNION ALL SELECT b, a, eid FROM fx_edges) SELECT node, count(*)::INT AS degree, min_by(other, eid) AS first FROM n GROUP BY 1", "fx_edges")
def gr_adj(s, d):
    """Neighbour lists in link order."""
    n = graph.both_ways(fx.edges(s, d)).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("eid", "other"))).alias("out"))
    return n.select("node", F.size("out").alias("degree"), F.get("out", F.lit(0))["other"].alias("first"))


_TREES = f"{_LABEL}, roots AS (SELECT row_number() OVER (ORDER BY md5(node || '-7'), node) - 1 AS tree, node FROM component WHERE component = (SELECT component FROM component GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) QUALIFY tree < 255), ends AS MATERIALIZED (SELECT eid, a AS u, b AS v FROM fx_edges UNION ALL SELECT eid, b, a FROM fx_edges), reach(tree, node, hops) AS (SELECT tree, node, 0 FROM roots UNION SELECT r.tree, e.v, r.hops + 1 FROM reach r JOIN ends e ON e.u = r.node WHERE r.hops < 10), near AS (SELECT tree, node, min(hops) AS hops FROM reach GROUP BY 1, 2), used AS (SELECT tree, min(eid) AS eid FROM (SELECT y.tree, y.node, e.eid FROM near y JOIN ends e ON e.v = y.node JOIN near x ON x.tree = y.tree AND x.node = e.u AND x.hops = y.hops - 1) GROUP BY tree, node), rank AS (SELECT f.eid, coalesce(min(tree), (SELECT count(*) FROM roots))::INT AS rank FROM fx_edges f LEFT JOIN used USING (eid) GROUP BY 1)"


@query(f"WITH {_LABEL} SELECT (row_number() OVER (ORDER BY md5(node || '-7'), node) - 1)::INT AS tree, node FROM component WHERE component = (SELECT component FROM component GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) QUALIFY tree < 255", "fx_edges")
def smp_perm(s, d):
    """The roots of the sampling trees: the first 255 of a seeded order of the largest component."""
    return sample_roots(fx.edges(s, d))


def _ranks(s, d):
    """(eid, rank) of every link: the first of up to 255 breadth-first trees that uses it, the number of trees if none does."""
    e = fx.edges(s, d)
    start = sample_roots(e)
    trees = start.count()
    return e.select("eid").join(graph.sample_trees(e, start), "eid", "left").select("eid", F.coalesce("rank", F.lit(trees)).alias("rank"))


@query(f"WITH {_TREES} SELECT eid, rank FROM rank", "fx_edges")
def gr_sample_rank(s, d):
    """Breadth-first trees from up to 255 seeded roots of the largest component; each link's rank is the first tree that uses it."""
    return _ranks(s, d)


@query(f"WITH {_TREES} SELECT rank, count(*) AS links, sum(count(*)) OVER (ORDER BY rank)::BIGINT AS shown FROM rank GROUP BY 1", "fx_edges")
def agg_rank_cum(s, d):
    """Links shown at each sampling rank: a histogram of 256 bins at most, and its running sum."""
    h = _ranks(s, d).groupBy("rank").agg(F.count("*").alias("links"))
    return h.select("rank", "links", F.sum("links").over(Window.orderBy("rank")).alias("shown"))


def giant_component(label):
    """(component): the one with the most nodes, of equals the one with the least node."""
    return label.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")


def sample_roots(edges, most: int = 255):
    """(tree, node): up to ``most`` nodes of the largest component, in the order of a seeded digest."""
    s = edges.sparkSession
    label = graph.components(edges)
    inside = label.join(F.broadcast(giant_component(label)), "component", "left_semi")
    roots = inside.orderBy(F.md5(F.concat("node", F.lit("-7")).cast("binary")), "node").limit(most).select("node").collect()
    return s.createDataFrame([(i, r[0]) for i, r in enumerate(roots)], "tree int, node long")


@query("WITH li AS (SELECT s_nationkey AS x, c_nationkey AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), e AS MATERIALIZED (SELECT a * 1000 + b AS eid, a, b, 1.0::DOUBLE / (1 + w) AS cost FROM (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS w FROM li WHERE x <> y GROUP BY 1, 2)), ways AS (SELECT eid, cost, a AS u, b AS v FROM e UNION ALL SELECT eid, cost, b, a FROM e), r(eid, node) AS (SELECT eid, a FROM e UNION SELECT r.eid, w.v FROM r JOIN e me ON me.eid = r.eid JOIN ways w ON w.u = r.node AND (w.cost < me.cost OR w.cost = me.cost AND w.eid < me.eid)) SELECT eid FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.eid = e.eid AND r.node = e.b)", "fx_edges")
def gr_msf(s, d):
    """Forest of the PoP links with the most weight."""
    e = _pop_links(s, d).select((F.col("a") * 1000 + F.col("b")).alias("eid"), "a", "b", (1.0 / (1 + F.col("weight"))).alias("cost"))
    return graph.spanning_forest(e, "cost")


def _pairs(s, d):
    c = fx.nodes(s, d).where("node BETWEEN 2000000 AND 2999999").select("node")  # the nations: twenty-five
    return c.select(F.col("node").alias("src")).crossJoin(F.broadcast(c.select(F.col("node").alias("dst"))))


@query("WITH n AS (SELECT a AS x, b AS y, rel, true AS down FROM fx_edges UNION ALL SELECT b, a, rel, false FROM fx_edges), st AS (SELECT DISTINCT node AS src FROM fx_nodes WHERE node BETWEEN 2000000 AND 2999999), f(src, node, phase, hops) AS (SELECT src, src, 0, 0 FROM st UNION SELECT f.src, n.y, CASE WHEN rel = -1 AND NOT down THEN 0 ELSE 1 END, f.hops + 1 FROM f JOIN n ON n.x = f.node WHERE f.hops < 5 AND (down AND rel = -1 OR f.phase = 0)) SELECT src, node AS dst, min(hops)::INT AS hops FROM f WHERE node BETWEEN 2000000 AND 2999999 GROUP BY 1, 2", "fx_nodes")
def gr_route(s, d):
    """Hops of the shortest valley-free route between nations."""
    return graph.routes(fx.edges(s, d), _pairs(s, d)).select("src", "dst", "hops")


@query()
def gr_route_paths(s, d):
    """The routes node by node, by the plain shortest path where none is valley-free."""
    r = graph.routes_with_fallback(fx.edges(s, d), _pairs(s, d))
    return r.select("src", "dst", "valley_free", F.posexplode("nodes").alias("i", "node"))


@query()
def join_search_route(s, d):
    """A route over several waypoints: a leg between each two, put end to end."""
    c = fx.nodes(s, d).where("node BETWEEN 2000000 AND 2999999").select("node")
    legs = c.select(F.col("node").alias("src")).join(c.select(F.col("node").alias("dst")), F.col("dst") == F.col("src") + 1)
    return graph.routes_with_fallback(fx.edges(s, d), legs).select("src", F.posexplode("nodes").alias("i", "node")).where("i > 0 OR src = 2000000")


@query("WITH src AS (SELECT node, (node % 10)::DOUBLE AS start FROM fx_nodes WHERE node BETWEEN 1000000 AND 1999999), ways AS MATERIALIZED (SELECT a AS u, b AS v, (1 + eid % 7)::DOUBLE AS cost FROM fx_edges UNION ALL SELECT b, a, (1 + eid % 7)::DOUBLE FROM fx_edges), dd(node, dist, root, it) AS (SELECT node, start, node, 0 FROM src UNION ALL SELECT node, min(k)[1], min(k)[2], max(it) + 1 FROM (SELECT node, (dist, root) AS k, it FROM dd WHERE it < 25 UNION ALL SELECT v, (dist + cost, root), it FROM dd JOIN ways ON u = node WHERE it < 25 AND v NOT IN (SELECT node FROM src)) GROUP BY 1) SELECT node, dist, root FROM dd WHERE it = 25", "fx_nodes")
def gr_dijkstra_ms(s, d):
    """Cheapest way from any of the regions, links of different cost; a way never leads through another region."""
    e = fx.edges(s, d).withColumn("cost", (1 + F.col("eid") % 7).cast("double"))
    src = fx.nodes(s, d).where("node BETWEEN 1000000 AND 1999999").select("node", (F.col("node") % 10).cast("double").alias("start"))
    return graph.shortest_costs(e, src, "cost")


_WLEVEL = f"{_LEVEL}, pl AS (SELECT s_nationkey AS x, c_nationkey AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), pe AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS w FROM pl WHERE x <> y GROUP BY 1, 2), pg AS (SELECT node, ln(1 + sum(w)) AS l FROM (SELECT a AS node, w FROM pe UNION ALL SELECT b, w FROM pe) GROUP BY 1)"


@query(f"WITH {_WLEVEL} SELECT pg.node, {_FIX.format('least(1.0, greatest(0.0, 0.6 * coalesce(lv.level, 0) + 0.4 * l / (SELECT max(l) FROM pg)))')} AS level FROM pg LEFT JOIN lv ON lv.node = pg.node + 2000000", "fx_nodes")
def agg_level_itdk(s, d):
    """A PoP's level: that of its network, and its own share of router links."""
    links = staged(_pop_links(s, d), "links")  # at most one for each two places
    g = graph.degrees(links.withColumn("rel", F.lit(0)), "weight").select("node", F.log1p(F.col("degree").cast("double")).alias("l"))
    top = F.broadcast(g.agg(F.max("l").alias("m")))
    own = _levels(s, d)[2].select((F.col("node") - 2_000_000).alias("node"), "level")
    mixed = 0.6 * F.coalesce("level", F.lit(0.0)) + 0.4 * F.col("l") / F.col("m")
    return g.join(own, "node", "left").crossJoin(top).select("node", fixed(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed))).alias("level"))


@query(f"WITH {_LEVEL}, best AS (SELECT eid FROM (SELECT eid, row_number() OVER (PARTITION BY b ORDER BY cone DESC, eid) AS k FROM fx_edges JOIN cone ON node = a WHERE rel = -1) WHERE k = 1), cust AS (SELECT DISTINCT b FROM fx_edges WHERE rel = -1), bb AS (SELECT eid FROM best UNION SELECT eid FROM fx_edges JOIN lv x ON x.node = a JOIN lv y ON y.node = b WHERE x.level > 0.75 AND y.level > 0.75 UNION SELECT eid FROM fx_edges WHERE a NOT IN (SELECT b FROM cust) OR b NOT IN (SELECT b FROM cust)), sh AS (SELECT node, cc, sum(n) AS n FROM (SELECT s_suppkey + 3000000 AS node, c_nationkey AS cc, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1, 2), pin AS (SELECT node FROM sh GROUP BY 1 HAVING max(n) * 10 >= sum(n)) SELECT (SELECT count(*) FROM fx_nodes) AS nodes, count(*) AS edges, count(*) FILTER (rel = -1) AS p2c, count(*) FILTER (rel = 0) AS p2p, (SELECT count(*) FROM fx_node_pos WHERE node IN (SELECT node FROM fx_nodes)) AS geolocated, (SELECT count(*) FROM pin) AS pinned, (SELECT count(*) FROM bb) AS backbone, (SELECT count(*) FROM sh) AS pops, (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM sh GROUP BY node)) AS routes FROM fx_edges", "fx_nodes fx_node_pos")
def agg_counts(s, d):
    """The dataset's counts: nodes, links by kind, placed and pinned nodes, backbone, PoPs (places of a supplier's goods) and the routes of their trees."""
    from weftline.plans.tables import table

    e, cones, lv = _levels(s, d)
    li, o, c = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    sh = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy((F.col("l_suppkey") + 3_000_000).alias("node"), F.col("c_nationkey").alias("cc")).agg(F.count("*").alias("n"))
    per = sh.groupBy("node").agg(F.max("n").alias("m"), F.sum("n").alias("t"), F.count("*").alias("k"))
    pops = per.agg(F.count_if(F.col("m") * 10 >= F.col("t")).alias("pinned"), F.sum("k").alias("pops"), F.sum(F.col("k") - 1).alias("routes"))
    links = e.agg(F.count("*").alias("edges"), F.count_if(F.col("rel") == -1).alias("p2c"), F.count_if(F.col("rel") == 0).alias("p2p"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    parts = [nodes.agg(F.count("*").alias("nodes")), nodes.join(fx.node_positions(s, d), "node", "left_semi").agg(F.count("*").alias("geolocated")), pops, graph.backbone(e, cones, lv).agg(F.count("*").alias("backbone"))]
    out = links
    for p in parts:  # one row each
        out = out.crossJoin(F.broadcast(p))
    return out.select("nodes", "edges", "p2c", "p2p", "geolocated", "pinned", "backbone", "pops", "routes")


_SITES = "sh AS (SELECT s_suppkey + 3000000 AS node, s_nationkey AS home, c_nationkey AS place, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), site AS (SELECT node, place, n / sum(n) OVER (PARTITION BY node)::DOUBLE AS share, row_number() OVER (PARTITION BY node ORDER BY n DESC, place) AS k FROM sh), part AS (SELECT node, k, share, concat('C', place) AS city, -60 + 5 * place AS lat, -170 + 13 * place AS lon, printf('%.3f', floor(share * 1000 + 0.5) / 1000) AS shown FROM site), sited AS (SELECT node, string_agg(concat(lat, ',', lon, ',', shown, ',', city), ' ' ORDER BY k) AS sites, string_agg(concat(city, ':', shown), ' ' ORDER BY k) AS pops, max(share) AS concentration FROM part GROUP BY 1)"
_OWNED = "owned AS (SELECT asn, sum(\"end\" - start + 1)::BIGINT AS addrs, count(*) AS nprefix, string_agg(start, ' ' ORDER BY start) AS prefixes FROM fx_prefix GROUP BY 1)"
_WHO = "who AS (SELECT r_regionkey + 1000000 AS node, r_name AS name, '' AS as_name, r_name AS country, '' AS city, '' AS region FROM region UNION ALL SELECT n_nationkey + 2000000, n_name, n_name, r_name, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT s_suppkey + 3000000, s_name, n_name, r_name, '', '' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT c_custkey + 4000000, c_name, n_name, r_name, '', '' FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
_POP = "pop AS (SELECT node, sum(r)::BIGINT AS routers, sum(l)::BIGINT AS router_links FROM (SELECT c_nationkey + 2000000 AS node, 1 AS r, 0 AS l FROM customer UNION ALL SELECT home + 2000000, 0, n FROM sh WHERE home <> place UNION ALL SELECT place + 2000000, 0, n FROM sh WHERE home <> place) GROUP BY 1)"


@query(f"WITH {_LEVEL}, {_SITES}, {_OWNED}, {_WHO}, {_POP}, dg AS (SELECT node, least(4, node // 1000000) AS t, sum(1)::BIGINT AS degree, sum(c)::BIGINT AS customers, sum(p)::BIGINT AS providers, (sum(1) - sum(c) - sum(p))::BIGINT AS peers FROM (SELECT a AS node, CASE WHEN rel = -1 THEN 1 ELSE 0 END AS c, 0 AS p FROM fx_edges UNION ALL SELECT b, 0, CASE WHEN rel = -1 THEN 1 ELSE 0 END FROM fx_edges) GROUP BY ALL), rk AS (SELECT node, row_number() OVER (ORDER BY cone DESC, degree DESC, node) AS rank FROM cone JOIN dg USING (node)) SELECT CASE t WHEN 1 THEN 'region' WHEN 2 THEN 'nation' WHEN 3 THEN 'supplier' ELSE 'customer' END AS kind, dg.node - 1000000 * t AS asn, coalesce(name, 'AS' || (dg.node - 1000000 * t)) AS name, coalesce(as_name, '') AS as_name, coalesce(country, '') AS country, coalesce(city, '') AS city, coalesce(region, '') AS region, coalesce(routers, 0) AS routers, coalesce(router_links, 0) AS router_links, coalesce(addrs, 0) AS addrs, coalesce(nprefix, 0) AS nprefix, coalesce(prefixes, '') AS prefixes, coalesce(sites, '') AS sites, coalesce(pops, '') AS pops, floor(coalesce(concentration, 0) * 1000 + 0.5) / 1000 AS concentration, coalesce(concentration, 0) >= 0.1 AS pinned, degree, providers, customers, peers, cone, core::BIGINT AS coreness, rank, floor(level * 1000 + 0.5) / 1000 AS level FROM dg JOIN lv ON lv.node = dg.node JOIN core ON core.node = dg.node JOIN rk ON rk.node = dg.node LEFT JOIN who ON who.node = dg.node LEFT JOIN pop ON pop.node = dg.node LEFT JOIN sited ON sited.node = dg.node LEFT JOIN owned ON owned.asn = dg.node % 97 + 1", "fx_nodes fx_prefix")
def agg_info_record(s, d):
    """Each node's record, all fields of both builders: names, country, addresses and all their prefixes, all sites and PoPs with their shares, concentration, links by kind, cone, core, rank and level; of a nation, which is a PoP, also its place, routers and router links.

    Sites and PoPs are those of suppliers; other nodes have none, as a PoP's fields are empty or 0 for others.
    """
    from weftline.operators.ranking import global_rank
    from weftline.plans.tables import table

    e = staged(fx.edges(s, d), "edges")
    cones = staged(graph.customer_cones(e), "cones")
    cores = staged(graph.coreness(e), "cores")
    level = graph.levels(cones, cores)
    rank = global_rank(cones.join(graph.degrees(e), "node"), [F.desc("cone"), F.desc("degree"), F.col("node")], "rank")
    r, n, sup, c = (table(s, d, t) for t in ("region", "nation", "supplier", "customer"))
    land = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    none = F.lit("")
    named = lambda df, node, *x: df.select(node.cast("long").alias("node"), *[v.alias(k) for k, v in zip(("name", "as_name", "country", "city", "region"), x, strict=True)])
    who = named(r, F.col("r_regionkey") + 1_000_000, F.col("r_name"), none, F.col("r_name"), none, none)
    who = who.union(named(land, F.col("n_nationkey") + 2_000_000, *[F.col(x) for x in ("n_name", "n_name", "r_name", "n_name", "r_name")]))
    for df, base, key, name, nation in ((sup, 3_000_000, "s_suppkey", "s_name", "s_nationkey"), (c, 4_000_000, "c_custkey", "c_name", "c_nationkey")):
        who = who.union(named(df.join(land, F.col(nation) == land.n_nationkey), F.col(key) + base, F.col(name), F.col("n_name"), F.col("r_name"), none, none))
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    goods = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy("l_suppkey", F.col("c_nationkey").alias("place")).agg(F.count("*").alias("n"))
    sh = staged(goods.join(sup, F.col("l_suppkey") == sup.s_suppkey).select((F.col("l_suppkey") + 3_000_000).alias("node"), F.col("s_nationkey").alias("home"), "place", "n"), "goods")  # for the sites, and the links between places
    by = Window.partitionBy("node")
    site = sh.withColumn("share", F.col("n") / F.sum("n").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "place")))
    shown, city = F.format_string("%.3f", F.floor(F.col("share") * 1000 + 0.5) / 1000), F.concat(F.lit("C"), F.col("place"))
    listed = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", x.alias("x")))), lambda v: v["x"]), " ")
    whole = F.concat_ws(",", -60 + 5 * F.col("place"), -170 + 13 * F.col("place"), shown, city)
    sited = site.groupBy("node").agg(listed(whole).alias("sites"), listed(F.concat(city, F.lit(":"), shown)).alias("pops"), F.max("share").alias("concentration"))
    between = sh.where("home <> place").groupBy("home", "place").agg(F.sum("n").alias("n"))
    ends = [c.groupBy(F.col("c_nationkey").alias("at")).agg(F.count("*").alias("r"), F.lit(0).cast("long").alias("l")), *[between.select(x, F.lit(0).cast("long"), "n") for x in ("home", "place")]]
    pop = ends[0].union(ends[1]).union(ends[2]).groupBy((F.col("at") + 2_000_000).cast("long").alias("node")).agg(F.sum("r").alias("routers"), F.sum("l").alias("router_links"))
    starts = F.transform(F.array_sort(F.collect_list("start")), lambda v: v.cast("string"))
    owned = fx.prefixes(s, d).groupBy(F.col("asn").alias("owner")).agg(F.sum(F.col("end") - F.col("start") + 1).alias("addrs"), F.count("*").alias("nprefix"), F.array_join(starts, " ").alias("prefixes"))
    j = rank.join(cores, "node").join(level, "node").join(who, "node", "left").join(sited, "node", "left").join(pop, "node", "left").join(owned, F.col("node") % 97 + 1 == F.col("owner"), "left")
    t = F.least(F.lit(4), F.floor(F.col("node") / 1_000_000))
    kind = F.when(t == 1, "region").when(t == 2, "nation").when(t == 3, "supplier").otherwise("customer").alias("kind")
    asn = F.col("node") - 1_000_000 * t
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    text = lambda x: F.coalesce(x, none).alias(x)
    share = F.coalesce("concentration", F.lit(0.0))
    return j.select(kind, asn.alias("asn"), F.coalesce("name", F.concat(F.lit("AS"), asn)).alias("name"), *[text(x) for x in ("as_name", "country", "city", "region")], *[zero(x) for x in ("routers", "router_links", "addrs", "nprefix")], *[text(x) for x in ("prefixes", "sites", "pops")], fixed(share, 3).alias("concentration"), (share >= 0.1).alias("pinned"), "degree", "providers", "customers", "peers", "cone", F.col("core").alias("coreness"), "rank", fixed("level", 3).alias("level"))


@query("WITH li AS (SELECT s_nationkey AS x, c_nationkey AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), l AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS w FROM li WHERE x <> y GROUP BY 1, 2), p AS (SELECT c_nationkey AS pop, count(*) AS routers FROM customer GROUP BY 1), k AS (SELECT pop FROM p WHERE routers >= (SELECT median(routers) FROM p)), e AS (SELECT * FROM l WHERE a IN (SELECT pop FROM k) AND b IN (SELECT pop FROM k)) SELECT a, b, w AS weight FROM e", "fx_edges")
def gr_prune(s, d):
    from weftline.plans.tables import table

    p = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("pop")).agg(F.count("*").alias("routers"))
    least = p.agg(F.median("routers")).first()[0]
    return graph.prune(p, _pop_links(s, d), least)[1].select("a", "b", "weight")


def _sites(s, d):
    t = profiles.top_sites(profiles.located_ranges(fx.prefixes(s, d), fx.places(s, d)))
    return t.select("asn", F.explode("sites").alias("x")).select("asn", "x.city", "x.lat", "x.lon", "x.share")


@query()
def gr_cluster_sites(s, d):
    return graph.cluster_sites(_sites(s, d), "asn", merge_km=900.0)


@query()
def gr_pop_mst(s, d):
    """Tree over each network's PoPs."""
    return graph.tree_of_points(graph.cluster_sites(_sites(s, d), "asn", merge_km=900.0), "asn", "site")


@query()
def gr_synth(s, d):
    """A synthetic topology of two thousand networks: each joins providers among the earlier ones, older ones more often, some pairs peer."""
    from weftline.operators.synthetic import topology

    return topology(s, 2000, 5)
