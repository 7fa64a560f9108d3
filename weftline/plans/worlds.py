"""Queries over satellites, layouts, tiles, file parsers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.geo import fixed
from weftline.operators import graph, layout, orbit, raster
from weftline.plans import fixtures as fx
from weftline.plans.fixtures import with_sql
from weftline.plans.problems import trace_replies
from weftline.plans.relational import _merc_links
from weftline.plans.tables import table
from weftline.session import staged_path
from weftline.sources import feeds, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_sql(uses, sql) if uses else sql
        return f

    return add


def _constellation(s, d):
    """A synthetic constellation: every supplier is a satellite of one of two shells, twenty-five planes each."""
    sup = table(s, d, "supplier")
    odd = F.col("s_suppkey") % 2
    slot = F.floor(F.col("s_suppkey") / 50)
    return sup.select(F.col("s_suppkey").alias("sat"), F.when(odd == 1, 15.06).otherwise(15.25).alias("mean_motion"), F.lit(0.0001).alias("ecc"), F.when(odd == 1, 53.05).otherwise(70.0).alias("incl"), (F.floor(F.col("s_suppkey") % 50 / 2) * 14.4).alias("node"), F.lit(90.0).alias("argp"), F.pmod(slot * 51.4 + F.col("s_suppkey") % 50 * 3.0, F.lit(360.0)).alias("mean"), F.lit(0.0001).alias("bstar"))


def _states(s, d, minutes=(0.0,)):
    c = _constellation(s, d).withColumn("minutes", F.explode(F.array(*[F.lit(float(m)) for m in minutes])))
    return orbit.propagate(c)


@query()
def gr_sgp4(s, d):
    """Places of the constellation over ten minutes."""
    st = _states(s, d, range(10))
    return st.select("sat", "minutes", *[fixed(c, 3).alias(c) for c in ("x", "y", "z")])


@query()
def gr_orbit_angles(s, d):
    return orbit.orbit_angles(_states(s, d)).select("sat", fixed("raan", 3).alias("raan"), fixed("u", 3).alias("u"))


@query()
def gr_shells(s, d):
    from weftline.functions.geo import orbit_altitude_km

    c = _constellation(s, d).select("sat", "incl", orbit_altitude_km("mean_motion").alias("alt"))
    return orbit.shells(c, least=20)


def _planes(s, d):
    st = orbit.orbit_angles(_states(s, d)).withColumn("shell", (F.col("sat") % 2).cast("int"))
    return orbit.planes(st, ["shell"], least=2), st


@query()
def gr_planes(s, d):
    return _planes(s, d)[0].select("shell", "sat", "plane")


@query()
def gr_grid(s, d):
    """The laser mesh: the ring in each plane and the nearest ones of the next plane, within range."""
    p, st = _planes(s, d)
    ring = orbit.ring_links(p, ["shell", "plane"]).select("a", "b", F.lit("in-plane").alias("kind"))
    cross = orbit.cross_links(p.join(st.select("sat", "x", "y", "z"), "sat"), ["shell"]).select("a", "b", F.lit("cross-plane").alias("kind"))
    return ring.union(cross)


def _options(s, d):
    """Which satellites each customer nation sees, by their ground points; one in three sees a gateway."""
    from weftline.operators.spatial import near_pairs

    st = _states(s, d).select("sat", F.degrees(F.atan2("z", F.hypot("x", "y"))).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"))
    n = fx.node_positions(s, d).where("node BETWEEN 2000000 AND 2999999")
    p = near_pairs(n, st, {"node": "point"}, {"sat": "sat"}, 4000.0)
    return p.select("point", "sat", (90 - F.col("km") / 50).alias("elevation"), (F.col("sat") % 3 == 0).alias("terminal"), F.when(F.col("sat") % 3 == 1, F.col("km") / 200).alias("cost"))


@query()
def gr_serve(s, d):
    return orbit.serving(_options(s, d), "point", "cost")


@query()
def agg_traffic(s, d):
    """The load of each gateway, if every nation's demand is its number of customers."""
    served = orbit.serving(_options(s, d), "point", "cost").select("point", "sat")
    demand = table(s, d, "customer").groupBy((F.col("c_nationkey") + 2_000_000).cast("long").alias("point")).agg(F.count("*").alias("weight"))
    exits = table(s, d, "supplier").select(F.col("s_suppkey").alias("sat"), F.col("s_nationkey").alias("gateway"))
    return orbit.traffic(demand, served, exits, "point").select("gateway", "load", fixed("share").alias("share"))


@query()
def agg_model_summary(s, d):
    p, _ = _planes(s, d)
    return p.groupBy("shell").agg(F.count("*").alias("satellites"), F.count_distinct("plane").alias("planes"))


# --- layouts and tiles --------------------------------------------------------------


def _cyber(s, d):
    e = fx.edges(s, d)
    return layout.tree_layout(e, 15), e


@query()
def lay_lgl(s, d):
    lay, _ = _cyber(s, d)
    return lay.select("component", "node", fixed("x", 3).alias("x"), fixed("y", 3).alias("y"))


@query()
def lay_cyber(s, d):
    lay, _ = _cyber(s, d)
    return layout.fit_square(lay).select("node", fixed("x", 3).alias("x"), fixed("y", 3).alias("y"))


@query()
def lay_opte(s, d):
    """Hub-and-spoke tree with the regions pinned on a circle."""
    e = fx.edges(s, d)
    turn = (F.col("node") % 10) * 1.2566
    pins = fx.nodes(s, d).where("node BETWEEN 1000000 AND 1999999").select("node", (F.cos(turn) * 4).alias("px"), (F.sin(turn) * 4).alias("py"))
    return layout.spring_tree(e, pins, 10).select("node", fixed("x", 3).alias("x"), fixed("y", 3).alias("y"))


@query("SELECT node FROM fx_node_pos", "fx_node_pos")
def lay_geo(s, d):
    """The map layout: places fanned out by degree; all nodes that have one."""
    from weftline.operators.profiles import fan_out

    g = graph.degrees(fx.edges(s, d)).select("node", "degree")
    return fan_out(fx.node_positions(s, d).join(g, "node", "left").fillna(0, ["degree"]), "node", "degree").select("node")


def _inked(s, d):
    return _merc_links(s, d).withColumn("r", F.when(F.col("rel") == 0, 0.2).otherwise(1.0)).withColumn("g", F.lit(0.6)).withColumn("b", F.when(F.col("rel") == 0, 1.0).otherwise(0.2))


@query()
def ras_scene(s, d):
    """Segments with colours, short ones in full ink, long ones thinned."""
    e = _inked(s, d).withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    ink = F.least(F.lit(1.0), F.pow(0.004 / F.greatest("length", F.lit(1e-9)), F.lit(0.6)))
    return e.select("eid", fixed(ink).alias("ink"), "r", "g", "b")


@query()
def ras_splat(s, d):
    return raster.pixel_sums(_inked(s, d), 0)


_TILES = "l AS (SELECT eid, (p.lon + 180) / 360 AS ax, 0.5 - ln((1 + sin(radians(p.lat))) / (1 - sin(radians(p.lat)))) / (4 * pi()) AS ay, (q.lon + 180) / 360 AS bx, 0.5 - ln((1 + sin(radians(q.lat))) / (1 - sin(radians(q.lat)))) / (4 * pi()) AS cy FROM fx_edges JOIN fx_node_pos p ON p.node = a JOIN fx_node_pos q ON q.node = b), zz AS (SELECT unnest(range(8)) AS z), lz AS (SELECT *, pow(2, z) AS n FROM l, zz WHERE greatest(ax, bx) >= 0 AND least(ax, bx) < 1 AND greatest(ay, cy) >= 0 AND least(ay, cy) < 1), c AS (SELECT *, unnest(range(greatest(0, floor(least(ax, bx) * n)::BIGINT), least(n - 1, floor(greatest(ax, bx) * n))::BIGINT + 1)) AS x FROM lz), y AS (SELECT *, ay + (cy - ay) * CASE WHEN bx = ax THEN 0 ELSE least(1.0, greatest(0.0, (x / n - ax) / (bx - ax))) END AS u, ay + (cy - ay) * CASE WHEN bx = ax THEN 1 ELSE least(1.0, greatest(0.0, ((x + 1) / n - ax) / (bx - ax))) END AS v FROM c), u AS (SELECT z, x, unnest(range(greatest(0, floor(least(u, v) * n)::BIGINT), least(n - 1, floor(greatest(u, v) * n))::BIGINT + 1)) AS y FROM y)"


@query(f"WITH {_TILES} SELECT z::INT AS z, x, y, count(*) AS links FROM u GROUP BY 1, 2, 3", "fx_edges fx_node_pos")
def ras_pyramid(s, d):
    """Links of every tile of the pyramid, levels 0 to 7."""
    return raster.tile_segments(_inked(s, d), list(range(8))).groupBy("z", "x", "y").agg(F.count("*").alias("links"))


@query()
def snk_tiles(s, d):
    """The pyramid as pictures of 256 pixels, levels 0 to 5."""
    t = raster.render_tiles(_inked(s, d), list(range(6)))
    return t.select("z", "x", "y", "lit", F.octet_length("png").alias("bytes"))


# --- parsers: the driver's tables written as feed lines and read again -----------------


def _lines(df, value, order):
    return df.select(order.alias("line"), value.alias("value"))


@query('SELECT start, "end", asn FROM fx_prefix', "fx_prefix")
def src_prefix_csv(s, d):
    p = fx.prefixes(s, d)
    junk = s.createDataFrame([(-1, "start,end,asn"), (-2, "1,2"), (-3, "")], "line long, value string")
    lines = _lines(p, F.concat_ws(",", "start", "end", "asn", F.concat(F.lit("Org "), F.col("asn"))), F.col("start")).union(junk)
    return feeds.prefix_ranges(lines).select("start", "end", "asn")


@query("SELECT start, \"end\", lat::FLOAT::DOUBLE AS lat, lon::FLOAT::DOUBLE AS lon, cc, city FROM fx_geo", "fx_geo")
def src_geo_csv(s, d):
    g = fx.places(s, d)
    lines = _lines(g, F.concat_ws(",", "start", "end", "cc", F.lit("state"), F.lit(""), "city", F.lit(""), F.col("lat"), F.col("lon")), F.col("start"))
    return feeds.place_ranges(lines).select("start", "end", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "cc", "city")


@query("SELECT a, b, rel FROM fx_edges", "fx_edges")
def src_asrel(s, d):
    e = fx.edges(s, d)
    lines = _lines(e, F.concat_ws("|", "a", "b", "rel", F.lit("bgp")), F.col("eid")).union(s.createDataFrame([(0, "# source"), (1, "a|b|c")], "line long, value string"))
    return feeds.relationships(lines).select("a", "b", "rel")


@query("SELECT node AS asn, row_number() OVER (ORDER BY node) - 1 AS node FROM fx_nodes", "fx_nodes")
def src_node_ids(s, d):
    return feeds.node_numbers(fx.edges(s, d).select("a", "b"))


@query("SELECT s_suppkey AS asn, s_name AS name, n_name AS org FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def src_as2org(s, d):
    sup, n = table(s, d, "supplier"), table(s, d, "nation")
    a = _lines(n, F.concat_ws("|", F.concat(F.lit("N"), "n_nationkey"), F.lit("20260101"), "n_name", F.lit("XX"), F.lit("src")), F.col("n_nationkey").cast("long") + 10)
    b = _lines(sup, F.concat_ws("|", "s_suppkey", F.lit("20260101"), "s_name", F.concat(F.lit("N"), "s_nationkey"), F.lit(""), F.lit("src")), F.col("s_suppkey") + 1_000_000)
    heads = s.createDataFrame([(1, "# format:org_id|changed|org_name|country|source"), (999_999, "# format:aut|changed|aut_name|org_id|opaque_id|source")], "line long, value string")
    return feeds.organisations(a.union(b).union(heads)).select("asn", "name", "org")


@query("SELECT s_suppkey AS router, s_nationkey::BIGINT AS asn FROM supplier WHERE s_nationkey > 0")
def src_itdk_as(s, d):
    sup = table(s, d, "supplier")
    return feeds.router_networks(_lines(sup, F.concat(F.lit("node.AS N"), "s_suppkey", F.lit(" "), "s_nationkey", F.lit(" refinement")), F.col("s_suppkey")))


@query("SELECT s_suppkey AS router, concat('C', s_nationkey, '|R|T') AS place FROM supplier")
def src_itdk_geo(s, d):
    sup = table(s, d, "supplier")
    text = F.concat_ws("\t", F.concat(F.lit("node.geo N"), "s_suppkey", F.lit(":")), F.lit("EU"), F.concat(F.lit("C"), "s_nationkey"), F.lit("R"), F.lit("T"), F.lit("1.5"), F.lit("2.5"))
    return feeds.router_places(_lines(sup, text, F.col("s_suppkey"))).select("router", "place")


@query("WITH g AS (SELECT l_orderkey AS link, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS c, l_partkey AS n FROM lineitem) SELECT x.link, x.n AS x, y.n AS y FROM g x JOIN g y ON x.link = y.link AND x.k < y.k AND (x.c <= 8 OR x.k = 1)")
def src_itdk_links(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("N"), x["l_partkey"], F.lit(":10.0.0.1"))).alias("n"))
    return feeds.router_links(_lines(li, F.concat(F.lit("link L"), "l_orderkey", F.lit(":  "), F.array_join("n", " ")), F.col("l_orderkey")))


@query()
def src_pops(s, d):
    """The PoP feed of the latest delivery, both families: canonical prefixes, the first line of each."""
    p = table(s, d, "pops")
    latest = F.broadcast(p.agg(F.max("snap").alias("snap")))
    lines = p.join(latest, "snap").select(F.col("line_no").alias("line"), F.concat_ws(",", "c0", F.coalesce("c1", F.lit("")), F.coalesce("c2", F.lit(""))).alias("value"))
    return feeds.pop_feed(lines).select("prefix", "pop", "iata")


@query()
def src_feed(s, d):
    """A geofeed of the regions' PoP prefixes, canonical, the first line of each prefix."""
    p = table(s, d, "pops")
    lines = p.select(F.struct("snap", "line_no").alias("line"), F.concat_ws(",", "c0", F.lit("us"), F.lit("us-wa"), "c1").alias("value"))
    return feeds.geofeed(lines).select("prefix", "version", "plen", "country", "region", "city")


@query("SELECT lower(iata_code) AS code, min(struct_pack(a := CASE type WHEN 'large_airport' THEN 0 WHEN 'medium_airport' THEN 1 ELSE 2 END, b := CASE WHEN scheduled_service = 'yes' THEN 0 ELSE 1 END, c := id))['c'] AS id FROM airports WHERE iata_code IS NOT NULL AND latitude_deg IS NOT NULL GROUP BY 1")
def src_airports(s, d):
    return feeds.airport_ranks(table(s, d, "airports")).select("code", "id")


@query("SELECT id::VARCHAR AS id, round(latitude_deg, 6) AS lat FROM (SELECT DISTINCT id, latitude_deg FROM airports WHERE latitude_deg IS NOT NULL)")
def src_site_yaml(s, d):
    a = table(s, d, "airports").where("latitude_deg IS NOT NULL").select("id", "latitude_deg").distinct()
    doc = a.select(F.col("id").cast("string").alias("path"), F.concat(F.lit("- id: "), "id", F.lit("\n  lat: "), "latitude_deg", F.lit("\n  notes: |\n    a  b\n    c\n")).alias("content"))
    return feeds.site_documents(doc).select("id", F.round("lat", 6).alias("lat"))


@query("WITH v AS (SELECT rec_id, list_filter(list_transform(coalesce(result, []), lambda r: r.rtt), lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) AS v FROM pings) SELECT rec_id, floor(list_median(v) * 1000 + 0.5) / 1000 AS rtt FROM v".replace("list_median(v)", "list_aggregate(v, 'median')"))
def src_ping(s, d):
    return feeds.ping_results(table(s, d, "pings")).select("rec_id", fixed("rtt", 3).alias("rtt"))


@query()
def src_traceroute(s, d):
    return feeds.trace_hops(trace_replies(s, d)).select("rec_id", "hop_pos", "hop", "ip", fixed("rtt", 3).alias("rtt"), "replies")


@query("SELECT user_id AS trace, event_id, hop FROM (SELECT user_id, event_id, (event_id % 200 + 1)::INT AS hop, lag((event_id % 200 + 1)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type <> 'view') WHERE p IS DISTINCT FROM hop")
def src_trace_text(s, d):
    """A pasted trace for each user: a hop for each event, other lines for views."""
    hop = F.concat(F.lit("  "), F.col("event_id") % 200 + 1, F.lit("  core-10-1-2-3.example.net (10.1.2.3)  1.5 ms"))
    lines = table(s, d, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("line"), F.when(F.col("event_type") == "view", "traceroute to example").otherwise(hop).alias("value"))
    return feeds.pasted_trace(lines).select("trace", F.col("line").alias("event_id"), "hop")


@query("SELECT event_id, ts FROM events")
def src_parse_utc(s, d):
    from weftline.functions.text import utc_timestamp

    e = table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"))
    return e.select("event_id", utc_timestamp("t").cast("timestamp_ntz").alias("ts"))


@query("SELECT min(start) AS least, max(start) AS most, count(*) AS n FROM fx_prefix", "fx_prefix")
def src_ip2asn(s, d):
    """A boundary table written and read again."""
    out = staged_path(s, "lookup")
    sinks.write_lookup(fx.prefixes(s, d).select("start", "asn"), out, "start")
    return s.read.parquet(out).agg(F.min("start").alias("least"), F.max("start").alias("most"), F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def src_columnar_json(s, d):
    n = table(s, d, "nation")
    doc = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r")).select(F.col("r.n_nationkey").alias("n_nationkey"), F.col("r.n_name").alias("n_name"))
    return feeds.zipped_columns(doc, ["n_nationkey", "n_name"]).select("n_nationkey", "n_name")


def _bundle(s, d):
    out = staged_path(s, "bundles")
    n = graph.degrees(fx.edges(s, d))
    meta = sinks.write_bundle(f"{out}/map", n, fx.edges(s, d), "map", n.select("node", F.to_json(F.struct("degree")).alias("record")))
    return out, meta


@query("SELECT (SELECT count(*) FROM fx_nodes) AS nodes, count(*) AS edges, count(*) FILTER (rel = -1) AS p2c FROM fx_edges", "fx_nodes")
def snk_bundle(s, d):
    _, meta = _bundle(s, d)
    return s.createDataFrame([(meta["nodes"], meta["edges"], meta["p2c"])], "nodes long, edges long, p2c long")


@query("SELECT node, degree FROM (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM fx_edges UNION ALL SELECT b FROM fx_edges) GROUP BY 1)", "fx_edges")
def src_bundle(s, d):
    out, _ = _bundle(s, d)
    return sinks.read_bundle(s, f"{out}/map")[1].select("node", "degree")


@query("SELECT 'map' AS folder")
def snk_index(s, d):
    out, _ = _bundle(s, d)
    return sinks.catalogue(s, out).select("folder")


@query()
def snk_digests(s, d):
    """Digest of every file of a bundle."""
    out, _ = _bundle(s, d)
    return sinks.digests(s, f"{out}/map").where(F.contains("path", F.lit("/meta/"))).select("bytes", "sha256")


@query("SELECT n_nationkey, n_name FROM nation")
def snk_json(s, d):
    out = staged_path(s, "records")
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    sinks.write_json_records(n, out)
    return s.read.schema(n.schema).json(out)


