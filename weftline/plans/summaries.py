"""Summaries of feeds, networks and use: counts, crosstabs, rankings, funnels and spikes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import geo
from weftline.functions.geo import fixed
from weftline.operators import graph, intervals, places
from weftline.operators.ranking import global_rank
from weftline.plans import fixtures as fx
from weftline.plans.fixtures import with_sql
from weftline.plans.places import _METRO, _RANKED
from weftline.plans.relational import _HAV, _pop_links
from weftline.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_sql(uses, sql) if uses else sql
        return f

    return add


def _fix(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


@query("WITH a AS (SELECT s_suppkey AS asn, s_nationkey AS nk FROM supplier), o AS (SELECT asn, CASE WHEN asn % 5 <> 0 THEN n_name ELSE '' END AS org_name, CASE WHEN asn % 2 = 0 THEN concat('N', nk) ELSE '' END AS as_name, concat('O', nk) AS country FROM a JOIN nation ON n_nationkey = nk WHERE asn % 3 <> 0), g AS (SELECT asn, concat('G', n_regionkey) AS cc FROM a JOIN nation ON n_nationkey = nk WHERE asn % 4 <> 0) SELECT a.asn, coalesce(nullif(o.org_name, ''), nullif(o.as_name, ''), CASE WHEN a.asn % 7 = 0 THEN concat('P', a.asn) END, concat('AS', a.asn)) AS name, coalesce(g.cc, o.country, '') AS country FROM a LEFT JOIN o USING (asn) LEFT JOIN g USING (asn)")
def join_org(s, d):
    """A network's name by its organisation, its own record, its prefixes or its number; its country by its addresses, else by its organisation."""
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("asn"), F.col("s_nationkey").alias("n_nationkey")).join(table(s, d, "nation"), "n_nationkey")
    k = F.col("asn")
    org = a.where(k % 3 != 0).select("asn", F.when(k % 5 != 0, F.col("n_name")).otherwise("").alias("org_name"), F.when(k % 2 == 0, F.concat(F.lit("N"), "n_nationkey")).otherwise("").alias("as_name"), F.concat(F.lit("O"), "n_nationkey").alias("org_country"))
    named = a.where(k % 7 == 0).select("asn", F.concat(F.lit("P"), "asn").alias("prefix_name"))
    located = a.where(k % 4 != 0).select("asn", F.concat(F.lit("G"), "n_regionkey").alias("cc"))
    j = a.select("asn").join(org, "asn", "left").join(named, "asn", "left").join(located, "asn", "left")
    full = lambda c: F.nullif(c, F.lit(""))
    return j.select("asn", F.coalesce(full("org_name"), full("as_name"), full("prefix_name"), F.concat(F.lit("AS"), "asn")).alias("name"), F.coalesce("cc", "org_country", F.lit("")).alias("country"))


_DEMAND = "CASE WHEN v4_addresses > 0 THEN v4_addresses ELSE v4_prefixes + v6_prefixes END"


@query(f"WITH g AS (SELECT DISTINCT id, lat, lon, {_DEMAND} AS demand FROM regions WHERE lat IS NOT NULL AND lon IS NOT NULL), f AS (SELECT g.id, g.lat, g.lon, demand, min({_HAV.format(a='lat', b='lon', c='latitude_deg', d='longitude_deg')}) AS km FROM g, airports WHERE type = 'large_airport' AND latitude_deg IS NOT NULL GROUP BY ALL) SELECT id, demand, {_fix('km', 3)} AS km, row_number() OVER (ORDER BY demand DESC NULLS LAST, id, lat, lon) AS place FROM f WHERE {_fix('km', 3)} > 1000")
def join_anti_gap(s, d):
    """Regions without a large airport within 1000 km, by demand, with the distance of the nearest."""
    w = F.when(F.col("v4_addresses") > 0, F.col("v4_addresses")).otherwise(F.col("v4_prefixes") + F.col("v6_prefixes"))
    g = table(s, d, "regions").where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", w.alias("demand")).distinct()
    a = table(s, d, "airports").where("type = 'large_airport' AND latitude_deg IS NOT NULL").select(F.col("id").alias("aid"), "latitude_deg", "longitude_deg").distinct()
    km = fixed(geo.haversine("lat", "lon", "latitude_deg", "longitude_deg"), 3)
    near = intervals.nearest_k(g, a, ["id", "lat", "lon", "demand"], km, ["aid"]).withColumn("km", km).where("km > 1000").select("id", "lat", "lon", "demand", "km")
    return global_rank(near, [F.desc_nulls_last("demand"), F.col("id"), F.col("lat"), F.col("lon")], "place").select("id", "demand", "km", "place")


@query(f"WITH p AS (SELECT DISTINCT id, geometry.coordinates[2] AS lat, geometry.coordinates[1] AS lon FROM probes WHERE len(geometry.coordinates) >= 2), q AS (SELECT DISTINCT id, lat AS rlat, lon AS rlon FROM regions WHERE lat IS NOT NULL), k AS (SELECT {_fix(_HAV.format(a='lat', b='lon', c='rlat', d='rlon'), 3)} AS km FROM p JOIN q USING (id)) SELECT max(km) AS worst, {_fix('avg(km)', 3)} AS mean, count(*) AS n FROM k")
def join_check_anchors(s, d):
    """Modelled against given positions of the same key: the largest and the mean distance."""
    at = F.col("geometry.coordinates")
    p = table(s, d, "probes").where(F.size(at) >= 2).select("id", F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon")).distinct()
    q = table(s, d, "regions").where("lat IS NOT NULL").select("id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).distinct()
    k = p.join(q, "id").select(fixed(geo.haversine("lat", "lon", "rlat", "rlon"), 3).alias("km"))
    return k.agg(F.max("km").alias("worst"), fixed(F.avg("km"), 3).alias("mean"), F.count("*").alias("n"))


_DOT = "cos(radians({0}.lat)) * cos(radians({0}.lon)) * cos(radians({1}.lat)) * cos(radians({1}.lon)) + cos(radians({0}.lat)) * sin(radians({0}.lon)) * cos(radians({1}.lat)) * sin(radians({1}.lon)) + sin(radians({0}.lat)) * sin(radians({1}.lat))"
_D9 = "floor(({}) * 1e9 + 0.5)".format


@query(f"""WITH pops AS (SELECT node, slot, lat + slot * 3 AS lat, lon - slot * 5 AS lon FROM fx_node_pos, (SELECT unnest([0, 1, 2]) AS slot) WHERE node BETWEEN 2000000 AND 2999999 OR node BETWEEN 3000000 AND 3999999 AND node % 2 = 0 AND slot < 2),
has AS (SELECT DISTINCT node FROM pops), e AS (SELECT eid, a, b, a IN (SELECT node FROM has) AS ha, b IN (SELECT node FROM has) AS hb FROM fx_edges),
c AS (SELECT eid, p.slot AS sa, NULL::INT AS sb, {_D9(_DOT.format('p', 'q'))} AS dot FROM e JOIN pops p ON p.node = a JOIN fx_node_pos q ON q.node = b WHERE ha AND NOT hb
UNION ALL SELECT eid, NULL, p.slot, {_D9(_DOT.format('p', 'q'))} FROM e JOIN pops p ON p.node = b JOIN fx_node_pos q ON q.node = a WHERE hb AND NOT ha
UNION ALL SELECT eid, p.slot, q.slot, {_D9(_DOT.format('p', 'q'))} FROM e JOIN pops p ON p.node = a JOIN pops q ON q.node = b)
SELECT eid, sa AS slot_a, sb AS slot_b FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY dot DESC, coalesce(sa, -1), coalesce(sb, -1)) AS k FROM c) WHERE k = 1""", "fx_edges fx_node_pos")
def join_nearest_dot(s, d):
    """Where a link touches its ends' PoPs: of an end with PoPs the one that faces the other node, of two the closest pair; ties to the larger share (the first)."""
    pos = fx.node_positions(s, d)
    slots = F.when(F.col("node").between(2_000_000, 2_999_999), 3).when(F.col("node").between(3_000_000, 3_999_999) & (F.col("node") % 2 == 0), 2).otherwise(0)
    pops = pos.withColumn("n", slots).where("n > 0").select("node", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"), "lat", "lon").select("node", "slot", (F.col("lat") + F.col("slot") * 3).alias("lat"), (F.col("lon") - F.col("slot") * 5).alias("lon"))
    # a node has a dozen PoPs at most, so they travel with it as one list
    held = pops.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("slot", "lat", "lon"))).alias("pops"))
    node = pos.join(held, "node", "left").select("node", F.coalesce("pops", F.array(F.struct(F.lit(None).cast("int").alias("slot"), "lat", "lon"))).alias("at"), F.col("pops").isNotNull().alias("has"))
    e = fx.edges(s, d).select("eid", "a", "b")
    j = e.join(node.select(F.col("node").alias("a"), F.col("at").alias("pa"), F.col("has").alias("ha")), "a").join(node.select(F.col("node").alias("b"), F.col("at").alias("pb"), F.col("has").alias("hb")), "b").where("ha OR hb")
    dot = F.floor(geo.nearness("x.lat", "x.lon", "y.lat", "y.lon") * 1e9 + 0.5)
    pairs = j.select("eid", F.explode("pa").alias("x"), "pb").select("eid", "x", F.explode("pb").alias("y"))
    best = pairs.groupBy("eid").agg(F.min(F.struct((-dot).alias("d"), F.coalesce("x.slot", F.lit(-1)).alias("a"), F.coalesce("y.slot", F.lit(-1)).alias("b"))).alias("k"))
    return best.select("eid", F.nullif("k.a", F.lit(-1)).alias("slot_a"), F.nullif("k.b", F.lit(-1)).alias("slot_b"))


@query("WITH p AS (SELECT snap, trim(c0) AS c0, nullif(trim(c1), '') AS pop FROM pops), r AS (SELECT DISTINCT id, country, region, city, geo_precision FROM regions) SELECT 'lines' AS what, snap AS key, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'prefixes', snap, count(DISTINCT c0) FROM p GROUP BY 2 UNION ALL SELECT 'v4', snap, count(DISTINCT c0) FROM p WHERE c0 NOT LIKE '%:%' GROUP BY 2 UNION ALL SELECT 'v6', snap, count(DISTINCT c0) FROM p WHERE c0 LIKE '%:%' GROUP BY 2 UNION ALL SELECT 'pops', snap, count(DISTINCT lower(pop)) FROM p GROUP BY 2 UNION ALL SELECT 'with_pop', snap, count(DISTINCT c0) FILTER (pop IS NOT NULL) FROM p GROUP BY 2 UNION ALL SELECT 'without_pop', snap, count(DISTINCT c0) FILTER (pop IS NULL) FROM p GROUP BY 2 UNION ALL SELECT 'precision', coalesce(geo_precision, 'none'), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'regions', 'all', count(*) FROM (SELECT DISTINCT country, region, city FROM r) UNION ALL SELECT 'countries', 'all', count(DISTINCT country) FROM r")
def agg_feed_counts(s, d):
    """The counts block: of each delivery its lines, prefixes by family, with and without PoP, and PoPs; regions by precision; countries."""
    pop = F.nullif(F.trim("c1"), F.lit(""))
    p = table(s, d, "pops").select("snap", F.trim("c0").alias("c0"), pop.alias("pop"), F.contains(F.trim("c0"), F.lit(":")).alias("six"))
    when = lambda w: F.count_distinct(F.when(w, F.col("c0")))
    g = p.groupBy("snap").agg(F.count("*").alias("lines"), F.count_distinct("c0").alias("prefixes"), when(~F.col("six")).alias("v4"), when(F.col("six")).alias("v6"), F.count_distinct(F.lower("pop")).alias("pops"), when(F.col("pop").isNotNull()).alias("with_pop"), when(F.col("pop").isNull()).alias("without_pop"))
    by_snap = g.unpivot(["snap"], ["lines", "prefixes", "v4", "v6", "pops", "with_pop", "without_pop"], "what", "n").select("what", F.col("snap").alias("key"), "n")
    r = table(s, d, "regions").select("id", "country", "region", "city", "geo_precision").distinct()
    precise = r.groupBy(F.coalesce("geo_precision", F.lit("none")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("precision").alias("what"), "key", "n")
    places_ = r.select("country", "region", "city").distinct().agg(F.count("*").alias("n")).select(F.lit("regions"), F.lit("all"), "n")
    lands = r.agg(F.count_distinct("country").alias("n")).select(F.lit("countries"), F.lit("all"), "n")
    return by_snap.union(precise).union(places_).union(lands)


_CROSS = "x AS (SELECT id, p.code AS pop, max(p.prefixes) AS n FROM (SELECT id, unnest(pops) AS p FROM regions) WHERE p.code IS NOT NULL GROUP BY ALL)"


def _cross(s, d):
    """(id, pop, n): prefixes of a region that a PoP serves."""
    x = table(s, d, "regions").select("id", F.explode("pops").alias("p")).where("p.code IS NOT NULL")
    return x.groupBy("id", F.col("p.code").alias("pop")).agg(F.max("p.prefixes").alias("n"))


@query(f"WITH {_CROSS} SELECT 'pop' AS side, pop AS key, id::VARCHAR AS other, n, row_number() OVER (PARTITION BY pop ORDER BY n DESC NULLS LAST, id) AS place FROM x UNION ALL SELECT 'region', id::VARCHAR, pop, n, row_number() OVER (PARTITION BY id ORDER BY n DESC NULLS LAST, pop) FROM x")
def agg_pop_region(s, d):
    """Regions of each PoP and PoPs of each region, most prefixes first."""
    x, text = _cross(s, d), F.col("id").cast("string")
    a = x.select(F.lit("pop").alias("side"), F.col("pop").alias("key"), text.alias("other"), "n", F.row_number().over(Window.partitionBy("pop").orderBy(F.desc_nulls_last("n"), "id")).alias("place"))
    b = x.select(F.lit("region"), text, "pop", "n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("n"), "pop")))
    return a.union(b)


_IATA = "votes AS (SELECT lower(trim(c1)) AS pop, lower(trim(c2)) AS iata, count(DISTINCT trim(c0)) AS n, min(trim(c0)) AS first FROM pops WHERE nullif(trim(c1), '') IS NOT NULL GROUP BY 1, 2), named AS (SELECT pop, iata, n FROM (SELECT *, row_number() OVER (PARTITION BY pop ORDER BY n DESC, first, iata NULLS FIRST) AS k FROM votes) WHERE k = 1)"


def _dominant(s, d):
    """(pop, iata, n): the code most prefixes of a PoP are published with; of equals the one of the first prefix."""
    p = table(s, d, "pops").select(F.lower(F.trim("c1")).alias("pop"), F.lower(F.trim("c2")).alias("iata"), F.trim("c0").alias("c0")).where("pop <> ''")
    v = p.groupBy("pop", "iata").agg(F.count_distinct("c0").alias("n"), F.min("c0").alias("first"))
    return v.groupBy("pop").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "iata", "n")).alias("k")).select("pop", "k.iata", "k.n")


@query(f"WITH {_IATA} SELECT pop, iata, n FROM named")
def agg_pop_iata(s, d):
    """Each PoP's dominant airport code."""
    return _dominant(s, d)


_LATEST = "f AS (SELECT trim(c0) AS prefix, min(nullif(lower(trim(c1)), '')) AS pop FROM pops WHERE snap = (SELECT max(snap) FROM pops) GROUP BY 1), seen AS (SELECT trim(p) AS prefix, max(t) AS until FROM (SELECT data.timestamp AS t, unnest(flatten(list_transform(data.announcements, lambda x: x.prefixes))) AS p FROM ris_frames WHERE data.announcements IS NOT NULL) GROUP BY 1), cur AS (SELECT prefix, CASE WHEN prefix LIKE '%:%' THEN 1 ELSE 0 END AS six, f.prefix IS NOT NULL AS in_feed, pop FROM (SELECT prefix FROM seen WHERE until >= (SELECT max(until) - 86400 FROM seen)) LEFT JOIN f USING (prefix))"


@query(f"WITH {_LATEST} SELECT 'pop' AS what, pop, count(*) FILTER (six = 0) AS v4, count(*) FILTER (six = 1) AS v6 FROM cur WHERE pop IS NOT NULL GROUP BY 2 UNION ALL SELECT CASE WHEN NOT in_feed THEN 'not in feed' WHEN pop IS NULL THEN 'no pop' ELSE 'in feed' END, NULL, count(*) FILTER (six = 0), count(*) FILTER (six = 1) FROM cur GROUP BY 1 UNION ALL SELECT 'window', NULL, count(*) FILTER (prefix NOT LIKE '%:%'), count(*) FILTER (prefix LIKE '%:%') FROM seen".replace("SELECT prefix, CASE WHEN prefix LIKE", "SELECT c.prefix, CASE WHEN c.prefix LIKE").replace("FROM seen)) LEFT JOIN f USING (prefix))", "FROM seen)) c LEFT JOIN f USING (prefix))"))
def agg_announced(s, d):
    """Prefixes that are still announced on the last day, by PoP and by whether the feed's latest delivery has them; those announced at all in the window."""
    p = table(s, d, "pops")
    latest = F.broadcast(p.agg(F.max("snap").alias("snap")))
    f = p.join(latest, "snap").groupBy(F.trim("c0").alias("prefix")).agg(F.min(F.nullif(F.lower(F.trim("c1")), F.lit(""))).alias("pop")).withColumn("in_feed", F.lit(True))
    r = table(s, d, "ris_frames").where("data.announcements IS NOT NULL")
    seen = r.select("data.timestamp", F.explode(F.flatten(F.transform("data.announcements", lambda x: x["prefixes"]))).alias("p")).groupBy(F.trim("p").alias("prefix")).agg(F.max("timestamp").alias("until"))
    end = F.broadcast(seen.agg(F.max("until").alias("end")))
    cur = seen.crossJoin(end).where(F.col("until") >= F.col("end") - 86_400).select("prefix").join(f, "prefix", "left")
    six = F.contains("prefix", F.lit(":"))
    both = (F.count_if(~six).alias("v4"), F.count_if(six).alias("v6"))
    fate = F.when(F.col("in_feed").isNull(), "not in feed").when(F.col("pop").isNull(), "no pop").otherwise("in feed")
    none = F.lit(None).cast("string").alias("pop")
    return cur.where("pop IS NOT NULL").groupBy("pop").agg(*both).select(F.lit("pop").alias("what"), "pop", "v4", "v6").union(cur.groupBy(fate.alias("what")).agg(*both).select("what", none, "v4", "v6")).union(seen.agg(*both).select(F.lit("window"), none, "v4", "v6"))


@query("WITH h AS (SELECT data.path AS path, unnest(range(1, len(data.path) + 1)) AS i FROM ris_frames WHERE data.path IS NOT NULL), n AS (SELECT path[i] AS asn, CASE WHEN i > 1 THEN path[i - 1] END AS l, CASE WHEN i < len(path) THEN path[i + 1] END AS r FROM h), u AS (SELECT asn, 'left' AS side, l AS other FROM n WHERE l <> asn UNION ALL SELECT asn, 'right', r FROM n WHERE r <> asn) SELECT asn, side, other, count(*) AS power, row_number() OVER (PARTITION BY asn, side ORDER BY count(*) DESC, other) AS place FROM u GROUP BY 1, 2, 3")
def agg_neighbours(s, d):
    """Each network's neighbours on the way to the collector (left) and away from it (right), the most often seen first."""
    r = table(s, d, "ris_frames").where("data.path IS NOT NULL").select(F.col("data.path").alias("path"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))
    p = r.where(F.size("path") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = p.select(F.col("b").alias("asn"), F.lit("left").alias("side"), F.col("a").alias("other"), F.col("n").alias("power")).union(p.select("a", F.lit("right"), "b", "n"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("asn", "side").orderBy(F.desc("power"), "other")))


_VIS = "ann AS (SELECT DISTINCT data.host AS host, data.peer AS peer, trim(p) AS prefix, CASE WHEN trim(p) LIKE '%:%' THEN 6 ELSE 4 END AS af FROM (SELECT data, unnest(flatten(list_transform(data.announcements, lambda x: x.prefixes))) AS p FROM ris_frames WHERE data.announcements IS NOT NULL AND data.host IS NOT NULL)), per AS (SELECT host, peer, af, count(*) AS n FROM ann GROUP BY ALL), full_ AS (SELECT host, peer, per.af FROM per JOIN (SELECT af, max(n) AS m FROM per GROUP BY 1) x ON x.af = per.af WHERE 2 * n >= m), ours AS (SELECT af, prefix FROM (SELECT af, prefix, row_number() OVER (PARTITION BY af ORDER BY count(*) DESC, prefix) AS k FROM ann GROUP BY 1, 2) WHERE k = 1), j AS (SELECT f.host, f.af, CASE WHEN a.host IS NULL THEN 1 ELSE 0 END AS miss FROM full_ f JOIN ours o USING (af) LEFT JOIN ann a ON a.host = f.host AND a.peer IS NOT DISTINCT FROM f.peer AND a.prefix = o.prefix), c AS (SELECT h.host, count(j.host) FILTER (af = 4) AS full_v4, count(j.host) FILTER (af = 6) AS full_v6, coalesce(sum(miss) FILTER (af = 4), 0)::BIGINT AS missing_v4, coalesce(sum(miss) FILTER (af = 6), 0)::BIGINT AS missing_v6 FROM (SELECT DISTINCT data.host AS host FROM ris_frames WHERE data.host IS NOT NULL) h LEFT JOIN j ON j.host = h.host GROUP BY 1)"


@query(f"WITH {_VIS} SELECT *, CASE WHEN missing_v4 + missing_v6 > 0 AND row_number() OVER (ORDER BY missing_v4 + missing_v6 DESC, host) <= 5 THEN row_number() OVER (ORDER BY missing_v4 + missing_v6 DESC, host) END::INT AS worst FROM c")
def agg_visibility(s, d):
    """Of each collector the full-table peers (half of the largest table or more), those of them that miss the prefix seen by most, and the five worst collectors."""
    r = table(s, d, "ris_frames").where("data.host IS NOT NULL")
    ann = r.where("data.announcements IS NOT NULL").select("data.host", "data.peer", F.explode(F.flatten(F.transform("data.announcements", lambda x: x["prefixes"]))).alias("p")).select("host", "peer", F.trim("p").alias("prefix"), F.when(F.contains("p", F.lit(":")), 6).otherwise(4).alias("af")).distinct()
    per = ann.groupBy("host", "peer", "af").agg(F.count("*").alias("n"))
    full = per.join(F.broadcast(per.groupBy("af").agg(F.max("n").alias("m"))), "af").where("2 * n >= m").select("host", "peer", "af")
    votes = ann.groupBy("af", "prefix").agg(F.count("*").alias("n"))
    ours = F.broadcast(votes.groupBy("af").agg(F.min(F.struct((-F.col("n")).alias("m"), "prefix")).alias("k")).select("af", "k.prefix"))
    has = ann.join(ours, ["af", "prefix"], "left_semi").select(F.col("host").alias("h"), F.col("peer").alias("q"), F.col("af").alias("f"), F.lit(1).alias("sees"))
    j = full.join(has, (F.col("host") == F.col("h")) & F.col("peer").eqNullSafe(F.col("q")) & (F.col("af") == F.col("f")), "left")
    count = lambda w: F.count_if(w)
    four, six, miss = F.col("af") == 4, F.col("af") == 6, F.col("sees").isNull()
    c = r.select("data.host").distinct().join(j.groupBy("host").agg(count(four).alias("full_v4"), count(six).alias("full_v6"), count(four & miss).alias("missing_v4"), count(six & miss).alias("missing_v6")), "host", "left").na.fill(0)
    top = c.where("missing_v4 + missing_v6 > 0").orderBy(F.desc(F.col("missing_v4") + F.col("missing_v6")), "host").limit(5).select("host", F.row_number().over(Window.orderBy(F.desc(F.col("missing_v4") + F.col("missing_v6")), "host")).alias("worst"))
    return c.join(F.broadcast(top), "host", "left")


@query("WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), m AS (SELECT user_id, median(gap) AS spacing_us FROM g WHERE gap IS NOT NULL GROUP BY 1) SELECT user_id, spacing_us, coalesce(spacing_us <= 7500000, false) AS resolves FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN m USING (user_id)")
def agg_resolution(s, d):
    """Median spacing of a source's samples, and whether it shows steps of fifteen seconds: two samples in each at least."""
    e = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = e.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return g.groupBy("user_id").agg(F.median("gap").alias("spacing_us")).withColumn("resolves", F.coalesce(F.col("spacing_us") <= 7_500_000, F.lit(False)))


_PLACED = f"{_IATA}, {_RANKED}, {_METRO}, best AS (SELECT lower(trim(iata_code)) AS k, arg_min((latitude_deg, longitude_deg), (r1, r2, id, latitude_deg, longitude_deg)) AS p FROM ranked WHERE len(trim(iata_code)) = 3 GROUP BY 1), spot AS (SELECT pop, coalesce(x.p, y.p) AS p FROM (SELECT pop, regexp_replace(iata, '\\d+$', '') AS bare FROM named) LEFT JOIN best x ON x.k = bare AND len(bare) = 3 LEFT JOIN metro ON area = bare LEFT JOIN best y ON y.k = main)"


@query(f"WITH {_CROSS}, {_PLACED}, g AS (SELECT id, min((lat, lon)) AS q FROM regions WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1), a AS (SELECT x.id, x.pop, x.n AS prefixes, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN {_fix(_HAV.format(a='q[1]', b='q[2]', c='p[1]', d='p[2]'), 3)} END AS km FROM x LEFT JOIN g USING (id) LEFT JOIN spot ON spot.pop = lower(x.pop)) SELECT id, pop, prefixes, km, row_number() OVER (PARTITION BY id ORDER BY prefixes DESC NULLS LAST, pop) = 1 AS main, {_fix('prefixes / greatest(sum(prefixes) OVER (PARTITION BY pop), 1)::DOUBLE')} AS share, CASE WHEN km IS NOT NULL AND row_number() OVER (ORDER BY km DESC NULLS LAST, id, pop) <= 10 THEN row_number() OVER (ORDER BY km DESC NULLS LAST, id, pop) END::INT AS far FROM a")
def agg_assignments(s, d):
    """Regions and the PoPs that serve them: prefixes, distance, whether it is the region's main PoP, its share of the PoP, and the ten farthest."""
    x = _cross(s, d)
    at = places.airport_of(_dominant(s, d).select(F.col("pop").alias("lp"), "iata"), "iata", table(s, d, "airports"))
    spots = table(s, d, "airports").where("latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL").groupBy(F.col("id").alias("airport")).agg(F.min(F.struct(F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))).alias("p"))
    at = at.join(spots, "airport").select("lp", F.col("p.lat").alias("plat"), F.col("p.lon").alias("plon"))
    g = table(s, d, "regions").where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("q")).select("id", "q.lat", "q.lon")
    a = x.join(g, "id", "left").join(at, F.lower("pop") == F.col("lp"), "left").select("id", "pop", F.col("n").alias("prefixes"), fixed(geo.haversine("lat", "lon", "plat", "plon"), 3).alias("km"))
    main = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("prefixes"), "pop")) == 1
    share = fixed(F.col("prefixes") / F.greatest(F.sum("prefixes").over(Window.partitionBy("pop")), F.lit(1)))
    far = a.where("km IS NOT NULL").orderBy(F.desc("km"), "id", "pop").limit(10).select("id", "pop", F.row_number().over(Window.orderBy(F.desc("km"), "id", "pop")).alias("far"))
    return a.select("id", "pop", "prefixes", "km", main.alias("main"), share.alias("share")).join(F.broadcast(far), ["id", "pop"], "left")


_STEPS = (("event_type = 'view'", "event_type = 'view'"), ("event_type = 'click'", "event_type = 'click'"), ("event_type = 'purchase' OR get_json_object(props, '$.k') LIKE '%1'", "event_type = 'purchase' OR props->>'k' LIKE '%1'"), ("event_type IN ('signup', 'logout', 'error')", "event_type IN ('signup', 'logout', 'error')"))


@query("WITH t1 AS (SELECT user_id, min(ts) AS t FROM events WHERE " + _STEPS[0][1] + " GROUP BY 1)" + "".join(f", t{k} AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN t{k - 1} p ON p.user_id = e.user_id AND e.ts >= p.t WHERE {_STEPS[k - 1][1]} GROUP BY 1)" for k in (2, 3, 4)) + " SELECT step, users FROM (" + " UNION ALL ".join(f"SELECT {k} AS step, count(*) AS users FROM t{k}" for k in (1, 2, 3, 4)) + ")")
def agg_funnel(s, d):
    """An ordered funnel of four steps, each at or after the last one's first time; the third also takes events by a parameter."""
    e = table(s, d, "events").select("user_id", "ts", "event_type", "props")
    at, out = None, []
    for k, (where, _) in enumerate(_STEPS, 1):
        mine = e.where(where)
        if at is not None:
            mine = mine.join(at, "user_id").where(F.col("ts") >= F.col("t"))
        at = mine.groupBy("user_id").agg(F.min("ts").alias("t"))
        out.append(at.agg(F.lit(k).alias("step"), F.count("*").alias("users")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"WITH h AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1), z AS (SELECT start, n, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd FROM h WINDOW w AS (PARTITION BY hour(start) ORDER BY start RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING)) SELECT start, n, {_fix('(n - m) / nullif(sd, 0)', 3)} AS z, coalesce((n - m) / nullif(sd, 0) >= 4 AND n - m >= 8, false) AS spike FROM z")
def agg_spikes(s, d):
    """Each hour against the same hour of the fourteen days before: a spike stands four deviations and eight events above their mean."""
    h = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))
    h = h.withColumn("sec", F.unix_seconds(F.col("start").cast("timestamp")))
    w = Window.partitionBy(F.hour("start")).orderBy("sec").rangeBetween(-14 * 86_400, -1)
    z = h.withColumn("m", F.avg("n").over(w)).withColumn("sd", F.nullif(F.stddev_samp("n").over(w), F.lit(0.0)))
    score = (F.col("n") - F.col("m")) / F.col("sd")
    return z.select("start", "n", fixed(score, 3).alias("z"), F.coalesce((score >= 4) & (F.col("n") - F.col("m") >= 8), F.lit(False)).alias("spike"))


@query("WITH deg AS (SELECT o_custkey AS k, count(*) AS degree FROM orders GROUP BY 1), i AS (SELECT c_custkey AS asn, lower(c_name) AS name, coalesce(degree, 0) AS degree FROM customer LEFT JOIN deg ON k = c_custkey), hits AS (SELECT * FROM i WHERE contains(name, '11') OR starts_with(asn::VARCHAR, '11') ORDER BY asn LIMIT 400), r AS (SELECT asn, 0 AS first, degree FROM i WHERE asn = 11 UNION SELECT asn, 1, degree FROM hits WHERE asn <> 11) SELECT asn, row_number() OVER (ORDER BY first, degree DESC, asn) AS place FROM r QUALIFY place <= 25")
def topk_search(s, d):
    """A search: the exact number first, then of the first 400 hits in the name or at the start of the number those with the highest degree, 25 in all."""
    q = "11"
    deg = table(s, d, "orders").groupBy(F.col("o_custkey").alias("asn")).agg(F.count("*").alias("degree"))
    i = table(s, d, "customer").select(F.col("c_custkey").alias("asn"), F.lower("c_name").alias("name"))
    hits = i.where(F.contains("name", F.lit(q)) | F.startswith(F.col("asn").cast("string"), F.lit(q))).orderBy("asn").limit(400).select("asn", F.lit(1).alias("first"))
    exact = i.where(F.col("asn") == int(q)).select("asn", F.lit(0).alias("first"))
    found = hits.where(F.col("asn") != int(q)).union(exact).join(deg, "asn", "left").na.fill(0, ["degree"])
    return found.withColumn("place", F.row_number().over(Window.orderBy("first", F.desc("degree"), "asn"))).where("place <= 25").select("asn", "place")  # 401 rows at most


@query("WITH li AS (SELECT s_nationkey AS x, c_nationkey AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), l AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS w FROM li WHERE x <> y GROUP BY 1, 2), n AS (SELECT a AS node, b AS other, w FROM l UNION ALL SELECT b, a, w FROM l), g AS (SELECT node, count(*) AS degree FROM n GROUP BY 1) SELECT n.node, other, w AS weight, row_number() OVER (PARTITION BY n.node ORDER BY w DESC, degree DESC, other) AS place FROM n JOIN g ON g.node = other QUALIFY place <= 40")
def topk_neighbours(s, d):
    """The forty neighbours of each node by the weight of the link, then by their own degree, from both ends of the links."""
    e = _pop_links(s, d).withColumn("rel", F.lit(0)).withColumn("eid", F.lit(0))
    n = graph.both_ways(e).select("node", "other").join(e.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight"), (F.least("node", "other") == F.col("x")) & (F.greatest("node", "other") == F.col("y")))
    deg = n.groupBy("node").agg(F.count("*").alias("degree")).select(F.col("node").alias("other"), "degree")
    w = Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("degree"), "other")
    return n.join(deg, "other").withColumn("place", F.row_number().over(w)).where("place <= 40").select("node", "other", "weight", "place")
