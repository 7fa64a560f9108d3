"""Queries over joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import geo
from weftline.functions.geo import fixed
from weftline.operators import graph, intervals, profiles
from weftline.operators.ranking import dense_codes, first_per_group, global_rank
from weftline.plans import fixtures as fx
from weftline.plans.fixtures import with_sql
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


_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"

# --- joins ---------------------------------------------------------------------


@query('SELECT p.start, p.asn, g.start AS g_start, g.city, least(p."end", g."end") - greatest(p.start, g.start) + 1 AS overlap FROM fx_prefix p JOIN fx_geo g ON p.start <= g."end" AND g.start <= p."end"', "fx_prefix fx_geo")
def join_overlap(s, d):
    return intervals.overlap_join(fx.prefixes(s, d), fx.places(s, d)).select("start", "asn", F.col("b_start").alias("g_start"), "city", "overlap")


_POPS4 = "c4 AS (SELECT DISTINCT trim(c0) AS c0, string_split(string_split(trim(c0), '/')[1], '.') AS q, TRY_CAST(string_split(trim(c0), '/')[2] AS INT) AS plen, min(lower(trim(c1))) AS pop FROM pops WHERE regexp_matches(trim(c0), '^[0-9.]+/[0-9]+$') GROUP BY 1, 2, 3), t4 AS (SELECT a - a % pow(2, 32 - plen)::BIGINT AS lo, plen, min(pop) AS pop FROM (SELECT plen, pop, q[1]::BIGINT * 16777216 + q[2]::BIGINT * 65536 + q[3]::BIGINT * 256 + q[4]::BIGINT AS a FROM c4 WHERE plen <= 32 AND q[1]::INT <= 255 AND q[2]::INT <= 255 AND q[3]::INT <= 255 AND q[4]::INT <= 255) GROUP BY 1, 2), a4 AS (SELECT rec_id, q[1]::BIGINT * 16777216 + q[2]::BIGINT * 65536 + q[3]::BIGINT * 256 + q[4]::BIGINT AS n FROM (SELECT rec_id, string_split(from_addr, '.') AS q FROM pings WHERE regexp_matches(from_addr, '^\\d{1,3}(\\.\\d{1,3}){3}$')) WHERE q[1]::INT <= 255 AND q[2]::INT <= 255 AND q[3]::INT <= 255 AND q[4]::INT <= 255)"


def _pop_table(s, d):
    from weftline.functions.net import cidr4

    p = table(s, d, "pops").where(F.col("c0").rlike("^ *[0-9.]+/[0-9]+ *$")).withColumn("p", cidr4("c0")).where("p IS NOT NULL")
    return p.groupBy("p.lo", "p.plen").agg(F.min(F.lower(F.trim("c1"))).alias("pop"))


def _pop_rows(s, d):
    """(snap, version, lo, plen, text, pop): rows of the PoP feed with a prefix of either family, canonical."""
    from weftline.functions.net import cidr

    p = table(s, d, "pops").withColumn("p", cidr("c0")).where("p.version IS NOT NULL")
    return p.select("snap", "p.version", "p.lo", "p.plen", "p.text", F.lower(F.trim("c1")).alias("pop"))


def _senders(s, d):
    from weftline.functions.net import ipv4_number

    return table(s, d, "pings").select("rec_id", ipv4_number("from_addr").alias("n")).where("n IS NOT NULL")


@query(f"WITH {_POPS4} SELECT rec_id, n, t.lo, t.plen, t.pop FROM a4 LEFT JOIN LATERAL (SELECT * FROM t4 WHERE n BETWEEN t4.lo AND t4.lo + pow(2, 32 - plen)::BIGINT - 1 ORDER BY plen DESC LIMIT 1) t ON true")
def join_lpm(s, d):
    return intervals.longest_prefix(_senders(s, d), "n", _pop_table(s, d))


@query()
def join_lpm_any(s, d):
    """Senders of both families with their longest prefix of the PoP feed."""
    from weftline.functions.net import address_bytes, cidr

    p = table(s, d, "pops").withColumn("p", cidr("c0")).where("p.version IS NOT NULL")
    wide = F.col("p.plen") + F.when(F.col("p.version") == 4, 96).otherwise(0)
    t = p.groupBy(F.col("p.lo").alias("lo"), wide.alias("plen")).agg(F.min("p.text").alias("prefix"), F.min(F.lower(F.trim("c1"))).alias("pop"))
    a = table(s, d, "pings").select("rec_id", address_bytes("from_addr").alias("a"))
    return intervals.longest_prefix_any(a, "a", t).select("rec_id", "prefix", "pop")


@query(f"WITH {_POPS4} SELECT w.lo, w.plen, count(*) AS inside, min(t4.pop) AS first_pop FROM (SELECT DISTINCT lo - lo % 65536 AS lo, 16 AS plen FROM t4) w JOIN t4 ON t4.lo BETWEEN w.lo AND w.lo + 65535 AND t4.plen >= w.plen GROUP BY ALL")
def join_covers(s, d):
    """Rows of the table inside wider prefixes that it doesn't have itself. IPv4 only, as its SQL; both families: join_covers_any."""
    t = _pop_table(s, d).withColumn("hi", F.col("lo") + F.pow(F.lit(2.0), 32 - F.col("plen")).cast("long") - 1)
    wide = t.select((F.col("lo") - F.col("lo") % 65536).alias("lo")).distinct().withColumn("plen", F.lit(16)).withColumn("hi", F.col("lo") + 65535)
    j = intervals.overlap_join(wide, t, ("lo", "hi"), ("lo", "hi")).where("b_lo >= lo AND b_hi <= hi AND b_plen >= plen")
    return j.groupBy("lo", "plen").agg(F.count("*").alias("inside"), F.min("pop").alias("first_pop"))


@query()
def join_covers_any(s, d):
    """Rows of the table inside each /16 (IPv4) or /32 (IPv6), with the PoP that most of them name, of equals the first."""
    from weftline.functions.net import first_bits

    t = _pop_rows(s, d).groupBy("version", "lo", "plen").agg(F.min("pop").alias("pop"))
    wide = F.when(F.col("version") == 4, 16).otherwise(32)
    rows = t.where(F.col("plen") >= wide).select("version", first_bits("lo", F.when(F.col("version") == 4, 112).otherwise(32)).alias("lo"), wide.alias("plen"), "pop")
    votes = rows.groupBy("version", "lo", "plen", "pop").agg(F.count("*").alias("n"))
    named = F.when(F.col("pop") != "", F.struct((-F.col("n")).alias("n"), "pop"))
    g = votes.groupBy("version", "lo", "plen").agg(F.sum("n").alias("inside"), F.min("pop").alias("first_pop"), F.min(named).alias("k"))
    return g.select("version", "lo", "plen", "inside", "first_pop", F.col("k.pop").alias("pop"))


@query("SELECT o.o_orderkey, p.asn FROM orders o ASOF LEFT JOIN (SELECT start + asn % 5 AS start, asn FROM fx_prefix) p ON o.o_orderkey >= p.start", "fx_prefix")
def join_point_range(s, d):
    """The owner of the last boundary at or before each number."""
    marks = fx.prefixes(s, d).select((F.col("start") + F.col("asn") % 5).alias("at"), "asn")
    return intervals.last_before(table(s, d, "orders").select("o_orderkey"), marks, "o_orderkey", "at", "asn", cell=4096)


@query("SELECT e.event_id, n.event_id AS next_id FROM events e ASOF LEFT JOIN (SELECT user_id, event_id, event_id AS at FROM events WHERE event_type = 'purchase') n ON e.user_id = n.user_id AND e.event_id <= n.at")
def join_next_event(s, d):
    """The user's next purchase at or after each event."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    later = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("next_id"))
    return intervals.last_before(e.select("event_id", "user_id"), later, "event_id", "at", "next_id", by=["user_id"], cell=4096, forward=True).select("event_id", "next_id")


@query("SELECT n.node, coalesce(p.addresses, 0) AS addresses FROM (SELECT node, node % 97 + 1 AS asn FROM fx_nodes) n LEFT JOIN (SELECT asn, sum(\"end\" - start + 1)::BIGINT AS addresses FROM fx_prefix GROUP BY 1) p USING (asn)", "fx_nodes fx_prefix")
def join_align(s, d):
    own = fx.prefixes(s, d).groupBy("asn").agg(F.sum(F.col("end") - F.col("start") + 1).alias("addresses"))
    return fx.nodes(s, d).withColumn("asn", F.col("node") % 97 + 1).join(own, "asn", "left").select("node", F.coalesce("addresses", F.lit(0)).alias("addresses"))


_SNAP2 = "n AS (SELECT DISTINCT snap, trim(c0) AS c0 FROM pops WHERE regexp_matches(trim(c0), '^[0-9.]+/[0-9]+$')), m AS (SELECT min(snap) AS a, max(snap) AS b FROM n)"


def _two_snaps(s, d):
    p = table(s, d, "pops").select("snap", F.trim("c0").alias("c0")).where(F.col("c0").rlike("^[0-9.]+/[0-9]+$")).distinct()
    ends = F.broadcast(p.agg(F.min("snap").alias("a"), F.max("snap").alias("b")))
    return p.join(ends, F.col("snap") == F.col("a")).select("c0"), p.join(ends, F.col("snap") == F.col("b")).select("c0")


@query(f"WITH {_SNAP2} SELECT coalesce(x.c0, y.c0) AS c0, x.c0 IS NOT NULL AS in_first, y.c0 IS NOT NULL AS in_last FROM (SELECT c0 FROM n, m WHERE snap = a) x FULL JOIN (SELECT c0 FROM n, m WHERE snap = b) y ON x.c0 = y.c0")
def join_feed(s, d):
    """Text of the IPv4 prefixes of the first and the last delivery, as its SQL; canonical and of both families: join_feed_any."""
    a, b = _two_snaps(s, d)
    return a.withColumn("x", F.lit(True)).join(b.withColumn("y", F.lit(True)), "c0", "full_outer").select("c0", F.col("x").isNotNull().alias("in_first"), F.col("y").isNotNull().alias("in_last"))


def _ends_any(s, d):
    """(version, lo, plen, text, in_first, in_last): prefixes of both families in the first and the last delivery that hold any."""
    p = _pop_rows(s, d)
    ends = F.broadcast(p.agg(F.min("snap").alias("a"), F.max("snap").alias("b")))
    j = p.join(ends, (F.col("snap") == F.col("a")) | (F.col("snap") == F.col("b")))
    return j.groupBy("version", "lo", "plen", "text").agg(F.max(F.col("snap") == F.col("a")).alias("in_first"), F.max(F.col("snap") == F.col("b")).alias("in_last"))


@query("WITH ends AS (SELECT version, plen, text AS prefix, bool_or(snap = a) AS in_first, bool_or(snap = b) AS in_last FROM fx_canon, (SELECT min(snap) AS a, max(snap) AS b FROM fx_canon) WHERE snap IN (a, b) GROUP BY ALL) SELECT * FROM ends", "fx_canon")
def join_feed_any(s, d):
    """Two deliveries side by side on the canonical prefix, both families in prefix order."""
    return _ends_any(s, d).orderBy("version", "lo", "plen").select("version", "plen", F.col("text").alias("prefix"), "in_first", "in_last")


@query("SELECT e.eid, CASE WHEN p.eid IS NOT NULL THEN 'down' WHEN q.eid IS NOT NULL THEN 'up' ELSE 'peer' END AS label FROM (SELECT eid, CASE WHEN eid % 2 = 0 THEN a ELSE b END AS x, CASE WHEN eid % 2 = 0 THEN b ELSE a END AS y FROM fx_edges) e LEFT JOIN (SELECT * FROM fx_edges WHERE rel = -1) p ON p.a = x AND p.b = y LEFT JOIN (SELECT * FROM fx_edges WHERE rel = -1) q ON q.a = y AND q.b = x", "fx_edges")
def join_itdk_rel(s, d):
    """Undirected links labelled by the known relationships, in either direction."""
    e = fx.edges(s, d)
    even = F.col("eid") % 2 == 0
    u = e.select("eid", F.when(even, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("y"))
    p = e.where("rel = -1").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.lit(True).alias("hit"))
    j = u.join(p, (F.col("pa") == F.col("x")) & (F.col("pb") == F.col("y")), "left").select("eid", "x", "y", F.col("hit").alias("down"))
    j = j.join(p, (F.col("pa") == F.col("y")) & (F.col("pb") == F.col("x")), "left")
    return j.select("eid", F.when(F.col("down"), "down").when(F.col("hit"), "up").otherwise("peer").alias("label"))


@query("SELECT l_orderkey, l_linenumber, s_nationkey AS from_pop, c_nationkey AS to_pop FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def join_router_pop(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("from_pop"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("to_pop"))
    home = o.join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "to_pop")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey").join(sup, "l_suppkey").join(home, "l_orderkey").select("l_orderkey", "l_linenumber", "from_pop", "to_pop")


@query(f"WITH c AS (SELECT node AS centre, lat AS clat, lon AS clon FROM fx_node_pos WHERE node BETWEEN 1000000 AND 1999999) SELECT c_custkey, centre, k AS rank FROM (SELECT node - 4000000 AS c_custkey, centre, row_number() OVER (PARTITION BY node ORDER BY floor({_HAV.format(a='lat', b='lon', c='clat', d='clon')} * 1000 + 0.5), centre) AS k FROM fx_node_pos, c WHERE node >= 4000000) WHERE k <= 2", "fx_node_pos")
def join_nearest(s, d):
    """The two nearest centres of each customer."""
    pos = fx.node_positions(s, d)
    c = pos.where("node BETWEEN 1000000 AND 1999999").select(F.col("node").alias("centre"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    left = pos.where("node >= 4000000").withColumn("c_custkey", F.col("node") - 4_000_000)
    return intervals.nearest_k(left, c, ["c_custkey"], F.floor(geo.haversine("lat", "lon", "clat", "clon") * 1000 + 0.5), ["centre"], 2).select("c_custkey", "centre", "rank")


@query(f"WITH {_POPS4}, l AS (SELECT rec_id, n, t.pop FROM a4 LEFT JOIN LATERAL (SELECT * FROM t4 WHERE n BETWEEN t4.lo AND t4.lo + pow(2, 32 - plen)::BIGINT - 1 ORDER BY plen DESC LIMIT 1) t ON true) SELECT p.prb_id, min(struct_pack(k := CASE WHEN l.pop IS NOT NULL THEN 1 ELSE 2 END, v := coalesce(l.pop, p.dst_name, '')))['k'] AS via, min(struct_pack(k := CASE WHEN l.pop IS NOT NULL THEN 1 ELSE 2 END, v := coalesce(l.pop, p.dst_name, '')))['v'] AS pop FROM pings p LEFT JOIN l USING (rec_id) GROUP BY 1")
def join_probe_pop(s, d):
    """Each probe's PoP by the first source that knows one: its address, else the target's name."""
    hit = intervals.longest_prefix(_senders(s, d), "n", _pop_table(s, d)).select("rec_id", "pop")
    p = table(s, d, "pings").select("rec_id", "prb_id", "dst_name").join(hit, "rec_id", "left")
    best = F.min(F.struct(F.when(F.col("pop").isNotNull(), 1).otherwise(2).alias("k"), F.coalesce("pop", "dst_name", F.lit("")).alias("v")))
    return p.groupBy("prb_id").agg(best.alias("b")).select("prb_id", F.col("b.k").alias("via"), F.col("b.v").alias("pop"))


@query(f"WITH a AS (SELECT id, min(latitude_deg) AS la, min(longitude_deg) AS lo, min(icao_code) AS code FROM airports WHERE latitude_deg IS NOT NULL GROUP BY 1), k AS (SELECT x.id, min(y.id) AS twin FROM a x JOIN a y ON x.code = y.code AND x.id <> y.id GROUP BY 1), r AS (SELECT x.id, y.id AS twin, row_number() OVER (PARTITION BY x.id ORDER BY floor({_HAV.format(a='x.la', b='x.lo', c='y.la', d='y.lo')} * 1000 + 0.5), y.id) AS n FROM a x JOIN a y ON x.id <> y.id AND abs(x.la - y.la) < 0.02 AND {_HAV.format(a='x.la', b='x.lo', c='y.la', d='y.lo')} < 2 WHERE x.id NOT IN (SELECT id FROM k)) SELECT id, twin, 'code' AS how FROM k UNION ALL SELECT id, twin, 'near' FROM r WHERE n = 1")
def join_crosscheck(s, d):
    """A partner by equal code, else the nearest within 2 km."""
    from weftline.operators.spatial import near_pairs

    a = table(s, d, "airports").where("latitude_deg IS NOT NULL").groupBy("id").agg(F.min("latitude_deg").alias("lat"), F.min("longitude_deg").alias("lon"), F.min("icao_code").alias("code"))
    b = a.select(F.col("id").alias("twin"), "code")
    coded = a.join(b, "code").where("id <> twin").groupBy("id").agg(F.min("twin").alias("twin")).withColumn("how", F.lit("code"))
    rest = a.join(coded, "id", "left_anti")
    near = near_pairs(rest, a, {"id": "id"}, {"id": "twin"}, 2.0).where("id <> twin AND km < 2").withColumn("m", F.floor(F.col("km") * 1000 + 0.5))
    best = near.groupBy("id").agg(F.min(F.struct("m", "twin")).alias("k")).select("id", F.col("k.twin").alias("twin"), F.lit("near").alias("how"))
    return coded.select("id", "twin", "how").union(best)


@query("SELECT eid, coalesce(p.lat, 0.0) AS alat, coalesce(q.lat, 0.0) AS blat FROM fx_edges LEFT JOIN (SELECT * FROM fx_node_pos WHERE node < 4000000) p ON p.node = a LEFT JOIN (SELECT * FROM fx_node_pos WHERE node < 4000000) q ON q.node = b", "fx_edges fx_node_pos")
def join_route_ends(s, d):
    p = fx.node_positions(s, d).where("node < 4000000")  # customers have no PoP
    e = fx.edges(s, d).join(p.select(F.col("node").alias("a"), F.col("lat").alias("alat")), "a", "left").join(p.select(F.col("node").alias("b"), F.col("lat").alias("blat")), "b", "left")
    return e.select("eid", F.coalesce("alat", F.lit(0.0)).alias("alat"), F.coalesce("blat", F.lit(0.0)).alias("blat"))


@query(f"WITH sat AS (SELECT node AS sat, lat AS slat, lon AS slon FROM fx_node_pos WHERE node BETWEEN 2000000 AND 2999999) SELECT id, sat FROM (SELECT DISTINCT id, latitude_deg, longitude_deg FROM airports WHERE latitude_deg IS NOT NULL), sat WHERE {_HAV.format(a='latitude_deg', b='longitude_deg', c='slat', d='slon')} <= 2500", "fx_node_pos")
def join_visibility(s, d):
    """Which satellites (by the point below them) a site sees: within the coverage circle."""
    from weftline.operators.spatial import near_pairs

    sat = fx.node_positions(s, d).where("node BETWEEN 2000000 AND 2999999")
    a = table(s, d, "airports").where("latitude_deg IS NOT NULL").select("id", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon")).distinct()
    return near_pairs(a, sat, {"id": "id"}, {"node": "sat"}, 2500.0).select("id", "sat")


# --- aggregations --------------------------------------------------------------

_AT = 'spots AS (SELECT asn, lat, lon, cc, city, sum(least(p."end", g."end") - greatest(p.start, g.start) + 1)::BIGINT AS w, (floor(lat + 90) * 360 + floor(lon + 180))::BIGINT AS cell FROM fx_prefix p JOIN fx_geo g ON p.start <= g."end" AND g.start <= p."end" GROUP BY ALL)'
_MAIN = f"{_AT}, cells AS (SELECT asn, cell, sum(w) AS w, sum(w * lat) AS y, sum(w * lon) AS x FROM spots GROUP BY 1, 2), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asn ORDER BY w DESC, cell) AS k FROM cells) WHERE k = 1), main AS (SELECT asn, y / w AS mlat, x / w AS mlon, cell FROM best)"


def _at(s, d):
    return profiles.located_ranges(fx.prefixes(s, d), fx.places(s, d))


@query('SELECT asn, sum("end" - start + 1)::BIGINT AS addresses, count(*) AS ranges FROM fx_prefix GROUP BY 1', "fx_prefix")
def agg_addr(s, d):
    return fx.prefixes(s, d).groupBy("asn").agg(F.sum(F.col("end") - F.col("start") + 1).alias("addresses"), F.count("*").alias("ranges"))


@query(f"WITH {_MAIN} SELECT asn, cell FROM main", "fx_prefix fx_geo")
def agg_wmode_cell(s, d):
    return profiles.weighted_mode(_at(s, d).withColumn("cell", profiles.cell_of()), ["asn"], "cell", "w", "cell")


@query(f"WITH {_MAIN} SELECT asn, {_fix('mlat')} AS lat, {_fix('mlon')} AS lon FROM main", "fx_prefix fx_geo")
def agg_wmean(s, d):
    return profiles.main_places(_at(s, d)).select("asn", fixed("lat").alias("lat"), fixed("lon").alias("lon"))


@query(f"WITH {_MAIN} SELECT asn, {_fix('sum(CASE WHEN ' + _HAV.format(a='lat', b='lon', c='mlat', d='mlon') + ' <= 400 THEN w ELSE 0 END) / sum(w)')} AS concentration FROM spots JOIN main USING (asn) GROUP BY 1", "fx_prefix fx_geo")
def agg_concentration(s, d):
    at = _at(s, d)
    return profiles.concentration(at, profiles.main_places(at)).select("asn", fixed("concentration").alias("concentration"))


@query(f"WITH {_AT}, k AS (SELECT asn, cc, row_number() OVER (PARTITION BY asn ORDER BY sum(w) DESC, cc) AS n FROM spots GROUP BY 1, 2) SELECT asn, cc AS country FROM k WHERE n = 1", "fx_prefix fx_geo")
def agg_wmode_cc(s, d):
    return profiles.weighted_mode(_at(s, d), ["asn"], "cc", "w", "country")


@query(f"WITH {_AT}, c AS (SELECT asn, city, sum(w) AS w, sum(w * lat) AS y, sum(w * lon) AS x FROM spots GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY asn ORDER BY w DESC, city) AS k, sum(w) OVER (PARTITION BY asn) AS total FROM c) SELECT asn, (k - 1)::INT AS site, city, {_fix('y / w', 4)} AS lat, {_fix('x / w', 4)} AS lon, {_fix('w / total', 4)} AS share FROM r WHERE k <= 32", "fx_prefix fx_geo")
def agg_top_sites(s, d):
    t = profiles.top_sites(_at(s, d)).select("asn", F.posexplode("sites").alias("site", "x"))
    return t.select("asn", "site", "x.city", *[fixed(f"x.{c}", 4).alias(c) for c in ("lat", "lon", "share")])


@query(f"WITH {_MAIN}, own AS (SELECT asn, sum(\"end\" - start + 1)::BIGINT AS addresses, count(*) AS ranges FROM fx_prefix GROUP BY 1), near AS (SELECT asn, sum(CASE WHEN {_HAV.format(a='lat', b='lon', c='mlat', d='mlon')} <= 400 THEN w ELSE 0 END) / sum(w) AS c FROM spots JOIN main USING (asn) GROUP BY 1), ctry AS (SELECT asn, cc FROM (SELECT asn, cc, row_number() OVER (PARTITION BY asn ORDER BY sum(w) DESC, cc) AS n FROM spots GROUP BY 1, 2) WHERE n = 1), nsites AS (SELECT asn, least(32, count(DISTINCT city))::INT AS sites FROM spots GROUP BY 1) SELECT asn, addresses, ranges, {_fix('mlat')} AS lat, {_fix('mlon')} AS lon, {_fix('c')} AS concentration, cc AS country, sites, mlat IS NOT NULL AS has_geo FROM own LEFT JOIN main USING (asn) LEFT JOIN near USING (asn) LEFT JOIN ctry USING (asn) LEFT JOIN nsites USING (asn)", "fx_prefix fx_geo")
def agg_profile(s, d):
    p = profiles.profile_networks(fx.prefixes(s, d), fx.places(s, d))
    return p.select("asn", "addresses", "ranges", fixed("lat").alias("lat"), fixed("lon").alias("lon"), fixed("concentration").alias("concentration"), "country", F.size("sites").alias("sites"), "has_geo")


@query()
def agg_resite(s, d):
    """One network's geography put over the computed one: its rows are replaced, all others stay."""
    p = profiles.profile_networks(fx.prefixes(s, d), fx.places(s, d)).select("asn", "lat", "lon", "country")
    own = fx.prefixes(s, d).where("asn = 7").select("asn", F.lit(34.0).alias("lat"), F.lit(-118.0).alias("lon"), F.lit("US").alias("country")).limit(1)
    return p.join(own, "asn", "left_anti").unionByName(own).select("asn", fixed("lat").alias("lat"), fixed("lon").alias("lon"), "country")


@query()
def agg_top_prefixes(s, d):
    """The largest 48 prefixes of each network, ranges cut into prefixes by the table function."""
    from weftline.functions.net import RangeCidrs

    s.udtf.register("range_cidrs", RangeCidrs)
    fx.prefixes(s, d).createOrReplaceTempView("wl_owned")
    p = s.sql("SELECT asn, start, network, plen FROM wl_owned, LATERAL range_cidrs(start, `end`)")
    w = Window.partitionBy("asn").orderBy("plen", "network")
    return p.withColumn("k", F.row_number().over(w)).where("k <= 48").select("asn", "k", "network", "plen")


@query("SELECT s_nationkey AS asn, p_size AS place, count(*) AS routers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def agg_router_pop(s, d):
    li, sup, p = table(s, d, "lineitem"), table(s, d, "supplier"), table(s, d, "part")
    return li.join(sup, li.l_suppkey == sup.s_suppkey).join(p, li.l_partkey == p.p_partkey).groupBy(F.col("s_nationkey").alias("asn"), F.col("p_size").alias("place")).agg(F.count("*").alias("routers"))


_POP_LINKS = "WITH r AS (SELECT l_orderkey, s_nationkey AS x, c_nationkey AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) "


def _pop_links(s, d):
    r = QUERIES["join_router_pop"](s, d)
    return r.where("from_pop <> to_pop").groupBy(F.least("from_pop", "to_pop").alias("a"), F.greatest("from_pop", "to_pop").alias("b")).agg(F.count("*").alias("weight"))


@query(_POP_LINKS + "SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS weight FROM r WHERE x <> y GROUP BY 1, 2")
def agg_pop_links(s, d):
    return _pop_links(s, d)


_DEG = "SELECT node, sum(1)::BIGINT AS degree, sum(c)::BIGINT AS customers, sum(p)::BIGINT AS providers, (sum(1) - sum(c) - sum(p))::BIGINT AS peers FROM (SELECT a AS node, CASE WHEN rel = -1 THEN 1 ELSE 0 END AS c, 0 AS p FROM fx_edges UNION ALL SELECT b, 0, CASE WHEN rel = -1 THEN 1 ELSE 0 END FROM fx_edges) GROUP BY 1"


@query(_DEG, "fx_edges")
def agg_degree(s, d):
    return graph.degrees(fx.edges(s, d))


@query(_POP_LINKS + ", e AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS w FROM r WHERE x <> y GROUP BY 1, 2) SELECT node, sum(w)::BIGINT AS degree FROM (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY 1")
def agg_wdegree(s, d):
    return graph.degrees(_pop_links(s, d).withColumn("rel", F.lit(0)), "weight").select("node", "degree")


def _merc_links(s, d):
    e = graph.place_edges(fx.edges(s, d), fx.node_positions(s, d))
    ax, ay = geo.mercator("alat", "alon")
    bx, by = geo.mercator("blat", "blon")
    return e.select("eid", "rel", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


_LINKS = "l AS (SELECT eid, rel, (p.lon + 180) / 360 AS ax, 0.5 - ln((1 + sin(radians(p.lat))) / (1 - sin(radians(p.lat)))) / (4 * pi()) AS ay, (q.lon + 180) / 360 AS bx, 0.5 - ln((1 + sin(radians(q.lat))) / (1 - sin(radians(q.lat)))) / (4 * pi()) AS \"by\" FROM fx_edges JOIN fx_node_pos p ON p.node = a JOIN fx_node_pos q ON q.node = b), c AS (SELECT *, (floor(ay / 0.05) * 23 + floor(ax / 0.05))::BIGINT AS ca, (floor(\"by\" / 0.05) * 23 + floor(bx / 0.05))::BIGINT AS cb FROM l), k AS (SELECT least(ca, cb) AS lo, greatest(ca, cb) AS hi, eid, rel, CASE WHEN ca > cb THEN bx ELSE ax END AS sx, CASE WHEN ca > cb THEN \"by\" ELSE ay END AS sy FROM c WHERE ca <> cb)"


@query(f"WITH {_LINKS} SELECT lo, hi, count(*) AS members, count(*) FILTER (rel <> 0) AS transit, count(*) FILTER (rel = 0) AS peering, {_fix('avg(sx)')} AS sx, {_fix('avg(sy)')} AS sy FROM k GROUP BY 1, 2 HAVING count(*) >= 2", "fx_edges fx_node_pos")
def agg_fibers(s, d):
    return profiles.fibers(_merc_links(s, d), 0.05).select("lo", "hi", "members", "transit", "peering", fixed("sx").alias("sx"), fixed("sy").alias("sy"))


@query(f"SELECT event_type, count(*) AS n, {_fix('quantile_cont(value, 0.5)')} AS median, {_fix('quantile_cont(value, 0.9)')} AS p90, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def agg_latency(s, d):
    e = table(s, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), fixed(F.percentile("value", F.lit(0.5))).alias("median"), fixed(F.percentile("value", F.lit(0.9))).alias("p90"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(value) FILTER (k = least(n - 1, floor(0.9 * n)::BIGINT)) AS p90 FROM r GROUP BY 1")
def agg_quantile_nn(s, d):
    """Nearest-rank quantile: the value at place floor(q n), the last at most."""
    w = Window.partitionBy("user_id")
    r = table(s, d, "events").select("user_id", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    return r.where(F.col("k") == F.least(F.col("n") - 1, F.floor(0.9 * F.col("n")))).groupBy("user_id").agg(F.max("value").alias("p90"))


@query("SELECT date_trunc('hour', ts) AS frame, count(*) AS draws FROM events GROUP BY 1")
def agg_burst(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("frame")).agg(F.count("*").alias("draws"))


@query("SELECT DISTINCT id, CASE WHEN v4_addresses > 0 THEN v4_addresses ELSE v4_prefixes + v6_prefixes END AS demand FROM regions WHERE lat IS NOT NULL AND lon IS NOT NULL AND CASE WHEN v4_addresses > 0 THEN v4_addresses ELSE v4_prefixes + v6_prefixes END > 0")
def agg_demand(s, d):
    w = F.when(F.col("v4_addresses") > 0, F.col("v4_addresses")).otherwise(F.col("v4_prefixes") + F.col("v6_prefixes"))
    return table(s, d, "regions").where("lat IS NOT NULL AND lon IS NOT NULL").select("id", w.alias("demand")).where("demand > 0").distinct()


@query("SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, max(l_quantity) AS samples FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def agg_norm_backbone(s, d):
    li = table(s, d, "lineitem").where("l_suppkey <> l_partkey")
    return li.groupBy(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).agg(F.max("l_quantity").alias("samples"))


@query("WITH n AS (SELECT a AS node, b AS other, eid, CASE WHEN rel = -1 THEN 'customer' ELSE 'peer' END AS label FROM fx_edges UNION ALL SELECT b, a, eid, CASE WHEN rel = -1 THEN 'provider' ELSE 'peer' END FROM fx_edges) SELECT node, other, label FROM (SELECT *, row_number() OVER (PARTITION BY node, other ORDER BY eid) AS k FROM n) WHERE k = 1", "fx_edges")
def agg_neighbours_fold(s, d):
    label = F.when(F.col("rel") == 0, "peer").when(F.col("down"), "customer").otherwise("provider")
    n = graph.both_ways(fx.edges(s, d)).select("node", "other", "eid", label.alias("label"))
    return first_per_group(n, ["node", "other"], [F.col("eid")]).select("node", "other", "label")


@query("SELECT event_type, props->>'k' AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def agg_event_param(s, d):
    e = table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"), "user_id")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT coalesce(type, '?') AS reason, count(*) AS n FROM airports GROUP BY 1")
def agg_excluded(s, d):
    return table(s, d, "airports").groupBy(F.coalesce("type", F.lit("?")).alias("reason")).agg(F.count("*").alias("n"))


_LATEST = "f AS (SELECT DISTINCT trim(c0) AS prefix, lower(trim(c1)) AS pop FROM pops WHERE snap = (SELECT max(snap) FROM pops) AND nullif(trim(c1), '') IS NOT NULL), a AS (SELECT DISTINCT trim(p) AS prefix FROM (SELECT unnest(flatten(list_transform(data.announcements, lambda x: x.prefixes))) AS p FROM ris_frames WHERE data.announcements IS NOT NULL))"


def _announced(s, d):
    r = table(s, d, "ris_frames").where("data.announcements IS NOT NULL")
    return r.select(F.explode(F.flatten(F.transform("data.announcements", lambda x: x["prefixes"]))).alias("p")).select(F.trim("p").alias("prefix")).distinct()


# --- windows ---------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def win_first_per_group(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return first_per_group(o, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"WITH g AS ({_DEG}) SELECT node, row_number() OVER (ORDER BY customers DESC, degree DESC, node) AS rank FROM g", "fx_edges")
def win_rank_cone(s, d):
    g = graph.degrees(fx.edges(s, d)).select("node", "customers", "degree")
    return global_rank(g, [F.desc("customers"), F.desc("degree"), F.col("node")], "rank").select("node", "rank")


@query(f"WITH g AS ({_DEG}) , p AS (SELECT node, lat, lon, row_number() OVER (PARTITION BY round_even(lat * 50, 0), round_even(lon * 50, 0) ORDER BY degree DESC, node) - 1 AS k FROM fx_node_pos JOIN g USING (node)) SELECT node, {_fix('least(84.95112878, greatest(-84.95112878, lat + 900 * sqrt(k) * sin(k * 2.399963229728653) / 111320.0))')} AS lat, {_fix('lon + 900 * sqrt(k) * cos(k * 2.399963229728653) / (111320.0 * cos(radians(lat)))')} AS lon FROM p", "fx_edges fx_node_pos")
def win_sunflower(s, d):
    g = graph.degrees(fx.edges(s, d)).select("node", "degree")
    return profiles.fan_out(fx.node_positions(s, d).join(g, "node"), "node", "degree").select("node", fixed("lat").alias("lat"), fixed("lon").alias("lon"))


@query("""WITH r AS (SELECT greatest(start - asn % 9, 0) AS s, "end" + asn * 7 % 23 - 11 AS e, asn AS o FROM fx_prefix), w AS (SELECT *, coalesce(max(e) OVER (ORDER BY s, e, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM r), k AS (SELECT greatest(s, b + 1) AS s, e, o, b FROM w WHERE e > b), m AS (SELECT s AS x, o FROM k UNION ALL SELECT b + 1, 0 FROM k WHERE s > b + 1 UNION ALL SELECT max(e) + 1, 0 FROM w), c AS (SELECT x, o, lag(o) OVER (ORDER BY x) AS p FROM m) SELECT x AS start, o AS asn FROM c WHERE p IS NULL OR p <> o""", "fx_prefix")
def win_boundaries(s, d):
    p = fx.prefixes(s, d).select(F.greatest(F.col("start") - F.col("asn") % 9, F.lit(0)).alias("start"), (F.col("end") + F.col("asn") * 7 % 23 - 11).alias("end"), "asn")
    return intervals.boundaries(p, cell=1024)


@query(f"WITH g AS ({_DEG}), r AS (SELECT node, {_fix('(row_number() OVER (ORDER BY customers, degree, node) - 1) / count(*) OVER ()::DOUBLE')} AS core FROM g) SELECT eid, least(x.core, y.core) AS core FROM fx_edges JOIN r x ON x.node = a JOIN r y ON y.node = b", "fx_edges")
def win_core_rank(s, d):
    """Percentile of each node in the hierarchy; a link's is the lesser of its ends."""
    g = graph.degrees(fx.edges(s, d)).select("node", "customers", "degree")
    n = F.broadcast(g.agg(F.count("*").alias("n")))
    r = global_rank(g, [F.col("customers"), F.col("degree"), F.col("node")], "k", 0).crossJoin(n).select("node", fixed(F.col("k") / F.col("n")).alias("core"))
    e = fx.edges(s, d).select("eid", "a", "b")
    return e.join(r.select(F.col("node").alias("a"), F.col("core").alias("x")), "a").join(r.select(F.col("node").alias("b"), F.col("core").alias("y")), "b").select("eid", F.least("x", "y").alias("core"))


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events")
def win_lag_diff(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return e.select("event_id", (F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("gap"))


@query()
def win_path_roles(s, d):
    """The part of the path that each hop is in: home, gateway, the network behind it, the internet, the target.

    The state moves on and never back; the hop at which it leaves home into the network is the gateway. An address of the network
    that answers within 8 ms is still at home, as every later hop is over the air.
    """
    from weftline.plans.problems import trace_replies

    t = table(s, d, "traceroutes").select("rec_id", "dst_addr")
    hops = trace_replies(s, d).where("from_addr IS NOT NULL AND from_addr <> ''").groupBy("rec_id", "hop_pos").agg(F.min("from_addr").alias("ip"), F.min("rtt").alias("rtt")).join(t, "rec_id")
    ip = F.col("ip")
    own = ip.startswith("203.0.113.") | ip.startswith("2001:db8:fff0")
    code = F.when(ip == F.col("dst_addr"), 4).when(ip.startswith("192.168.") | ip.startswith("fd00"), 0).when(ip.startswith("100.64."), 1).when(own & (F.col("rtt") < 8), 0).when(own, 2).otherwise(3)
    w = Window.partitionBy("rec_id").orderBy("hop_pos")
    state = F.max("code").over(w.rowsBetween(Window.unboundedPreceding, 0))
    h = hops.withColumn("code", code).withColumn("state", state).withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(0)))
    role = F.when(F.col("state") == 4, "dest").when(F.col("state") == 3, "internet").when(F.col("state") == 0, "lan").when(F.col("before") == 0, "pop").otherwise("network")
    return h.select("rec_id", "hop_pos", role.alias("role"))


@query("SELECT c_mktsegment AS value, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def win_ordinal_codes(s, d):
    return dense_codes(table(s, d, "customer"), "c_mktsegment", "code").select(F.col("c_mktsegment").alias("value"), "code")


# --- sets --------------------------------------------------------------------------


@query(f"WITH {_SNAP2} SELECT DISTINCT c0 FROM n, m WHERE snap IN (a, b)")
def set_union_keys(s, d):
    """Text of the IPv4 prefixes of two deliveries, as its SQL; canonical, sorted and of both families: set_union_keys_any."""
    a, b = _two_snaps(s, d)
    return a.union(b).distinct()


_ENDS_ANY = "WITH ends AS (SELECT version, plen, text AS prefix, bits, bool_or(snap = a) AS in_first, bool_or(snap = b) AS in_last FROM fx_canon, (SELECT min(snap) AS a, max(snap) AS b FROM fx_canon) WHERE snap IN (a, b) GROUP BY ALL) "


@query(_ENDS_ANY + "SELECT version, plen, prefix, row_number() OVER (ORDER BY version, bits, plen) AS place FROM ends", "fx_canon")
def set_union_keys_any(s, d):
    """Canonical prefixes of two deliveries, both families, with their place in prefix order."""
    keys = [F.col("version"), F.col("lo"), F.col("plen")]
    return global_rank(_ends_any(s, d).select("version", "lo", "plen", "text"), keys, "place").select("version", "plen", F.col("text").alias("prefix"), "place")


@query("WITH p AS (SELECT start, asn FROM fx_prefix WHERE start % 11 <> 0), c AS (SELECT start, CASE WHEN start % 7 = 0 THEN asn + 1 ELSE asn END AS asn FROM fx_prefix WHERE start % 13 <> 0) SELECT coalesce(p.start, c.start) AS start, CASE WHEN p.start IS NULL THEN 'added' WHEN c.start IS NULL THEN 'removed' ELSE 'moved' END AS change FROM p FULL JOIN c ON p.start = c.start WHERE p.asn IS DISTINCT FROM c.asn", "fx_prefix")
def set_diff(s, d):
    from weftline.operators.snapshots import snapshot_changes

    p = fx.prefixes(s, d)
    prev = p.where("start % 11 <> 0").select(F.lit(1).alias("snap"), "start", "asn", F.lit(0).alias("line"))
    cur = p.where("start % 13 <> 0").select(F.lit(2).alias("snap"), "start", F.when(F.col("start") % 7 == 0, F.col("asn") + 1).otherwise(F.col("asn")).alias("asn"), F.lit(0).alias("line"))
    c = snapshot_changes(prev.unionByName(cur), "snap", "start", ["asn"], "line")
    return c.select("start", F.when(F.col("change") == "changed", "moved").otherwise(F.col("change")).alias("change"))


@query("SELECT snap, trim(c0) AS c0, arg_min(c1, line_no) AS c1 FROM pops WHERE c1 IS NOT NULL GROUP BY 1, 2")
def set_dedupe_first(s, d):
    p = table(s, d, "pops").where("c1 IS NOT NULL").select("snap", F.trim("c0").alias("c0"), "line_no", "c1")
    return first_per_group(p, ["snap", "c0"], [F.col("line_no")]).select("snap", "c0", "c1")


@query("SELECT id, arg_min(description, k) AS description FROM (SELECT id, description, row_number() OVER (PARTITION BY id ORDER BY status.since, description) AS k FROM probes WHERE status.since IS NOT NULL) WHERE k = 1 GROUP BY 1")
def set_merge_probes(s, d):
    p = table(s, d, "probes").where("status.since IS NOT NULL").select("id", F.col("status.since").alias("since"), "description")
    return first_per_group(p.select("id", "since", F.struct(F.col("description").isNull().alias("n"), F.col("description").alias("d")).alias("x")), ["id"], [F.col("since")]).select("id", F.col("x.d").alias("description"))


@query("SELECT o_orderkey FROM orders WHERE (o_custkey % 10, o_orderpriority) IN (SELECT c_custkey % 10, '1-URGENT' FROM customer WHERE c_nationkey < 3)")
def set_isin(s, d):
    o = table(s, d, "orders").withColumn("k", F.col("o_custkey") % 10)
    c = table(s, d, "customer").where("c_nationkey < 3").select((F.col("c_custkey") % 10).alias("k"), F.lit("1-URGENT").alias("o_orderpriority")).distinct()
    return o.join(c, ["k", "o_orderpriority"], "left_semi").select("o_orderkey")


@query()
def set_cover(s, d):
    """The least prefixes that cover the feed's, each first cut to /16 or /32, in prefix order: contained ones go and siblings merge."""
    return cover(_pop_rows(s, d))


def cover(prefixes):
    """(version, plen, prefix) for prefixes as net.cidr gives them. What the cut leaves stands in an address's first 32 bits, so both
    families are flattened as ranges of numbers, IPv6 moved up with a gap between.
    """
    from weftline.functions.net import RangeCidrs, cidr, ipv4_text

    four, up = F.col("version") == 4, 1 << 33
    n = F.conv(F.hex(F.when(four, F.substring("lo", 13, 4)).otherwise(F.substring("lo", 1, 4))), 16, 10).cast("long")
    t = prefixes.select("version", F.least("plen", F.when(four, 16).otherwise(32)).alias("plen"), n.alias("n"))
    size = F.pow(F.lit(2.0), 32 - F.col("plen")).cast("long")
    t = t.select((F.col("n") - F.pmod("n", size) + F.when(four, 0).otherwise(up)).alias("lo"), size.alias("size")).distinct().select("lo", (F.col("lo") + F.col("size") - 1).alias("hi"))
    run = intervals.running_max(t, "lo", "hi", "before", ["hi"], 1 << 16)
    starts = run.where(F.col("before").isNull() | (F.col("lo") > F.col("before") + 1)).select(F.col("lo").alias("start"), F.col("lo").alias("at"))
    groups = intervals.last_before(t, starts, "lo", "at", "start")
    s = prefixes.sparkSession
    s.udtf.register("range_cidrs", RangeCidrs)
    base = F.when(F.col("start") < up, 0).otherwise(up)
    groups.groupBy("start").agg(F.max("hi").alias("last")).select(F.when(F.col("start") < up, 4).otherwise(6).alias("version"), (F.col("start") - base).alias("start"), (F.col("last") - base).alias("last")).createOrReplaceTempView("wl_cover")
    out = s.sql("SELECT version, network, plen FROM wl_cover, LATERAL range_cidrs(start, last)").orderBy("version", "network", "plen")
    part = lambda shift: F.lower(F.hex(F.shiftright("network", shift).bitwiseAND(0xFFFF)))
    wide = F.concat(part(16), F.lit(":"), part(0), F.lit("::/"), "plen")
    return out.select("version", "plen", F.when(four, F.concat(ipv4_text("network"), F.lit("/"), "plen")).otherwise(cidr(wide)["text"]).alias("prefix"))


@query("SELECT c_custkey AS k, 0 AS part FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 1 FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_append(s, d):
    """What is shown, in order, and then what is missing from it."""
    a = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = table(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return a.withColumn("part", F.lit(0)).union(b.join(a, "k", "left_anti").withColumn("part", F.lit(1)))


@query("SELECT s_suppkey AS k, s_nationkey AS v FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer")
def set_concat(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return a.unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v")))


@query("WITH x AS (SELECT DISTINCT p.code AS pop, id FROM (SELECT id, unnest(pops) AS p FROM regions)) SELECT pop, count(*)::INT AS regions FROM x GROUP BY 1")
def x_served_by(s, d):
    x = table(s, d, "regions").select("id", F.explode("pops").alias("p")).select("id", F.col("p.code").alias("pop"))
    return x.groupBy("pop").agg(F.size(F.collect_set("id")).alias("regions"))


@query("SELECT min(snap) FILTER (snap >= '20260910') AS picked FROM pops")
def x_pick_dataset(s, d):
    """The first delivery from a day on."""
    return table(s, d, "pops").agg(F.min(F.when(F.col("snap") >= "20260910", F.col("snap"))).alias("picked"))


@query("SELECT max(snap) FILTER (snap <= '20260920') AS picked FROM pops")
def src_snapshot_pick(s, d):
    """The newest delivery that is old enough."""
    return table(s, d, "pops").agg(F.max(F.when(F.col("snap") <= "20260920", F.col("snap"))).alias("picked"))


@query(f"WITH g AS ({_DEG}) SELECT asn, node FROM (SELECT node % 97 + 1 AS asn, node, row_number() OVER (PARTITION BY node % 97 ORDER BY degree DESC, node) AS k FROM g) WHERE k = 1", "fx_edges")
def x_dataset_of(s, d):
    """The best-connected node of each network."""
    g = graph.degrees(fx.edges(s, d)).select((F.col("node") % 97 + 1).alias("asn"), "node", "degree")
    return first_per_group(g, ["asn"], [-F.col("degree"), F.col("node")]).select("asn", "node")


@query("SELECT rec_id, 'pings' AS kind FROM pings WHERE msm_id = (SELECT min(msm_id) FROM pings) UNION ALL SELECT rec_id, 'traceroutes' FROM traceroutes WHERE msm_id = (SELECT min(msm_id) FROM traceroutes)")
def x_latest_union(s, d):
    def part(name):
        t = table(s, d, name)
        first = F.broadcast(t.agg(F.min("msm_id").alias("m")))
        return t.join(first, F.col("msm_id") == F.col("m")).select("rec_id", F.lit(name).alias("kind"))

    return part("pings").union(part("traceroutes"))


@query("SELECT type, count(*) AS n, count(DISTINCT iso_country) AS countries, count(iata_code) AS coded FROM airports GROUP BY 1")
def x_gateways_doc(s, d):
    return table(s, d, "airports").groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("iso_country").alias("countries"), F.count("iata_code").alias("coded"))


@query("SELECT DISTINCT snap FROM pops WHERE snap LIKE '202609%'")
def x_history_list(s, d):
    return table(s, d, "pops").where(F.col("snap").startswith("202609")).select("snap").distinct()


@query("SELECT prb_id, max(abs(rtt_max - rtt_min)) AS shift FROM pings WHERE rtt_max >= 0 AND rtt_min >= 0 GROUP BY 1")
def x_reproj_shift(s, d):
    return table(s, d, "pings").where("rtt_max >= 0 AND rtt_min >= 0").groupBy("prb_id").agg(F.max(F.abs(F.col("rtt_max") - F.col("rtt_min"))).alias("shift"))
