"""Queries over scalar functions, filters, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import geo, net, text
from weftline.functions.geo import fixed
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


def _placed_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every region with every nation's place."""
    g = fx.node_positions(s, d).where("node BETWEEN 2000000 AND 2999999")
    r = fx.node_positions(s, d).where("node BETWEEN 1000000 AND 1999999")
    return g.select(F.col("node").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon")).crossJoin(F.broadcast(r.select(F.col("node").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))))


_PAIRS = "WITH p AS (SELECT x.node AS a, x.lat AS alat, x.lon AS alon, y.node AS b, y.lat AS blat, y.lon AS blon FROM fx_node_pos x, fx_node_pos y WHERE x.node BETWEEN 2000000 AND 2999999 AND y.node BETWEEN 1000000 AND 1999999)"
_FIX = "floor(({0}) * 1000000.0 + 0.5) / 1000000.0"


def _fix(x: str) -> str:
    return _FIX.format(x)


@query(f"{_PAIRS} SELECT a, b, {_fix('2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(blat - alat) / 2), 2) + cos(radians(alat)) * cos(radians(blat)) * pow(sin(radians(blon - alon) / 2), 2))))')} AS km FROM p", "fx_node_pos")
def fn_haversine(s, d):
    return _placed_pairs(s, d).select("a", "b", fixed(geo.haversine("alat", "alon", "blat", "blon")).alias("km"))


@query(f"SELECT node, {_fix('(lon + 180) / 360')} AS x, {_fix('0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())')} AS y FROM fx_node_pos", "fx_node_pos")
def fn_merc(s, d):
    x, y = geo.mercator("lat", "lon")
    return fx.node_positions(s, d).select("node", fixed(x).alias("x"), fixed(y).alias("y"))


@query(f"SELECT node, {_fix('lat')} AS lat, {_fix('lon')} AS lon FROM fx_node_pos", "fx_node_pos")
def fn_unmerc(s, d):
    x, y = geo.mercator("lat", "lon")
    p = fx.node_positions(s, d).select("node", x.alias("x"), y.alias("y"))
    lat, lon = geo.unmercator("x", "y")
    return p.select("node", fixed(lat).alias("lat"), fixed(lon).alias("lon"))


@query(f"SELECT node, {_fix('cos(radians(lat)) * cos(radians(lon))')} AS x, {_fix('cos(radians(lat)) * sin(radians(lon))')} AS y, {_fix('sin(radians(lat))')} AS z FROM fx_node_pos", "fx_node_pos")
def fn_unit_vec(s, d):
    x, y, z = geo.unit_vector("lat", "lon")
    return fx.node_positions(s, d).select("node", fixed(x).alias("x"), fixed(y).alias("y"), fixed(z).alias("z"))


@query(f"WITH v AS (SELECT iso_country, sum(cos(radians(latitude_deg)) * cos(radians(longitude_deg))) AS x, sum(cos(radians(latitude_deg)) * sin(radians(longitude_deg))) AS y, sum(sin(radians(latitude_deg))) AS z FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL GROUP BY 1) SELECT iso_country, {_fix('degrees(asin(z / sqrt(x * x + y * y + z * z)))')} AS lat, {_fix('degrees(atan2(y, x))')} AS lon FROM v")
def fn_centroid(s, d):
    lat, lon = geo.centroid("latitude_deg", "longitude_deg")
    a = table(s, d, "airports").where("latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL")
    return a.groupBy("iso_country").agg(lat.alias("lat"), lon.alias("lon")).select("iso_country", fixed("lat").alias("lat"), fixed("lon").alias("lon"))


@query()
def fn_gcircle(s, d):
    return _placed_pairs(s, d).select("a", "b", F.posexplode(geo.great_circle_path("alat", "alon", "blat", "blon", 500.0)).alias("i", "p")).select("a", "b", "i", fixed("p.lat").alias("lat"), fixed("p.lon").alias("lon"))


@query(f"WITH p AS (SELECT node, radians(lat) AS p, radians(lon) AS l, radians(8.0) AS d, i, i * (2 * 3.141592653589793 / 24) AS az FROM fx_node_pos, (SELECT unnest(range(25)) AS i) WHERE node BETWEEN 2000000 AND 2999999), q AS (SELECT *, asin(least(1.0, greatest(-1.0, sin(p) * cos(d) + cos(p) * sin(d) * cos(az)))) AS lat2 FROM p) SELECT node, i::INT AS i, {_fix('degrees(lat2)')} AS lat, {_fix('degrees(l + atan2(sin(az) * sin(d) * cos(p), cos(d) - sin(p) * sin(lat2)))')} AS lon FROM q", "fx_node_pos")
def fn_ring(s, d):
    n = fx.node_positions(s, d).where("node BETWEEN 2000000 AND 2999999")
    return n.select("node", F.posexplode(geo.ring("lat", "lon", F.lit(8.0), 24)).alias("i", "p")).select("node", "i", fixed("p.lat").alias("lat"), fixed("p.lon").alias("lon"))


@query("WITH g AS (SELECT iso_region, min(latitude_deg) AS s, max(latitude_deg) AS n, min(longitude_deg) AS w, max(longitude_deg) AS e, min(CASE WHEN longitude_deg < 0 THEN longitude_deg + 360 ELSE longitude_deg END) AS w2, max(CASE WHEN longitude_deg < 0 THEN longitude_deg + 360 ELSE longitude_deg END) AS e2 FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL GROUP BY 1), h AS (SELECT *, (e2 - w2) < (e - w) AS o FROM g), i AS (SELECT iso_region, s, n, CASE WHEN o THEN w2 ELSE w END AS w, CASE WHEN o THEN e2 ELSE e END AS e FROM h) SELECT iso_region, CASE WHEN e - w <= 300 THEN s END AS south, CASE WHEN e - w <= 300 THEN w END AS west, CASE WHEN e - w <= 300 THEN n END AS north, CASE WHEN e - w <= 300 THEN e END AS east FROM i")
def fn_bounds(s, d):
    a = table(s, d, "airports").where("latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL")
    return a.groupBy("iso_region").agg(*geo.lon_bounds("latitude_deg", "longitude_deg"))


@query("SELECT doc_id, ip, n FROM fx_ips", "fx_ips")
def fn_ip_parse(s, d):
    return fx.addresses(s, d).select("doc_id", "ip", "n")


@query("SELECT doc_id, n, concat(n // 16777216, '.', n // 65536 % 256, '.', n // 256 % 256, '.', n % 256) AS text FROM fx_ips WHERE n IS NOT NULL", "fx_ips")
def fn_ip_text(s, d):
    return fx.addresses(s, d).where("n IS NOT NULL").select("doc_id", "n", net.ipv4_text("n").alias("text"))


@query("WITH p AS (SELECT rec_id, dst_addr FROM pings WHERE dst_addr IS NOT NULL) SELECT rec_id, CASE WHEN dst_addr LIKE '%:%' THEN 6 ELSE 4 END AS version, 16 AS size FROM p")
def fn_ip_bytes(s, d):
    p = table(s, d, "pings").where("dst_addr IS NOT NULL").select("rec_id", net.address_bytes("dst_addr").alias("b"))
    four = F.hex(F.substring("b", 1, 12)) == "00000000000000000000FFFF"
    return p.select("rec_id", F.when(four, 4).otherwise(6).alias("version"), F.octet_length("b").alias("size"))


_C4 = "WITH c AS (SELECT DISTINCT trim(c0) AS c0, string_split(string_split(trim(c0), '/')[1], '.') AS q, TRY_CAST(string_split(trim(c0), '/')[2] AS INT) AS plen FROM pops WHERE regexp_matches(trim(c0), '^[0-9.]+/[0-9]+$')), n AS (SELECT c0, plen, q[1]::BIGINT * 16777216 + q[2]::BIGINT * 65536 + q[3]::BIGINT * 256 + q[4]::BIGINT AS a FROM c WHERE plen <= 32 AND q[1]::INT <= 255 AND q[2]::INT <= 255 AND q[3]::INT <= 255 AND q[4]::INT <= 255), r AS (SELECT c0, plen, a - a % pow(2, 32 - plen)::BIGINT AS lo, pow(2, 32 - plen)::BIGINT AS size FROM n)"


def _pop_prefixes(s, d) -> DataFrame:
    p = table(s, d, "pops").select(F.trim("c0").alias("c0")).distinct().withColumn("p", net.cidr4("c0"))
    return p.where("p IS NOT NULL").select("c0", "p.lo", "p.hi", "p.plen")


@query(f"{_C4} SELECT c0, lo, lo + size - 1 AS hi, plen FROM r")
def fn_cidr_parse(s, d):
    return _pop_prefixes(s, d)


@query(f"{_C4} SELECT c0, concat(lo // 16777216, '.', lo // 65536 % 256, '.', lo // 256 % 256, '.', lo % 256, '/', plen) AS text FROM r")
def fn_cidr_fmt(s, d):
    return _pop_prefixes(s, d).select("c0", F.concat(net.ipv4_text("lo"), F.lit("/"), "plen").alias("text"))


@query("SELECT DISTINCT c0, version, plen, text FROM fx_canon", "fx_canon")
def fn_cidr_any(s, d):
    """Prefixes of both families, canonical, in prefix order."""
    p = table(s, d, "pops").select("c0").distinct().withColumn("p", net.cidr("c0"))
    return p.where("p.version IS NOT NULL").select("c0", "p.version", "p.plen", "p.text")


@query(f"{_C4}, w AS (SELECT DISTINCT lo, plen, lo + size - 1 AS hi FROM r WHERE plen <= 27) SELECT w.lo, w.plen, count(*) AS inside FROM w JOIN (SELECT DISTINCT lo, plen FROM r) x ON x.lo BETWEEN w.lo AND w.hi AND x.plen >= w.plen GROUP BY ALL")
def fn_contains(s, d):
    """IPv4 prefixes inside those of up to 27 bits, as its SQL; all of both families: fn_contains_any."""
    from weftline.operators.intervals import overlap_join

    p = _pop_prefixes(s, d).select("lo", "hi", "plen").distinct()
    wide = p.where("plen <= 27")
    j = overlap_join(wide, p, ("lo", "hi"), ("lo", "hi")).where("b_lo >= lo AND b_hi <= hi AND b_plen >= plen")
    return j.groupBy("lo", "plen").agg(F.count("*").alias("inside"))


def _prefixes_any(s, d) -> DataFrame:
    return table(s, d, "pops").select("c0").distinct().select(net.cidr("c0").alias("p")).where("p.version IS NOT NULL").select("p.version", "p.lo", "p.plen", "p.text").distinct()


@query("WITH k AS (SELECT DISTINCT version, plen, text, bits FROM fx_canon), inner_ AS (SELECT y.version, y.bits, y.plen, unnest(range(0, y.plen + 1)) AS w FROM k y), n AS (SELECT version, left(bits, w::INT) AS head, count(*) AS inside FROM inner_ GROUP BY ALL) SELECT k.version, k.plen, k.text AS prefix, n.inside FROM k JOIN n ON n.version = k.version AND n.head = left(k.bits, k.plen) AND len(n.head) = k.plen", "fx_canon")
def fn_contains_any(s, d):
    """How many prefixes of the feed each one of either family holds, itself included."""
    from weftline.operators.intervals import prefixes_inside

    p = _prefixes_any(s, d)
    return prefixes_inside(p, p).groupBy("version", "plen", F.col("text").alias("prefix")).agg(F.count("*").alias("inside"))


def _blocks_sql(n: str, blocks) -> str:
    return "(" + " OR ".join(f"{n} BETWEEN {lo} AND {hi}" for lo, hi in (net._range(*b) for b in blocks)) + ")"


@query(f"SELECT doc_id, ip, CASE WHEN {_blocks_sql('n', net.SHARED)} THEN 'shared' WHEN {_blocks_sql('n', net.PRIVATE)} THEN 'private' ELSE 'public' END AS kind FROM fx_ips WHERE n IS NOT NULL", "fx_ips")
def fn_addr_kind(s, d):
    return fx.addresses(s, d).where("n IS NOT NULL").select("doc_id", "ip", net.address_kind("n").alias("kind"))


@query(f"SELECT doc_id, ip, {_blocks_sql('n', net.BOGONS)} AS bogon FROM fx_ips WHERE n IS NOT NULL", "fx_ips")
def fn_bogon(s, d):
    return fx.addresses(s, d).where("n IS NOT NULL").select("doc_id", "ip", net.is_bogon("n").alias("bogon"))


@query(f"{_C4}, k AS (SELECT DISTINCT lo, plen FROM r) SELECT lo, plen, row_number() OVER (ORDER BY lo, plen) AS place FROM k")
def fn_prefix_key(s, d):
    """Place of each IPv4 prefix in prefix order, by range partitions and counts instead of one window over all; both families: fn_prefix_key_any."""
    from weftline.operators.ranking import global_rank

    return global_rank(_pop_prefixes(s, d).select("lo", "plen").distinct(), [F.col("lo"), F.col("plen")], "place")


@query("WITH k AS (SELECT DISTINCT version, plen, text, bits FROM fx_canon) SELECT version, plen, text AS prefix, row_number() OVER (ORDER BY version, bits, plen) AS place FROM k", "fx_canon")
def fn_prefix_key_any(s, d):
    """Place of each prefix of either family in prefix order: IPv4 first, then address and length."""
    from weftline.operators.ranking import global_rank

    p = global_rank(_prefixes_any(s, d), [F.col("version"), F.col("lo"), F.col("plen")], "place")
    return p.select("version", "plen", F.col("text").alias("prefix"), "place")


@query("WITH t AS (SELECT DISTINCT municipality AS name FROM airports WHERE municipality IS NOT NULL) SELECT name, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(name)), '\\([^)]*\\)', '', 'g'), '\\bsaint\\b', 'st', 'g'), '[^a-z0-9]', '', 'g') AS folded FROM t")
def fn_fold(s, d):
    c = table(s, d, "airports").where("municipality IS NOT NULL").select(F.col("municipality").alias("name")).distinct()
    return c.select("name", text.fold_name("name").alias("folded"))


_REGIONS = {"XA": "north", "XB": "north", "XC": "south", "XD": "south", "XE": "east", "QR": "west", "QV": "west"}


@query("SELECT id, CASE " + " ".join(f"WHEN upper(iso_country) = '{k}' THEN '{v}'" for k, v in _REGIONS.items()) + " ELSE 'unknown' END AS zone FROM airports")
def fn_region_of(s, d):
    return table(s, d, "airports").select("id", text.region_of_country("iso_country", _REGIONS).alias("zone"))


@query(f"SELECT id, {_fix('cbrt(398600.4418 / pow((12 + id % 5) * 2 * 3.141592653589793 / 86400, 2)) - 6378.137')} AS km FROM airports")
def fn_kepler(s, d):
    return table(s, d, "airports").select("id", fixed(geo.orbit_altitude_km((12 + F.col("id") % 5).cast("double"))).alias("km"))


def _xyz_sql() -> str:
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    n = f"({geo.WGS84_A} / sqrt(1 - {e2!r} * pow(sin(radians(latitude_deg)), 2)))"
    h = "(coalesce(elevation_ft, 0) * 0.0003048)"
    return f"SELECT id, ({n} + {h}) * cos(radians(latitude_deg)) * cos(radians(longitude_deg)) AS x, ({n} + {h}) * cos(radians(latitude_deg)) * sin(radians(longitude_deg)) AS y, ({n} * {1 - e2!r} + {h}) * sin(radians(latitude_deg)) AS z FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL"


def _airport_xyz(s, d) -> DataFrame:
    a = table(s, d, "airports").where("latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL")
    x, y, z = geo.ecef("latitude_deg", "longitude_deg", F.coalesce("elevation_ft", F.lit(0)) * F.lit(0.0003048))
    return a.select("id", "latitude_deg", "longitude_deg", x.alias("x"), y.alias("y"), z.alias("z"))


@query(f"SELECT id, {_fix('x')} AS x, {_fix('y')} AS y, {_fix('z')} AS z FROM ({_xyz_sql()})")
def fn_ecef(s, d):
    return _airport_xyz(s, d).select("id", *[fixed(c).alias(c) for c in "xyz"])


@query("SELECT id, floor(latitude_deg * 1000 + 0.5) / 1000 AS lat, floor(longitude_deg * 1000 + 0.5) / 1000 AS lon FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL")
def fn_geodetic(s, d):
    """There and back: the position again, to a thousandth of a degree."""
    lat, lon, _ = geo.geodetic("x", "y", "z")
    return _airport_xyz(s, d).select("id", fixed(F.floor(lat * 1e9 + 0.5) / 1e9, 3).alias("lat"), fixed(F.floor(lon * 1e9 + 0.5) / 1e9, 3).alias("lon"))


@query()
def fn_look(s, d):
    """Elevation and slant range of a satellite 550 km above each region's first nation, from each airport."""
    a = _airport_xyz(s, d)
    up = geo.unit_vector("latitude_deg", "longitude_deg")
    r = fx.node_positions(s, d).where("node BETWEEN 1000000 AND 1999999")
    sx, sy, sz = geo.ecef("lat", "lon", 550.0)
    sat = r.select("node", sx.alias("sx"), sy.alias("sy"), sz.alias("sz"))
    el, slant = geo.look(tuple(F.col(c) for c in "xyz"), up, (F.col("sx"), F.col("sy"), F.col("sz")))
    return a.crossJoin(F.broadcast(sat)).select("id", "node", fixed(el).alias("elevation"), fixed(slant).alias("slant_km"), fixed(geo.light_ms(slant)).alias("ms"))


@query("SELECT event_id, floor((epoch_ms(ts) - 12000) / 15000)::BIGINT AS slot FROM events")
def fn_slot(s, d):
    return table(s, d, "events").select("event_id", geo.slot_of(F.unix_millis(F.col("ts").cast("timestamp"))).cast("long").alias("slot"))


@query("WITH h AS (SELECT delivery_id, unnest(data.path) AS hop, generate_subscripts(data.path, 1) AS k FROM ris_frames WHERE data.path IS NOT NULL), f AS (SELECT *, CASE WHEN hop = lag(hop) OVER w AND NOT starts_with(hop, '{') THEN 0 ELSE 1 END AS fresh FROM h WINDOW w AS (PARTITION BY delivery_id ORDER BY k)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY delivery_id ORDER BY k) - 1 AS i FROM f) SELECT delivery_id, i::INT AS i, any_value(hop) AS hop, count(*)::INT AS n FROM r GROUP BY delivery_id, i")
def fn_fold_path(s, d):
    r = table(s, d, "ris_frames").where("data.path IS NOT NULL")
    return r.select("delivery_id", F.posexplode(text.fold_path("data.path")).alias("i", "p")).select("delivery_id", "i", "p.hop", "p.n")


@query("SELECT event_id, CASE WHEN (props->>'k')::INT <= 0 THEN '0' WHEN (props->>'k')::INT = 1 THEN '1' WHEN (props->>'k')::INT <= 5 THEN '2-5' WHEN (props->>'k')::INT <= 20 THEN '6-20' WHEN (props->>'k')::INT <= 100 THEN '21-100' ELSE '100+' END AS bucket FROM events")
def fn_sanitize(s, d):
    params = text.clean_params(F.from_json("props", "map<string,string>"), ["k"])
    return table(s, d, "events").select("event_id", text.count_bucket(params["k"].cast("int")).alias("bucket"))


@query("SELECT id, CASE WHEN country IS NULL OR country = '' THEN '?' WHEN region IS NULL OR region = '' THEN country WHEN starts_with(region, concat(country, '-')) THEN region ELSE concat(country, '-', region) END AS key FROM regions")
def fn_region_key(s, d):
    return table(s, d, "regions").select("id", text.region_key("country", "region", F.lit("?")).alias("key"))


@query(f"SELECT node, stop, {_fix('lat + (lon - lat) * stop / 8.0')} AS at FROM fx_node_pos, (SELECT unnest(range(9)) AS stop)", "fx_node_pos")
def fn_morph(s, d):
    """A value blended over nine stops between two layouts."""
    p = fx.node_positions(s, d).withColumn("stop", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    return p.select("node", "stop", fixed(F.col("lat") + (F.col("lon") - F.col("lat")) * F.col("stop") / 8.0).alias("at"))


@query(f"SELECT node, {_fix('0.6 + 0.55 * log2(degree + 1)')} AS radius FROM (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM fx_edges UNION ALL SELECT b FROM fx_edges) GROUP BY 1)", "fx_edges")
def fn_visual(s, d):
    from weftline.operators.graph import degrees

    return degrees(fx.edges(s, d)).select("node", fixed(0.6 + 0.55 * F.log2((F.col("degree") + 1).cast("double"))).alias("radius"))


@query("SELECT eid FROM fx_edges WHERE rel = -1 AND a >= 2000000 AND b < 4000000", "fx_edges")
def flt_edges(s, d):
    return fx.edges(s, d).where((F.col("rel") == -1) & (F.col("a") >= 2_000_000) & (F.col("b") < 4_000_000)).select("eid")


@query("SELECT eid FROM (SELECT e.eid, least(p.lon, q.lon) AS w, greatest(p.lon, q.lon) AS x, least(p.lat, q.lat) AS s, greatest(p.lat, q.lat) AS n FROM fx_edges e JOIN fx_node_pos p ON p.node = e.a JOIN fx_node_pos q ON q.node = e.b) WHERE w <= 10 AND x >= -60 AND s <= 20 AND n >= -30", "fx_edges fx_node_pos")
def flt_bbox(s, d):
    from weftline.operators.graph import place_edges

    e = place_edges(fx.edges(s, d), fx.node_positions(s, d))
    box = (F.least("alon", "blon") <= 10) & (F.greatest("alon", "blon") >= -60) & (F.least("alat", "blat") <= 20) & (F.greatest("alat", "blat") >= -30)
    return e.where(box).select("eid")


@query(f"WITH e AS (SELECT eid, p.lon AS x0, p.lat AS y0, q.lon - p.lon AS dx, q.lat - p.lat AS dy FROM fx_edges JOIN fx_node_pos p ON p.node = a JOIN fx_node_pos q ON q.node = b), s AS (SELECT *, [(-dx, x0 + 60.0), (dx, 10.0 - x0), (-dy, y0 + 30.0), (dy, 20.0 - y0)] AS c FROM e), t AS (SELECT *, greatest(0.0, list_max(list_transform(list_filter(c, lambda v: v[1] < 0), lambda v: v[2] / v[1]))) AS t0, least(1.0, list_min(list_transform(list_filter(c, lambda v: v[1] > 0), lambda v: v[2] / v[1]))) AS t1 FROM s WHERE len(list_filter(c, lambda v: v[1] = 0 AND v[2] < 0)) = 0) SELECT eid, {_fix('x0 + dx * t0')} AS x0, {_fix('y0 + dy * t0')} AS y0, {_fix('x0 + dx * t1')} AS x1, {_fix('y0 + dy * t1')} AS y1 FROM t WHERE t0 <= t1", "fx_edges fx_node_pos")
def fn_clip(s, d):
    from weftline.operators.graph import place_edges

    e = place_edges(fx.edges(s, d), fx.node_positions(s, d))
    c = e.select("eid", geo.clip_segment("alon", "alat", "blon", "blat", F.lit(-60.0), F.lit(-30.0), F.lit(10.0), F.lit(20.0)).alias("c")).where("c.ok")
    return c.select("eid", *[fixed(f"c.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])


@query()
def fn_range_cidrs(s, d):
    """The prefixes that cover each range, by the table function."""
    s.udtf.register("range_cidrs", net.RangeCidrs)
    fx.prefixes(s, d).withColumn("last", F.col("end") - F.col("asn") % 7).createOrReplaceTempView("wl_ranges")
    return s.sql("SELECT start, last, network, plen FROM wl_ranges, LATERAL range_cidrs(start, last)")


@query("SELECT id, lat, lon FROM regions WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def x_parse_at(s, d):
    t = table(s, d, "regions").select("id", F.concat(F.col("lat"), F.lit(" , "), F.col("lon")).alias("t")).withColumn("p", text.parse_position("t"))
    return t.where("p IS NOT NULL").select("id", "p.lat", "p.lon")


@query("SELECT id, concat('a=', id, '&b=', iso_country) AS written FROM airports")
def x_hash_rw(s, d):
    t = table(s, d, "airports").select("id", F.concat(F.lit("b="), F.col("iso_country"), F.lit("&Z=9&a="), F.col("id")).alias("t"))
    return t.select("id", text.format_params(text.parse_params("t")).alias("written"))


@query("WITH m AS (SELECT id, unnest(['country', 'region']) AS key, unnest([country IS DISTINCT FROM 'XA', region IS DISTINCT FROM 'XA-00']) AS differs FROM regions) SELECT id, key FROM m WHERE differs")
def set_hash_diff(s, d):
    put = lambda c, r: F.map_from_arrays(F.array(F.lit("country"), F.lit("region")), F.array(c, r))
    t = table(s, d, "regions").select("id", text.changed_groups(put(F.col("country"), F.col("region")), put(F.lit("XA"), F.lit("XA-00"))).alias("k"))
    return t.select("id", F.explode("k").alias("key"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'links,pops' WHEN n_nationkey % 3 = 1 THEN 'pops' END AS shown FROM nation")
def fn_layer_params(s, d):
    raw = F.when(F.col("n_nationkey") % 3 == 0, "pops, what,links").when(F.col("n_nationkey") % 3 == 1, "pops").otherwise("junk")
    return table(s, d, "nation").select("n_nationkey", text.list_param(raw, ["links", "pops", "routes"]).alias("shown"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 8 THEN 'low' WHEN n_nationkey < 16 THEN 'mid' ELSE 'high' END AS band FROM nation")
def x_shell_colour(s, d):
    """The first band whose bound is above the value."""
    n = F.col("n_nationkey")
    return table(s, d, "nation").select("n_nationkey", F.when(n < 8, "low").when(n < 16, "mid").otherwise("high").alias("band"))


@query("SELECT eid, concat(a, '-', b) AS key FROM fx_edges", "fx_edges")
def x_links_key(s, d):
    return fx.edges(s, d).select("eid", F.concat_ws("-", "a", "b").alias("key"))


@query(f"SELECT node, {_fix('6371.0 * (1 - cos(radians(abs(lat))))')} AS drop_km FROM fx_node_pos", "fx_node_pos")
def x_curvature(s, d):
    return fx.node_positions(s, d).select("node", fixed(6371.0 * (1 - F.cos(F.radians(F.abs("lat"))))).alias("drop_km"))


@query("SELECT unnest(range(-180, 181, 15)) AS lon, 'meridian' AS kind UNION ALL SELECT unnest(range(-75, 76, 15)), 'parallel'")
def x_graticule(s, d):
    line = lambda a, b, k: s.range(1).select(F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(15).cast("long"))).alias("lon"), F.lit(k).alias("kind"))
    return line(-180, 180, "meridian").union(line(-75, 75, "parallel"))


@query("SELECT rec_id, i AS vertex, prb_id FROM (SELECT rec_id, prb_id, unnest(range(len(result))) AS i FROM pings WHERE result IS NOT NULL)")
def x_per_vertex(s, d):
    """A row's value repeated over its elements."""
    p = table(s, d, "pings").where("result IS NOT NULL").select("rec_id", "prb_id", F.posexplode("result").alias("i", "e"))
    return p.select("rec_id", F.col("i").cast("long").alias("vertex"), "prb_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT ELSE c_custkey END AS weight FROM customer")
def x_pop_weight(s, d):
    return table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).otherwise(F.col("c_custkey")).alias("weight"))


@query("SELECT event_id, CASE WHEN value > 0 AND event_type <> 'view' THEN value ELSE event_id::DOUBLE END AS at FROM events")
def x_model_time(s, d):
    return table(s, d, "events").select("event_id", F.when((F.col("value") > 0) & (F.col("event_type") != "view"), F.col("value")).otherwise(F.col("event_id").cast("double")).alias("at"))


# --- sorts, limits, top-k ----------------------------------------------------


@query(f"{_PAIRS} SELECT a, b FROM (SELECT a, b, row_number() OVER (ORDER BY round(km, 6) DESC, a, b) AS k FROM (SELECT a, b, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(blat - alat) / 2), 2) + cos(radians(alat)) * cos(radians(blat)) * pow(sin(radians(blon - alon) / 2), 2)))) AS km FROM p) WHERE km >= 500) WHERE k <= 10", "fx_node_pos")
def topk_farthest(s, d):
    p = _placed_pairs(s, d).withColumn("km", F.round(geo.haversine("alat", "alon", "blat", "blon"), 6)).where("km >= 500")
    return p.orderBy(F.desc("km"), "a", "b").limit(10).select("a", "b")


@query("SELECT a, b, k::INT AS k FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY -ln(-ln((('0x' || left(md5(eid || '-7'), 7))::BIGINT + 1) / 268435457.0)) DESC, b) AS k FROM fx_edges WHERE rel = -1) WHERE k <= 4", "fx_edges")
def topk_partition(s, d):
    """Four of each customer's neighbours drawn without replacement, by the greatest random keys (seeded by a digest)."""
    e = fx.edges(s, d).where("rel = -1")
    draw = F.conv(F.substring(F.md5(F.concat("eid", F.lit("-7")).cast("binary")), 1, 7), 16, 10).cast("long")
    u = (draw + 1) / 268_435_457.0
    w = Window.partitionBy("a").orderBy(F.desc(-F.log(-F.log(u))), "b")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 4").select("a", "b", "k")


@query("SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 200")
def sort_ring(s, d):
    return table(s, d, "events").orderBy(F.desc("event_id")).limit(200).select("event_id", "ts")


@query("SELECT event_id, (SELECT count(*) FROM events WHERE value > 50) > 1000 AS truncated FROM events WHERE value > 50 ORDER BY event_id LIMIT 1000")
def lim_moved(s, d):
    """The first thousand and whether there were more."""
    e = table(s, d, "events").where("value > 50")
    total = e.agg((F.count("*") > 1000).alias("truncated"))
    return e.orderBy("event_id").limit(1000).select("event_id").crossJoin(F.broadcast(total))


