"""Queries over places: gazetteers, routers' names, airports of PoPs, fallbacks, centroids and exchanges."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.geo import fixed
from weftline.functions.text import STOP_WORDS
from weftline.operators import places
from weftline.plans.tables import table
from weftline.session import staged_path
from weftline.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_FIX = "floor(({0}) * 1000000.0 + 0.5) / 1000000.0"
_GAZ = """good AS (SELECT DISTINCT id, lower(trim(iata_code)) AS code, municipality AS city, latitude_deg AS lat, longitude_deg AS lon FROM airports WHERE regexp_matches(lower(trim(iata_code)), '^[a-z]{3}$') AND latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL),
codes AS (SELECT code, min(id) AS id FROM good GROUP BY 1), cities AS (SELECT regexp_replace(lower(city), '[^a-z]', '', 'g') AS letters, min(id) AS id FROM good WHERE len(regexp_replace(lower(city), '[^a-z]', '', 'g')) >= 5 GROUP BY 1)"""


def _airports(s, d):
    """Airports as records of a JSON list."""
    a = table(s, d, "airports").select(F.to_json(F.struct("id", F.col("iata_code").alias("iata"), F.col("municipality").alias("city"), F.col("latitude_deg").alias("latitude"), F.col("longitude_deg").alias("longitude"))).alias("value"))
    r = a.select(F.from_json("value", "id long, iata string, city string, latitude double, longitude double").alias("j")).select("j.*")
    return r.select("id", F.col("iata").alias("code"), "city", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


@query(f"WITH {_GAZ} SELECT 'code' AS kind, code AS key, id FROM codes UNION ALL SELECT 'city', letters, id FROM cities")
def src_iata_json(s, d):
    """Both lookups of the gazetteer: by code and by the letters of the city."""
    codes, cities = places.gazetteer(_airports(s, d))
    return codes.select(F.lit("code").alias("kind"), F.col("code").alias("key"), "id").unionByName(cities.select(F.lit("city").alias("kind"), F.col("letters").alias("key"), "id"))


@query(f"WITH {_GAZ} SELECT kind, k.key, g.id, floor(g.lat * 1000 + 0.5) / 1000 AS lat, floor(g.lon * 1000 + 0.5) / 1000 AS lon, upper(g.code) AS place FROM (SELECT 'code' AS kind, code AS key, id FROM codes UNION ALL SELECT 'city', letters, id FROM cities) k JOIN (SELECT id, min(lat) AS lat, min(lon) AS lon, min(code) AS code FROM good GROUP BY 1) g USING (id)")
def snk_iata(s, d):
    """The lookups as a document of records, read back."""
    codes, cities = places.gazetteer(_airports(s, d))
    at = ("id", fixed("lat", 3).alias("lat"), fixed("lon", 3).alias("lon"), "place")
    rows = codes.select(F.lit("code").alias("kind"), F.col("code").alias("key"), *at).unionByName(cities.select(F.lit("city").alias("kind"), F.col("letters").alias("key"), *at))
    out = staged_path(s, "gazetteer")
    sinks.write_json_records(rows, out)
    return s.read.schema(rows.schema).json(out)


def _hosts(s, d):
    """Names of routers made of airports' codes and cities: codes with digits, bare ones inside and outside, cities, the operator's own name."""
    a = table(s, d, "airports").select("id", F.lower(F.trim("iata_code")).alias("c"), F.regexp_replace(F.lower("municipality"), "[^a-z]", "").alias("m"))
    forms = [F.concat(F.lit("ae1-2."), "c", F.lit("02.core.carrier.net")), F.concat(F.lit("xe0."), "c", F.lit(".rtr.carrier.net")), F.concat(F.col("c"), F.lit(".carrier.net")), F.concat(F.lit("cr1."), "m", F.lit("3."), "c", F.lit("1.isp.org")), F.concat(F.lit("a."), "m", F.lit(".net")), F.concat(F.lit("pos-"), "c", F.lit("7b12_"), "c", F.lit(".example.com"))]
    return a.select("id", F.posexplode(F.array(*forms)).alias("form", "host")).where("host IS NOT NULL").distinct().select(F.concat_ws(":", "id", "form", "host").alias("name"), "host")


_HINTS = f"""{_GAZ}, a AS (SELECT DISTINCT id, lower(trim(iata_code)) AS c, regexp_replace(lower(municipality), '[^a-z]', '', 'g') AS m FROM airports),
hosts AS (SELECT concat_ws(':', id, form, host) AS name, host FROM (
  SELECT id, 0 AS form, 'ae1-2.' || c || '02.core.carrier.net' AS host FROM a UNION ALL SELECT id, 1, 'xe0.' || c || '.rtr.carrier.net' FROM a UNION ALL SELECT id, 2, c || '.carrier.net' FROM a
  UNION ALL SELECT id, 3, 'cr1.' || m || '3.' || c || '1.isp.org' FROM a UNION ALL SELECT id, 4, 'a.' || m || '.net' FROM a UNION ALL SELECT id, 5, 'pos-' || c || '7b12_' || c || '.example.com' FROM a) WHERE host IS NOT NULL),
lists AS (SELECT name, list_filter(regexp_split_to_array(host, '[.\\-_]'), lambda t: t <> '') AS l, flatten(list_transform(string_split(host, '.')[-2:], lambda t: regexp_split_to_array(t, '[-_]'))) AS own FROM hosts),
toks AS (SELECT name, own, len(l) AS n, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM lists),
seen AS (SELECT *, regexp_extract(token, '^([a-z]{{3}})(\\d{{1,3}}(?:[a-z]{{1,2}}\\d{{0,3}})?)?$', 1) AS code, regexp_extract(token, '^([a-z]{{3}})(\\d{{1,3}}(?:[a-z]{{1,2}}\\d{{0,3}})?)?$', 2) <> '' AS digits, regexp_replace(token, '\\d+$', '') AS letters FROM toks WHERE NOT list_contains(own, token)),
marked AS (SELECT seen.*, codes.id AS code_id, codes.id IS NOT NULL AND (digits OR pos > 0 AND pos < n - 2) AS is_code FROM seen LEFT JOIN codes ON codes.code = seen.code AND codes.code NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})),
hints AS (SELECT name, pos::INT AS pos, token, CASE WHEN is_code THEN 'iata' ELSE 'city' END AS kind, is_code AND digits AS digits, CASE WHEN is_code THEN code_id ELSE c.id END AS id FROM marked LEFT JOIN cities c ON c.letters = marked.letters AND len(marked.letters) >= 5 AND NOT is_code WHERE is_code OR c.id IS NOT NULL)"""


def _hints(s, d):
    codes, cities = places.gazetteer(_airports(s, d))
    return places.host_hints(_hosts(s, d), "name", "host", codes, cities)


@query(f"WITH {_HINTS} SELECT name, pos, token, kind, id FROM hints")
def fn_hints(s, d):
    """All places that the tokens of routers' names may mean."""
    return _hints(s, d).select(F.col("key").alias("name"), "pos", "token", "kind", "id")


@query(f"WITH {_HINTS} SELECT name, token, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind <> 'city', NOT digits, pos) AS k FROM hints) WHERE k = 1")
def fn_locate(s, d):
    """The best of them: a city first, then a code with digits, then a bare code."""
    return places.locate(_hints(s, d)).select(F.col("key").alias("name"), "token", "kind", "id")


_RANKED = "ranked AS (SELECT DISTINCT *, CASE WHEN type = 'closed' THEN 9 ELSE coalesce(nullif(list_position([" + ", ".join(f"'{k}'" for k in places.KINDS) + "], type), 0) - 1, 8) END AS r1, coalesce(scheduled_service, '') <> 'yes' AS r2 FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL)"
_METRO = "metro AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in places.METRO.items()) + ") AS t(area, main))"


@query(f"WITH {_RANKED}, {_METRO}, best AS (SELECT lower(trim(iata_code)) AS k, arg_min(id, (r1, r2, id)) AS airport FROM ranked WHERE len(trim(iata_code)) = 3 GROUP BY 1), p AS (SELECT snap, line_no, regexp_replace(lower(trim(c2)), '\\d+$', '') AS bare FROM pops) SELECT DISTINCT snap, line_no, coalesce(x.airport, y.airport) AS airport, CASE WHEN x.airport IS NOT NULL THEN 'iata' WHEN y.airport IS NOT NULL THEN 'metro' END AS how FROM p LEFT JOIN best x ON x.k = bare AND len(bare) = 3 LEFT JOIN metro ON area = bare LEFT JOIN best y ON y.k = main")
def join_airport(s, d):
    """The airport of each line of the PoP feed, and how it was found."""
    p = table(s, d, "pops").select("snap", "line_no", F.trim("c2").alias("code")).distinct()
    return places.airport_of(p, "code", table(s, d, "airports")).select("snap", "line_no", "airport", "how").distinct()


_V = "sum({w}cos(radians(latitude_deg)) * cos(radians(longitude_deg))) AS x, sum({w}cos(radians(latitude_deg)) * sin(radians(longitude_deg))) AS y, sum({w}sin(radians(latitude_deg))) AS z".replace("{w}", "")
_CENTRAL = "type IN ('large_airport', 'medium_airport', 'small_airport')"
_CENTROIDS = f"pts AS (SELECT id, iso_country, iso_region, type, latitude_deg, longitude_deg FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL), rsum AS (SELECT iso_region AS k, {_V} FROM pts WHERE {_CENTRAL} AND iso_region IS NOT NULL GROUP BY 1), csum AS (SELECT iso_country AS k, {_V} FROM pts p WHERE iso_country IS NOT NULL AND ({_CENTRAL} OR iso_country NOT IN (SELECT iso_country FROM pts WHERE {_CENTRAL} AND iso_country IS NOT NULL)) GROUP BY 1), mid AS (SELECT what, k, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS lat, degrees(atan2(y, x)) AS lon FROM (SELECT 'region' AS what, * FROM rsum UNION ALL SELECT 'country', * FROM csum) WHERE sqrt(x * x + y * y + z * z) >= 1e-9)"


@query(f"WITH {_CENTROIDS} SELECT what, k, {_FIX.format('lat')} AS lat, {_FIX.format('lon')} AS lon FROM mid")
def agg_centroids(s, d):
    """The middle of each region's and each country's airports on the sphere."""
    regions, countries = places.centroids(table(s, d, "airports"))
    both = regions.select(F.lit("region").alias("what"), F.col("iso_region").alias("k"), "lat", "lon").union(countries.select(F.lit("country"), "iso_country", "lat", "lon"))
    return both.select("what", "k", fixed("lat").alias("lat"), fixed("lon").alias("lon"))


_FOLD = "regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '\\([^)]*\\)', '', 'g'), '\\bsaint\\b', 'st', 'g'), '[^a-z0-9]', '', 'g')"
_PLACE = f"{_RANKED}, {_CENTROIDS}, named AS (SELECT * FROM (SELECT iso_country AS cc, iso_region AS rg, r1, r2, id, latitude_deg AS lat, longitude_deg AS lon, {_FOLD.format('name')} AS f FROM (SELECT * EXCLUDE (name), unnest(list_concat([municipality], CASE WHEN type IN ('large_airport', 'medium_airport') AND keywords IS NOT NULL THEN string_split(keywords, ',') ELSE [] END)) AS name FROM ranked) WHERE name IS NOT NULL) WHERE f <> ''), n1 AS (SELECT cc, rg, f, arg_min((lat, lon), (r1, r2, id)) AS p FROM named WHERE cc IS NOT NULL AND rg IS NOT NULL GROUP BY ALL), n2 AS (SELECT cc, f, arg_min((lat, lon), (r1, r2, id)) AS p FROM named WHERE cc IS NOT NULL GROUP BY ALL), n5 AS (SELECT f, arg_min((lat, lon), (r1, r2, id)) AS p FROM named GROUP BY ALL), g AS (SELECT DISTINCT id, country, region, city, {_FOLD.format('city')} AS f FROM regions), hit AS (SELECT g.*, n1.p AS p1, n2.p AS p2, CASE WHEN m3.k IS NOT NULL THEN (m3.lat, m3.lon) END AS p3, CASE WHEN m4.k IS NOT NULL THEN (m4.lat, m4.lon) END AS p4, n5.p AS p5 FROM g LEFT JOIN n1 ON n1.cc = country AND n1.rg = region AND n1.f = g.f LEFT JOIN n2 ON n2.cc = country AND n2.f = g.f LEFT JOIN mid m3 ON m3.what = 'region' AND m3.k = region LEFT JOIN mid m4 ON m4.what = 'country' AND m4.k = country LEFT JOIN n5 ON n5.f = g.f)"


@query(f"WITH {_PLACE} SELECT id, country, region, city, {_FIX.format('coalesce(p1, p2, p3, p4, p5)[1]')} AS lat, {_FIX.format('coalesce(p1, p2, p3, p4, p5)[2]')} AS lon, CASE WHEN p1 IS NOT NULL OR p2 IS NOT NULL THEN 'city' WHEN p3 IS NOT NULL THEN 'region' WHEN p4 IS NOT NULL THEN 'country' WHEN p5 IS NOT NULL THEN 'city' END AS precision FROM hit")
def join_place(s, d):
    """The place of each region of the feed by the chain of fallbacks, and how precise it is."""
    g = table(s, d, "regions").select("id", "country", "region", "city").distinct()
    r = places.place_of(g, "country", "region", "city", table(s, d, "airports"))
    return r.select("id", "country", "region", "city", fixed("lat").alias("lat"), fixed("lon").alias("lon"), "precision")


# --- exchanges: five documents in the registry's shapes, made of suppliers (facilities), nations (exchanges) and customers (ports) ------------------

_PORT, _NETFAC, _IX = "ix_id long, name string, speed long, operational boolean", "fac_id long", "id long, name string, city string, country string"
_AT, _FAC = "ix_id long, fac_id long", "id long, name string, city string, country string, latitude double, longitude double"


def _documents(s, d):
    """The five documents as lines of JSON, parsed."""
    n, sup, c = table(s, d, "nation"), table(s, d, "supplier"), table(s, d, "customer")
    parsed = lambda df, schema: df.select(F.to_json(F.struct("*")).alias("value")).select(F.from_json("value", schema).alias("j")).select("j.*")
    town = lambda k: F.concat(F.lit("C"), k % 7)
    land = lambda k: F.concat(F.lit("R"), k % 5)
    ports = c.where("c_nationkey < 20").select(F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("ix_id"), F.lit("port").alias("name"), ((F.col("c_custkey") % 4 + 1) * 10_000).alias("speed"), (F.col("c_custkey") % 5 != 0).alias("operational"))
    mine = sup.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("fac_id"))
    ix = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_name")).otherwise(F.lit("")).alias("name"), town(F.col("n_nationkey")).alias("city"), land(F.col("n_nationkey")).alias("country"))
    at = sup.where("s_nationkey > 2").select(F.col("s_nationkey").alias("ix_id"), F.col("s_suppkey").alias("fac_id")).union(sup.where("s_suppkey % 5 = 0").select((F.col("s_nationkey") * 7 + 3) % 25, "s_suppkey"))
    fac = sup.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.upper(town(F.col("s_suppkey"))).alias("city"), land(F.col("s_suppkey")).alias("country"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 120 - 60.0).alias("latitude"), (F.col("s_suppkey") % 300 - 150.0).alias("longitude"))
    return parsed(ports, _PORT), parsed(mine, _NETFAC), parsed(ix, _IX), parsed(at, _AT), parsed(fac, _FAC)


_DOCS = """ports AS (SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END::BIGINT AS ix_id, (c_custkey % 4 + 1) * 10000 AS speed, c_custkey % 5 <> 0 AS operational FROM customer WHERE c_nationkey < 20),
mine AS (SELECT s_suppkey AS fac_id FROM supplier WHERE s_suppkey % 3 = 0),
ix AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 6 <> 0 THEN n_name ELSE '' END AS name, concat('C', n_nationkey % 7) AS city, concat('R', n_nationkey % 5) AS country FROM nation),
iat AS (SELECT DISTINCT * FROM (SELECT s_nationkey AS ix_id, s_suppkey AS fac_id FROM supplier WHERE s_nationkey > 2 UNION ALL SELECT (s_nationkey * 7 + 3) % 25, s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)),
fac AS (SELECT s_suppkey AS id, concat('C', s_suppkey % 7) AS city, concat('R', s_suppkey % 5) AS country, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 120 - 60.0 END AS latitude, s_suppkey % 300 - 150.0 AS longitude FROM supplier)"""


@query(f"WITH {_DOCS}, r1 AS (SELECT DISTINCT ix_id FROM ports WHERE ix_id IS NOT NULL), r2 AS (SELECT * FROM iat WHERE ix_id IN (SELECT ix_id FROM r1)) SELECT 'ix' AS document, id::BIGINT AS id FROM ix WHERE id IN (SELECT ix_id FROM r1) UNION ALL SELECT 'ixfac', fac_id FROM r2 UNION ALL SELECT DISTINCT 'fac', id FROM fac WHERE id IN (SELECT fac_id FROM r2) OR id IN (SELECT fac_id FROM mine)")
def src_peeringdb(s, d):
    """Three rounds, each asking only for the ids that the last one named: ports and facilities, exchanges and their facilities, facilities."""
    ports, mine, ix, at, fac = _documents(s, d)
    asked = ports.where("ix_id IS NOT NULL").select(F.col("ix_id").alias("id")).distinct()
    second = at.distinct().join(asked.withColumnRenamed("id", "ix_id"), "ix_id", "left_semi")
    third = fac.select("id").distinct().join(second.select(F.col("fac_id").alias("id")).union(mine.select("fac_id")).distinct(), "id", "left_semi")
    tag = lambda df, name: df.select(F.lit(name).alias("document"), F.col("id").cast("long").alias("id"))
    return tag(ix.join(asked, "id", "left_semi"), "ix").union(tag(second.withColumnRenamed("fac_id", "id"), "ixfac")).union(tag(third, "fac"))


_LEVELS = ("m AND c", "c", "m AND l", "l", "m", "true")


@query(f"WITH {_DOCS}, p AS (SELECT ix_id AS id, count(*) AS ports, sum(speed)::BIGINT AS speed FROM ports WHERE operational AND ix_id IS NOT NULL GROUP BY 1), j AS (SELECT p.*, ix.name, ix.city, ix.country FROM p JOIN ix USING (id)), f AS (SELECT j.id, latitude, longitude, fac_id IN (SELECT fac_id FROM mine) AS m, lower(fac.city) = lower(j.city) AS c, fac.country = j.country AS l FROM j JOIN iat ON ix_id = j.id JOIN fac ON fac.id = fac_id WHERE latitude IS NOT NULL), g AS (" + " UNION ALL ".join(f"SELECT id, {i} AS level, avg(latitude) AS lat, avg(longitude) AS lon FROM f WHERE {w} GROUP BY 1" for i, w in enumerate(_LEVELS)) + f"), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS k FROM g) WHERE k = 1) SELECT id, coalesce(nullif(name, ''), 'port') AS name, city, country, CASE WHEN level % 2 = 0 THEN 'shared' WHEN level IS NOT NULL THEN 'ix' END AS located, {_FIX.format('lat')} AS lat, {_FIX.format('lon')} AS lon, ports, speed FROM j LEFT JOIN b USING (id)")
def join_peering(s, d):
    """The exchanges of a network, placed by the first of six groups of facilities that has a position."""
    r = places.exchanges(*_documents(s, d))
    return r.select("id", "name", "city", "country", "located", fixed("lat").alias("lat"), fixed("lon").alias("lon"), "ports", "speed")
