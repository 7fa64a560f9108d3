"""Queries over the smaller sources, labels and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import net, text
from weftline.functions.geo import fixed
from weftline.operators.ranking import global_rank
from weftline.plans.tables import table
from weftline.plans.worlds import _constellation
from weftline.sources import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH a AS (SELECT DISTINCT id, name, latitude_deg AS lat, longitude_deg AS lon FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL), k AS (SELECT *, CASE WHEN id % 2 = 0 THEN concat('SAB-LIC-X1-', id) ELSE coalesce(name, '') END AS key FROM a) SELECT key, lat, lon, coalesce(name, '') AS name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC, lat DESC, lon DESC) AS n FROM k) WHERE n = 1")
def src_satsim_json(s, d):
    """Sites of JSON lists by the number of their filing, found in the description, else by their name; the last of equals holds. Those without coordinates go."""
    a = table(s, d, "airports").select("id", "iso_country", F.to_json(F.struct("id", "name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Gateway, see SAB-LIC-X1-"), "id", F.lit(" of last year"))).otherwise("plain").alias("description"), F.when(F.col("latitude_deg").isNotNull(), F.array("longitude_deg", "latitude_deg")).otherwise(F.array().cast("array<double>")).alias("coordinates"))).alias("x")).distinct()
    lists = a.groupBy("iso_country").agg(F.concat(F.lit("["), F.concat_ws(",", F.sort_array(F.collect_list("x"))), F.lit("]")).alias("value"))
    g = lists.select(F.explode(F.from_json("value", "array<struct<id: long, name: string, description: string, coordinates: array<double>>>")).alias("g")).select("g.*").where((F.size("coordinates") >= 2) & F.get("coordinates", F.lit(0)).isNotNull())
    number = F.regexp_extract("description", r"(S[A-Z]{2}-[A-Z]{3}-[A-Z0-9]+-\d+)", 1)
    rows = g.select(F.coalesce(F.nullif(number, F.lit("")), "name", F.lit("")).alias("key"), F.struct("id", F.col("coordinates")[1].alias("lat"), F.col("coordinates")[0].alias("lon"), F.coalesce("name", F.lit("")).alias("name")).alias("r"))
    return rows.groupBy("key").agg(F.max("r").alias("r")).select("key", "r.lat", "r.lon", "r.name")


def _gp(s, d):
    c = _constellation(s, d)
    epoch = F.concat(F.lit("2026-11-01T00:"), F.lpad((F.col("sat") % 60).cast("string"), 2, "0"), F.lit(":00"))
    return c.select(F.to_json(F.struct(F.when(F.col("sat") % 11 != 0, F.col("sat")).alias("NORAD_CAT_ID"), F.when(F.col("sat") % 7 != 0, F.col("mean_motion")).alias("MEAN_MOTION"), epoch.alias("EPOCH"))).alias("value"))


_GP = "gp AS (SELECT s_suppkey AS number, CASE WHEN s_suppkey % 2 = 1 THEN 15.06 ELSE 15.25 END::DOUBLE AS mean_motion, concat('2026-11-01T00:', lpad((s_suppkey % 60)::VARCHAR, 2, '0'), ':00') AS epoch FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0)"


@query(f"WITH {_GP} SELECT row_number() OVER (ORDER BY number) AS place, number, mean_motion, epoch, min(epoch) OVER () AS least, max(epoch) OVER () AS most FROM gp")
def src_gp_json(s, d):
    """Element sets in columns, in the order of their numbers, with the span of their epochs; sets without number or mean motion are left out."""
    e = feeds.elements(_gp(s, d)).select(F.col("NORAD_CAT_ID").alias("number"), F.col("MEAN_MOTION").alias("mean_motion"), F.col("EPOCH").alias("epoch"))
    span = F.broadcast(e.agg(F.min("epoch").alias("least"), F.max("epoch").alias("most")))
    return global_rank(e, [F.col("number")], "place").crossJoin(span).select("place", "number", "mean_motion", "epoch", "least", "most")


@query("WITH r AS (SELECT s_nationkey AS doc, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'odd' WHEN s_suppkey % 3 = 0 THEN concat('2020-', lpad((s_suppkey % 1000)::VARCHAR, 3, '0'), 'A') ELSE 'BC' END AS d FROM supplier), m AS (SELECT *, last_value(CASE WHEN d <> 'BC' THEN CASE WHEN d = 'odd' THEN '' ELSE left(d, 8) END END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS launch FROM r) SELECT doc, pos::INT AS pos, id::BIGINT AS number, CASE WHEN d = 'BC' AND coalesce(launch, '') <> '' THEN concat(launch, d) ELSE d END AS designator, 1793491200000 + id * 1000 AS epoch_ms, (1506000000 + id) / 1e8 AS mean_motion, (id % 1000) / 1e4 AS inclination FROM m")
def src_omm_compact(s, d):
    """Compact column documents decoded: running ids, epochs after a base, inherited launches, fixed-point scales."""
    sup = table(s, d, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("k"))
    w = Window.partitionBy("doc").orderBy("k")
    name = F.when(F.col("k") % 5 == 0, "odd").when(F.col("k") % 3 == 0, F.concat(F.lit("2020-"), F.lpad((F.col("k") % 1000).cast("string"), 3, "0"), F.lit("A"))).otherwise("BC")
    r = sup.select("doc", "k", (F.col("k") - F.coalesce(F.lag("k").over(w), F.lit(0))).alias("id"), name.alias("intlId"))
    rows = F.array_sort(F.collect_list(F.struct("k", "id", "intlId")))
    docs = r.groupBy("doc").agg(rows.alias("r"))
    part = lambda f: F.transform("r", f)
    zero = lambda n: part(lambda x: F.lit(0)).alias(n)
    doc = F.struct(F.lit("2026-11-01T00:00:00Z").alias("epochBase"), part(lambda x: x["intlId"]).alias("intlId"), part(lambda x: x["id"]).alias("id"), part(lambda x: x["k"] * 1000).alias("epoch"), part(lambda x: x["k"] + 1_506_000_000).alias("n"), zero("e"), part(lambda x: x["k"] % 1000).alias("i"), *[zero(k) for k in ("raan", "argp", "ma", "bstar")])
    e = feeds.compact_elements(docs.select("doc", F.to_json(doc).alias("value")))
    return e.select("doc", "pos", F.col("NORAD_CAT_ID").alias("number"), F.col("OBJECT_ID").alias("designator"), "epoch_ms", F.col("MEAN_MOTION").alias("mean_motion"), F.col("INCLINATION").alias("inclination"))


@query(f"WITH {_GP}, t AS (SELECT list_sort(list(epoch)) AS l FROM gp) SELECT 'snapshot' AS source, len(l) AS satellites, l[1] AS least, l[len(l) // 2 + 1] AS middle, l[len(l)] AS most, 'compact: AnalysisException, empty: no rows' AS tried FROM t")
def src_elements(s, d):
    """Elements of the first source that answers, with the span and the upper median of their epochs, and what the others said."""
    missing = lambda: feeds.compact_elements(s.read.text(f"{d}/no-such-document.json").withColumn("doc", F.lit(0)))
    sources = [("compact", missing), ("empty", lambda: feeds.elements(_gp(s, d).where("false"))), ("snapshot", lambda: feeds.elements(_gp(s, d))), ("live", lambda: feeds.elements(_gp(s, d)))]
    name, e, tried = feeds.first_answer(sources)
    ranked = global_rank(e.select(F.col("EPOCH").alias("epoch"), F.col("NORAD_CAT_ID").alias("n")), [F.col("epoch"), F.col("n")], "k", 0)
    n = F.broadcast(e.agg(F.count("*").alias("satellites"), F.min("EPOCH").alias("least"), F.max("EPOCH").alias("most")))
    middle = ranked.crossJoin(n).where(F.col("k") == F.floor(F.col("satellites") / 2))
    return middle.select(F.lit(name).alias("source"), "satellites", "least", F.col("epoch").alias("middle"), "most", F.lit(", ".join(f"{a}: {b}" for a, b in tried)).alias("tried"))


@query("WITH a AS (SELECT DISTINCT id, latitude_deg AS lat FROM airports) SELECT id, CASE WHEN id % 9 = 0 THEN 'not a gateway' WHEN lat IS NULL THEN 'no location' WHEN id % 4 = 0 AND id % 3 = 0 THEN 'filing' WHEN id % 5 = 0 OR id % 7 = 0 THEN 'reported' WHEN id % 2 = 0 THEN 'no source' ELSE 'city estimate' END AS tier FROM a")
def fn_classify_site(s, d):
    """Which of six tiers a site record is in, by the first rule that holds."""
    a = table(s, d, "airports").select("id", F.col("latitude_deg").alias("lat")).distinct()
    k = F.col("id")
    sites = a.select("id", "lat", F.when(k % 9 == 0, "relay").otherwise("site-gateway").alias("node"), F.when(k % 4 == 0, F.concat(F.lit("F"), "id")).alias("filing"), F.when(k % 3 == 0, "filing").otherwise("guess").alias("confidence"), F.when(k % 5 == 0, "Confirmed operational since spring").otherwise("").alias("notes"), F.when(k % 7 == 0, "wikipedia").when(k % 2 == 0, "legacy_catalog").otherwise("none").alias("source"))
    return sites.select("id", text.site_tier("node", "lat", "lat", "filing", "confidence", "notes", "source").alias("tier"))


@query("WITH p AS (SELECT p_partkey AS k, p_size AS z, (SELECT max(p_size) FROM part) AS top FROM part), l AS (SELECT *, CASE WHEN z * 300 >= 1000 THEN concat(regexp_replace(printf('%.1f', z * 0.3), '\\.0$', ''), 'G') ELSE concat(z * 300, 'M') END AS one FROM p), c AS (SELECT *, (k * 137.508) % 360 AS h, 0.6 + 0.08 * (k % 3 - 1) AS li FROM l) SELECT k AS p_partkey, one AS speed, CASE WHEN k % 3 = 0 THEN one WHEN k % 3 = 1 THEN concat('2 × ', one) ELSE concat(one, ' + 10G') END AS ports, floor((2 + 5 * sqrt(z / top::DOUBLE)) * 1000 + 0.5) / 1000 AS radius, " + ", ".join(f"floor(255 * (li - 0.72 * least(li, 1 - li) * greatest(-1.0, least(({n} + h / 30) % 12 - 3, 9 - ({n} + h / 30) % 12, 1.0))) + 0.5)::INT AS {c}" for n, c in ((0, "red"), (8, "green"), (4, "blue"))) + " FROM c")
def fn_labels(s, d):
    """Speeds and ports in words, a marker's radius by its area, colours a golden angle apart."""
    p = table(s, d, "part").select("p_partkey", F.col("p_size").alias("z"))
    top = F.broadcast(p.agg(F.max("z").alias("top")))
    mbps = (F.col("z") * 300).cast("double")
    k = F.col("p_partkey")
    speeds = F.when(k % 3 == 0, F.array(mbps)).when(k % 3 == 1, F.array(mbps, mbps)).otherwise(F.array(mbps, F.lit(10_000.0)))
    rgb = text.golden_colour("p_partkey")
    return p.crossJoin(top).select("p_partkey", text.speed_label(mbps).alias("speed"), text.ports_label(speeds).alias("ports"), fixed(text.marker_radius("z", "top", 2, 7), 3).alias("radius"), *[c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"), strict=True)])


_NAMES = ("texImage2D", "bufferData", "uniform4fv", "drawArrays", "enable")


@query("WITH n AS (SELECT event_id, ['texImage2D', 'bufferData', 'uniform4fv', 'drawArrays', 'enable'][event_id % 5 + 1] AS name, event_id % 7 AS args, CASE WHEN event_id % 5 < 2 THEN event_id % 1000 ELSE -1 END AS payload, CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 3 WHEN event_id % 4 = 2 THEN 2 ELSE 1 END AS times FROM events), c AS (SELECT CASE WHEN name IN ('texImage2D') THEN 'texture' WHEN name = 'bufferData' THEN 'buffer' WHEN name = 'uniform4fv' THEN 'uniform' WHEN name = 'drawArrays' THEN 'draw' ELSE 'state' END AS family, times, 16 + len(name) + 8 * args + CASE WHEN payload >= 0 THEN 8 + payload ELSE 0 END AS bytes FROM n) SELECT family, sum(times)::BIGINT AS calls, sum(times * bytes)::BIGINT AS bytes FROM c GROUP BY 1")
def fn_call_cost(s, d):
    """Calls and their rough wire bytes by family; a wire message is a call, a list of calls, or a batch of them."""
    k = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (k % 5 + 1).cast("int"))
    args = F.concat_ws(",", F.array_repeat(F.lit("1"), (k % 7).cast("int")), F.when(k % 5 < 2, F.concat(F.lit('{"bytes":'), k % 1000, F.lit("}"))))
    call = F.concat(F.lit('{"name":"'), name, F.lit('","args":['), args, F.lit("]}"))
    wire = F.when(k % 4 == 0, F.concat(F.lit('{"batch":['), call, F.lit(","), call, F.lit("]}"))).when(k % 4 == 1, F.concat(F.lit("["), call, F.lit(","), call, F.lit(","), call, F.lit("]"))).when(k % 4 == 2, F.concat(F.lit('{"calls":['), call, F.lit(","), call, F.lit("]}"))).otherwise(call)
    calls = table(s, d, "events").select(wire.alias("wire")).select(F.explode(text.wire_calls("wire")).alias("c"))
    g = calls.select(text.call_family("c.name").alias("family"), text.call_bytes("c.name", "c.args").alias("b"))
    return g.groupBy("family").agg(F.count("*").alias("calls"), F.sum("b").alias("bytes"))


@query("WITH e AS (SELECT event_id, ['onmessage handler', 'FrameRequestCallback', 'TimerHandler:setTimeout', 'pointerdown', 'x', 'Window.onclick'][event_id % 6 + 1] AS i FROM events) SELECT CASE event_id % 6 WHEN 0 THEN 'messages' WHEN 1 THEN 'animationFrame' WHEN 2 THEN 'timers' WHEN 3 THEN 'input' WHEN 4 THEN 'promises' ELSE 'other' END AS kind, count(*) AS n FROM e GROUP BY 1")
def fn_invoker_kind(s, d):
    """Who ran a long frame's script, by the words of its invoker."""
    names = ("onmessage handler", "FrameRequestCallback", "TimerHandler:setTimeout", "pointerdown", "x", "Window.onclick")
    e = table(s, d, "events").select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 6 + 1).cast("int")).alias("i"), F.when(F.col("event_id") % 6 == 4, "resolve-promise").otherwise("user").alias("t"))
    return e.groupBy(text.invoker_kind("i", "t").alias("kind")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT id, name FROM airports) SELECT id, coalesce(nullif(trim(regexp_replace(CASE WHEN id % 3 = 0 THEN concat(name, ' Gateway Site') WHEN id % 3 = 1 THEN name ELSE 'Gateway Site' END, '\\s*Gateway Site$', '')), ''), id::VARCHAR) AS short FROM a")
def fn_site_name(s, d):
    """A site's name without its suffix; its id where nothing is left."""
    a = table(s, d, "airports").select("id", "name").distinct()
    full = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(" Gateway Site"))).when(F.col("id") % 3 == 1, F.col("name")).otherwise("Gateway Site")
    return a.select("id", text.site_name(full, F.col("id").cast("string")).alias("short"))


@query("WITH g AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, min(n) OVER w AS lo, max(n) OVER w AS hi, count(*) OVER w AS c FROM g WINDOW w AS (PARTITION BY event_type)) SELECT event_type, string_agg(concat(CASE WHEN i = 0 THEN 'M' ELSE 'L' END, printf('%.1f', floor((1 + i * 118 / (c - 1)::DOUBLE) * 10 + 0.5) / 10), ' ', printf('%.1f', floor((30 - 1 - (n - lo) * 28 / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END)::DOUBLE) * 10 + 0.5) / 10)), '' ORDER BY i) AS path FROM r WHERE c >= 2 GROUP BY 1")
def fn_spark_path(s, d):
    """The line of a small chart of each day's events, scaled between its least and most."""
    g = table(s, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    series = g.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("v"))  # one value a day
    return series.where(F.size("v") >= 2).select("event_type", text.spark_path("v", 120, 30).alias("path"))


@query("WITH z AS (SELECT p_partkey, (p_size % 8)::DOUBLE AS zoom, p_partkey % 2 = 0 AS glow FROM part) SELECT p_partkey, floor(least(1.0, CASE WHEN glow THEN 0.0025 ELSE 0.007 END * pow(0.5 / 0.35, 2) * pow(2, zoom)) * 1000000.0 + 0.5) / 1000000.0 AS links, floor(least(0.9, 0.1 * pow(2, zoom - 1) * CASE WHEN glow THEN 1 ELSE 2.5 END) * 1000000.0 + 0.5) / 1000000.0 AS nodes, floor((0.25 + 0.5 * 2.2) * least(1.6, 0.45 + 0.13 * zoom) * 1000000.0 + 0.5) / 1000000.0 AS size FROM z")
def fn_opacity(s, d):
    """Opacity of links and nodes and the nodes' scale by zoom."""
    z, glow = (F.col("p_size") % 8).cast("double"), F.col("p_partkey") % 2 == 0
    links, nodes, size = text.zoom_looks(z, glow, 0.5, 0.5)
    return table(s, d, "part").select("p_partkey", fixed(links).alias("links"), fixed(nodes).alias("nodes"), fixed(size).alias("size"))


@query("WITH a AS (SELECT DISTINCT data.peer_asn AS asn FROM ris_frames) SELECT asn, CASE WHEN regexp_full_match(trim(asn), '\\d{1,10}') THEN concat('#sel=', trim(asn)) END AS link, CASE WHEN len(asn) % 2 = 0 THEN 'app_id,mode' ELSE '' END AS missing FROM a")
def fn_asn_link(s, d):
    """The link that selects a network, for numbers only; the dimensions that an error names as not registered."""
    r = table(s, d, "ris_frames").select(F.col("data.peer_asn").alias("asn")).distinct()
    message = F.when(F.length("asn") % 2 == 0, F.lit("Field customEvent:mode, customEvent:app_id, customEvent:mode is not a valid dimension")).otherwise("quota: customEvent:mode")
    missing = F.array_join(F.array_sort(text.missing_dimensions(message)), ",")
    return r.select("asn", text.number_link("asn").alias("link"), missing.alias("missing"))


_INFRA = (("203.0.113.0", 24), ("198.51.100.0", 24))
_INFRA6 = "20010DB8FFFF"  # 2001:db8:ffff::/48


@query("SELECT rec_id, string_split(dst_addr, '.')[1:3] IN (['203', '0', '113'], ['198', '51', '100']) OR starts_with(lower(dst_addr), '2001:db8:ffff:') AS own FROM pings WHERE regexp_matches(dst_addr, '^\\d{1,3}(\\.\\d{1,3}){3}$') OR dst_addr LIKE '%:%'")
def x_infra(s, d):
    """Whether an address of either family is in the operator's own blocks."""
    p = table(s, d, "pings").where("dst_addr IS NOT NULL").select("rec_id", "dst_addr", net.ipv4_number("dst_addr").alias("n"), F.when(F.contains("dst_addr", F.lit(":")), net.address_bytes("dst_addr")).alias("six"))
    own = F.coalesce(net.in_blocks("n", _INFRA), F.substring("six", 1, 6) == F.unhex(F.lit(_INFRA6)))
    return p.where("n IS NOT NULL OR six IS NOT NULL").select("rec_id", own.alias("own"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{key}' AS list, props->>'k' AS item, count(*) AS n, count(DISTINCT user_id) AS users, row_number() OVER (ORDER BY count(*) DESC, props->>'k') AS place FROM events WHERE event_type = '{event}' GROUP BY 2) WHERE place <= {most}" for key, event, most in (("selected", "view", 20), ("apps", "click", 10), ("datasets", "purchase", 50), ("modes", "signup", 50))))
def x_top_lists(s, d):
    """The dashboard's lists: each an event, a parameter and a length."""
    specs = F.broadcast(s.createDataFrame([("selected", "view", 20), ("apps", "click", 10), ("datasets", "purchase", 50), ("modes", "signup", 50)], "list string, event_type string, most int"))
    e = table(s, d, "events").join(specs, "event_type").groupBy("list", "most", F.get_json_object("props", "$.k").alias("item")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("n"), "item"))
    return e.withColumn("place", place).where("place <= most").select("list", "item", "n", "users", "place")
