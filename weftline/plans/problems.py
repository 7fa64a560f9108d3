"""The pN_ queries of the general problems: nested records, nearby points, snapshots, late events, redelivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.late import corrected_aggregates, fates, first_copies
from weftline.operators.nested import Field, Table, flat_table, flat_tables
from weftline.operators.redelivery import surplus
from weftline.operators.snapshots import snapshot_changes, with_canonical_prefix
from weftline.operators.spatial import containing_regions, near_pairs, nearest
from weftline.plans.fixtures import with_sql
from weftline.plans.tables import table

SAME = ["msm_id", "prb_id"]


def trace_replies(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "traceroutes")
    fields = [Field("hop", "[].hop", "int"), Field("from_addr", "[].result[].from"), Field("rtt", "[].result[].rtt", "double")]
    return flat_table(t, ["rec_id"], "result", "[].result[]", fields, ["hop_pos", "reply_pos"], wrapper="result")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    r = trace_replies(spark, folder)
    return r.where((F.col("from_addr") != "") & (F.col("rtt") >= 0)).select("rec_id", "hop_pos", "reply_pos", "hop")


def p1_hops(spark: SparkSession, folder: str) -> DataFrame:
    """The table of hops: each with its record, its place in the list, its number and its error."""
    t = table(spark, folder, "traceroutes")
    fields = [Field("hop", "[].hop", "int"), Field("error", "[].error")]
    return flat_table(t, ["rec_id"], "result", "[]", fields, ["hop_pos"], wrapper="result")


def p1_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Hops and replies from one pass over the records, each row with its table's name; a reply links to its hop by record and ``hop_pos``."""
    hops = Table("hops", "[]", (Field("hop", "[].hop", "int"), Field("error", "[].error")), ("hop_pos",))
    replies = Table("replies", "[].result[]", (Field("from_addr", "[].result[].from"), Field("rtt", "[].result[].rtt", "double")), ("hop_pos", "reply_pos"))
    return flat_tables(table(spark, folder, "traceroutes"), ["rec_id"], "result", [hops, replies], wrapper="result")


def _locations(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("geometry.coordinates")
    probes = table(spark, folder, "probes").where(F.size(at) >= 2).select(F.lit("probe").alias("kind"), "id", F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"))
    regions = table(spark, folder, "regions").select(F.lit("region").alias("kind"), "id", "lat", "lon")
    return probes.unionByName(regions).where(~((F.col("lat") == 0) & (F.col("lon") == 0)))


def _airport_pairs(spark: SparkSession, folder: str, km: float) -> DataFrame:
    airports = table(spark, folder, "airports").select("id", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    return near_pairs(_locations(spark, folder), airports, {"kind": "kind", "id": "loc_id"}, {"id": "airport_id"}, km)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _airport_pairs(spark, folder, 50.0).select("kind", "loc_id", "airport_id").distinct()


def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest airport of each location within 400 km."""
    pairs = _airport_pairs(spark, folder, 400.0).groupBy("kind", "loc_id", "airport_id").agg(F.min("km").alias("km"))
    return nearest(pairs, ["kind", "loc_id"], ["airport_id"]).select("kind", "loc_id", "airport_id", (F.floor(F.col("km") * 1000 + 0.5) / 1000).alias("km"))


def p2_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zone that contains each location: a frame around the airports of a country, as a ring, within two degrees of them."""
    a = table(spark, folder, "airports").where("latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL AND iso_country IS NOT NULL")
    box = a.groupBy(F.col("iso_country").alias("zone")).agg((F.min("latitude_deg") - 2).alias("s"), (F.max("latitude_deg") + 2).alias("n"), (F.min("longitude_deg") - 2).alias("w"), (F.max("longitude_deg") + 2).alias("e"))
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    rings = box.select("zone", F.array(corner("s", "w"), corner("s", "e"), corner("n", "e"), corner("n", "w")).alias("ring"))
    return containing_regions(_locations(spark, folder), rings, {"kind": "kind", "id": "loc_id"}, {"zone": "zone"}).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pops = table(spark, folder, "pops").select("snap", "line_no", "c0", "c1", "c2")
    clean = with_canonical_prefix(pops, "c0", "key")
    value = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    rows = clean.select("snap", "line_no", F.col("key").alias("c0"), value("c1").alias("c1"), value("c2").alias("c2"))
    return snapshot_changes(rows, "snap", "c0", ["c1", "c2"], "line_no")


def _measurements(spark: SparkSession, folder: str, stream: str, carry: list[str] = ()) -> DataFrame:
    return first_copies(table(spark, folder, stream), SAME, "timestamp", "stored_timestamp", "rec_id", carry)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """A period is held open for a probe that lags, but no longer than the ten minutes of the statement, which the exact check then applies."""
    parts = [fates(_measurements(spark, folder, s), "prb_id", hold=600, grace=600).select(F.lit(s).alias("stream"), F.col("rec").alias("rec_id"), "fate") for s in ("pings", "traceroutes")]
    return parts[0].unionByName(parts[1])


def p6_diverted(spark: SparkSession, folder: str) -> DataFrame:
    """What the probes' watermarks alone divert, by hour: a period stays open until every probe has passed its end or is idle."""
    d = fates(_measurements(spark, folder, "traceroutes"), "prb_id")
    return d.groupBy("start", "fate").agg(F.max("close").alias("close"), F.count("*").alias("records"), F.min("arrival_s").alias("first_arrival"))


def p6_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly aggregates of rcvd in pings, at their closes and as they stand after all corrections up to the cut-off; a probe holds an hour open for half an hour at most."""
    return corrected_aggregates(_measurements(spark, folder, "pings", ["rcvd"]), "prb_id", "rcvd", hold=1800)


def p6_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly aggregates of traceroutes kept by a stream over the records as they were stored, every copy counted; late ones correct them."""
    from weftline.operators.late import seconds
    from weftline.streaming import late
    from weftline.streaming.feed import table_stream

    t = table_stream(spark, folder, "traceroutes").select(seconds("timestamp").alias("event_s"), seconds("stored_timestamp").alias("arrival_s"), "prb_id", "paris_id")
    whole = [F.col(c).cast("long").alias(c) for c in ("total_at_close", "total")]
    return late.run(t, "prb_id", "paris_id").select("start", "close", "n_on_time", "n_late", "n_cut", *whole)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    ris = table(spark, folder, "ris_frames")
    return surplus(ris, "delivery_id", F.col("data.id"), F.col("data.peer"), F.round(F.col("data.timestamp") * 1000))


QUERIES = {f.__name__: f for f in (p1_found, p1_hops, p1_tables, p2_found, p2_nearest, p2_zones, p5_found, p6_found, p6_diverted, p6_hourly, p6_stream, p7_found)}

_POSITIONS = """
locs AS (
  SELECT 'probe' AS kind, id, geometry.coordinates[2] AS lat, geometry.coordinates[1] AS lon FROM probes WHERE len(geometry.coordinates) >= 2
  UNION ALL SELECT 'region', id, lat, lon FROM regions),
good AS (SELECT DISTINCT * FROM locs WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)),
apts AS (SELECT DISTINCT id AS airport_id, latitude_deg AS alat, longitude_deg AS alon FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL),
dist AS (
  SELECT kind, id AS loc_id, airport_id,
    2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(alat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(alat)) * pow(sin(radians(alon - lon) / 2), 2)))) AS km
  FROM good, apts)"""
_HOPS = """
texts AS (SELECT rec_id, result::JSON AS j FROM traceroutes WHERE json_valid(result)),
once AS (SELECT rec_id, CASE WHEN json_type(j) <> 'VARCHAR' THEN j WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END AS j FROM texts),
bare AS (SELECT rec_id, CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1 AND json_type(j, '$.result') = 'ARRAY' AND len(list_filter(json_extract(j, '$.result[*]'), lambda x: json_exists(x, '$.result'))) > 0 THEN j->'$.result' ELSE j END AS j FROM once),
lists AS (SELECT rec_id, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN [j] ELSE [] END AS l FROM bare),
hops AS (SELECT rec_id, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS hop_pos FROM lists),
numbered AS (SELECT rec_id, hop_pos, CASE WHEN json_type(h, '$.hop') IN ('UBIGINT', 'BIGINT', 'VARCHAR') THEN TRY_CAST(h->>'$.hop' AS INTEGER) END AS hop, h->>'$.error' AS error,
  CASE json_type(h, '$.result') WHEN 'ARRAY' THEN json_extract(h, '$.result[*]') WHEN 'OBJECT' THEN [h->'$.result'] ELSE [] END AS l FROM hops WHERE json_type(h) <> 'NULL'),
spread AS (SELECT rec_id, hop_pos, hop, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS reply_pos FROM numbered),
replies AS (SELECT rec_id, hop_pos, reply_pos, hop, r->>'$.from' AS from_addr, CASE WHEN json_type(r, '$.rtt') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') AND regexp_full_match(r->>'$.rtt', '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN TRY_CAST(r->>'$.rtt' AS DOUBLE) END AS rtt FROM spread WHERE json_type(r) <> 'NULL')"""
_SECONDS = "CASE WHEN abs({0}) >= 100000000000000000 THEN {0} // 1000000000 WHEN abs({0}) >= 100000000000000 THEN {0} // 1000000 WHEN abs({0}) >= 100000000000 THEN {0} // 1000 ELSE {0} END"


def _first_sql(stream: str, carry: str = "") -> str:
    e, a = _SECONDS.format("timestamp"), _SECONDS.format("stored_timestamp")
    return f"SELECT * FROM (SELECT rec_id{carry}, {e} AS e, {a} AS a, row_number() OVER (PARTITION BY msm_id, prb_id, {e} ORDER BY {a}, rec_id) AS k FROM {stream} WHERE stored_timestamp IS NOT NULL AND timestamp IS NOT NULL) WHERE k = 1"


def _closes_sql(hold: int | None = None, idle: int = 300) -> str:
    """CTEs from f (src, e, a): ``timed`` has f with the start and the close of each row's hour."""
    bound = f", \"end\" + {hold}" if hold else ""
    return f"""
marks AS (SELECT src, (floor(e / 3600) * 3600)::BIGINT AS "end", min(a) FILTER (e <= a) AS shown FROM f WHERE src IS NOT NULL GROUP BY ALL),
ticks AS (SELECT DISTINCT src, (floor(a / 60) * 60)::BIGINT AS tick FROM f WHERE src IS NOT NULL),
fresh AS (SELECT *, CASE WHEN tick < lag(tick) OVER (PARTITION BY src ORDER BY tick) + 60 + {idle} THEN 0 ELSE 1 END AS fresh FROM ticks),
runs AS (SELECT src, tick, sum(fresh) OVER (PARTITION BY src ORDER BY tick) AS run FROM fresh),
islands AS (SELECT src, min(tick) AS since, max(tick) + 60 + {idle} AS idle_from FROM runs GROUP BY src, run),
asks AS (SELECT src, unnest(range((floor(since / 3600)::BIGINT + 1) * 3600, idle_from, 3600)) AS "end", idle_from FROM islands),
released AS (SELECT "end", least(idle_from{bound}, (SELECT min(m.shown) FROM marks m WHERE m.src = asks.src AND m."end" >= asks."end")) AS r FROM asks),
closes AS (SELECT "end" - 3600 AS start, max((ceil(r / 60) * 60)::BIGINT) AS close FROM released GROUP BY 1),
begun AS (SELECT *, (floor(e / 3600) * 3600)::BIGINT AS start FROM f),
timed AS (SELECT begun.*, coalesce(close, begun.start + 3600) AS close FROM begun LEFT JOIN closes ON closes.start = begun.start)"""


SQL = {
    "p5_found": with_sql("fx_canon", "WITH held AS (SELECT snap, text AS c0, nullif(lower(trim(c1)), '') AS c1, nullif(lower(trim(c2)), '') AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY snap, text ORDER BY line_no NULLS LAST) AS k FROM fx_canon WHERE snap IS NOT NULL) WHERE k = 1), snaps AS (SELECT snap, row_number() OVER (ORDER BY snap) AS at_ FROM (SELECT DISTINCT snap FROM held)), m AS (SELECT held.*, at_ FROM held JOIN snaps USING (snap)), ch AS (SELECT coalesce(y.at_, x.at_ + 1) AS at_, coalesce(y.c0, x.c0) AS c0, CASE WHEN x.c0 IS NULL THEN 'added' WHEN y.c0 IS NULL THEN 'removed' WHEN x.c1 IS DISTINCT FROM y.c1 OR x.c2 IS DISTINCT FROM y.c2 THEN 'changed' END AS change FROM m x FULL JOIN m y ON y.at_ = x.at_ + 1 AND y.c0 = x.c0) SELECT snap, c0, change FROM ch JOIN snaps USING (at_) WHERE change IS NOT NULL AND at_ > 1"),
    "p1_found": f"WITH {_HOPS} SELECT rec_id, hop_pos::INT AS hop_pos, reply_pos::INT AS reply_pos, hop FROM replies WHERE from_addr <> '' AND rtt >= 0",
    "p1_hops": f"WITH {_HOPS} SELECT rec_id, hop_pos::INT AS hop_pos, hop, error FROM numbered",
    "p1_tables": f"WITH {_HOPS} SELECT 'hops' AS \"table\", rec_id, hop_pos::INT AS hop_pos, NULL::INT AS reply_pos, hop, error, NULL::VARCHAR AS from_addr, NULL::DOUBLE AS rtt FROM numbered UNION ALL SELECT 'replies', rec_id, hop_pos::INT, reply_pos::INT, NULL, NULL, from_addr, rtt FROM replies",
    "p2_found": f"WITH {_POSITIONS} SELECT DISTINCT kind, loc_id, airport_id FROM dist WHERE km <= 50.0",
    "p2_nearest": f"WITH {_POSITIONS} SELECT kind, loc_id, airport_id, floor(km * 1000 + 0.5) / 1000 AS km FROM (SELECT *, row_number() OVER (PARTITION BY kind, loc_id ORDER BY km, airport_id) AS k FROM dist WHERE km <= 400.0) WHERE k = 1",
    "p2_zones": f"WITH {_POSITIONS}, box AS (SELECT iso_country AS zone, min(latitude_deg) - 2 AS s, max(latitude_deg) + 2 AS n, min(longitude_deg) - 2 AS w, max(longitude_deg) + 2 AS e FROM airports WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL AND iso_country IS NOT NULL GROUP BY 1), pl AS (SELECT kind, id, lat, (lon + 540) - floor((lon + 540) / 360) * 360 - 180 AS lon FROM good), sh AS (SELECT kind, id, lat, lon + s AS lon FROM pl, (SELECT unnest([-360, 0, 360]) AS s)) SELECT DISTINCT kind, id AS loc_id, zone FROM sh JOIN box ON lat >= s AND lat < n AND lon >= w AND lon < e",
    "p6_found": "WITH f AS (" + " UNION ALL ".join(f"SELECT '{s}' AS stream, rec_id, a - (floor(e / 3600)::BIGINT * 3600 + 3600) AS behind FROM ({_first_sql(s)})" for s in ("pings", "traceroutes")) + ") SELECT stream, rec_id, CASE WHEN behind <= 21600 THEN 'late' ELSE 'cut' END AS fate FROM f WHERE behind > 600",
    "p6_diverted": f"WITH f AS (SELECT prb_id AS src, e, a FROM ({_first_sql('traceroutes', ', prb_id')})), {_closes_sql()}, d AS (SELECT start, close, a, a - (start + 3600) AS behind FROM timed WHERE a >= close) SELECT start, CASE WHEN behind <= 21600 THEN 'late' ELSE 'cut' END AS fate, max(close) AS close, count(*) AS records, min(a) AS first_arrival FROM d GROUP BY ALL",
    "p6_hourly": f"WITH f AS (SELECT prb_id AS src, e, a, rcvd FROM ({_first_sql('pings', ', prb_id, rcvd')})), {_closes_sql(1800)}, b AS (SELECT *, a < close AS ot, a < close OR a - (start + 3600) <= 21600 AS kept FROM timed) SELECT start, max(close) AS close, count(*) FILTER (ot) AS n_on_time, count(*) FILTER (kept AND NOT ot) AS n_late, count(*) FILTER (NOT kept) AS n_cut, (sum(rcvd) FILTER (ot))::BIGINT AS total_at_close, (sum(rcvd) FILTER (kept))::BIGINT AS total, min(rcvd) FILTER (kept) AS least, max(rcvd) FILTER (kept) AS most FROM b GROUP BY start",
    "p6_stream": f"WITH f AS (SELECT prb_id AS src, {_SECONDS.format('timestamp')} AS e, {_SECONDS.format('stored_timestamp')} AS a, paris_id FROM traceroutes WHERE timestamp IS NOT NULL AND stored_timestamp IS NOT NULL), {_closes_sql()}, b AS (SELECT *, a < close AS ot, a < close OR a - (start + 3600) <= 21600 AS kept FROM timed) SELECT start, max(close) AS close, count(*) FILTER (ot) AS n_on_time, count(*) FILTER (kept AND NOT ot) AS n_late, count(*) FILTER (NOT kept) AS n_cut, (sum(paris_id) FILTER (ot))::BIGINT AS total_at_close, (sum(paris_id) FILTER (kept))::BIGINT AS total FROM b GROUP BY start",
    "p7_found": "WITH r AS (SELECT delivery_id, lower(trim(data.id)) AS i, lower(trim(data.peer)) AS p, round(data.timestamp * 1000)::BIGINT AS t FROM ris_frames WHERE data.id IS NOT NULL) SELECT DISTINCT a.delivery_id FROM r a JOIN r b ON a.i = b.i AND a.p IS NOT DISTINCT FROM b.p AND b.delivery_id < a.delivery_id AND (abs(a.t - b.t) <= 1000 OR (a.t IS NULL AND b.t IS NULL))",
}
