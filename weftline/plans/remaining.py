"""Queries over connectors and the smaller operators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftline.functions import geo, net, text
from weftline.functions.geo import fixed
from weftline.operators import raster
from weftline.plans import fixtures as fx
from weftline.plans.fixtures import with_sql
from weftline.plans.relational import _merc_links
from weftline.plans.tables import table
from weftline.session import staged_path
from weftline.sources import connectors, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_sql(uses, sql) if uses else sql
        return f

    return add


def _files(s, folder: str, ending: str = "") -> list[str]:
    fs = s._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(s._jsc.hadoopConfiguration())
    names = [x.getPath().toString() for x in fs.listStatus(s._jvm.org.apache.hadoop.fs.Path(folder))]
    return sorted(n.replace("file:/", "file:///") if n.startswith("file:/") and not n.startswith("file:///") else n for n in names if n.rpartition("/")[2].startswith("part-") and n.endswith(ending))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def src_atlas_rest(s, d):
    """Records asked for in batches of the ids that are wanted, each page read by its own task."""
    connectors.register(s)
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    urls = []
    wanted = [r["id"] for r in n.select("id").distinct().orderBy("id").collect()]  # what a request names, as in the source's own API
    for k, ids in enumerate(connectors.id_batches(wanted, 10)):
        out = staged_path(s, f"page{k}")
        part = n.where(F.col("id").isin(*map(int, ids.split(","))))
        part.agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name")).alias("results"))).alias("value")).coalesce(1).write.text(out)
        urls += _files(s, out, ".txt")
    return s.read.format("paged_json").schema("id long, name string").options(urls=json.dumps(urls), records="results").load()


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def src_ripestat(s, d):
    """An answer with status and data, its records at a path."""
    connectors.register(s)
    r = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    out = staged_path(s, "answer")
    r.agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.struct(F.collect_list(F.struct("key", "name")).alias("rows")).alias("data"))).alias("value")).coalesce(1).write.text(out)
    return s.read.format("paged_json").schema("key long, name string").options(urls=json.dumps(_files(s, out, ".txt")), records="data.rows").load()


@query("SELECT count(*) AS frames FROM ris_frames")
def src_ris_live(s, d):
    """A feed's frames as a stream."""
    connectors.register(s)
    out, sink = staged_path(s, "frames"), staged_path(s, "frames-out")
    table(s, d, "ris_frames").orderBy("delivery_id").select(F.to_json(F.struct("delivery_id", "frame_type")).alias("value")).coalesce(1).write.text(out)
    stream = s.readStream.format("frame_feed").options(url=_files(s, out, ".txt")[0], rangeBytes="65536").load()
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", staged_path(s, "frames-progress")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return s.read.schema("number long, frame string").parquet(sink).agg(F.count("*").alias("frames"))


@query("SELECT max(concat('pops-', snap, '.csv')) AS newest, count(*) AS lines FROM pops WHERE snap = (SELECT max(snap) FROM pops)")
def src_cache(s, d):
    """The newest day's file of a listing, kept for later readers: it is fetched once however often it is asked for."""
    p = table(s, d, "pops").select("snap", F.col("line_no").cast("string").alias("value"))
    names = [f"pops-{r['snap']}.csv" for r in p.select("snap").distinct().collect()] + ["other-29990101.csv"]  # a listing: one name for each delivery
    newest = connectors.newest_day(names, "pops-")
    out = staged_path(s, "cached")
    p.where(F.col("snap") == newest.removeprefix("pops-").removesuffix(".csv")).coalesce(1).select("value").write.text(out)
    cache, asked = connectors.AnswerCache(1800), []
    url = _files(s, out, ".txt")[0]
    for _ in range(3):
        body = cache.get(url, lambda u: asked.append(u) or connectors.fetch(u))
    if len(asked) != 1:
        raise RuntimeError("the answer was not kept")
    return s.createDataFrame([(newest, len(body.splitlines()))], "newest string, lines long")


# --- sinks -----------------------------------------------------------------------


@query("SELECT start, asn FROM fx_prefix", "fx_prefix")
def snk_ip2asn(s, d):
    out = staged_path(s, "boundaries")
    p = fx.prefixes(s, d).select("start", "asn")
    sinks.write_lookup(p, out, "start")
    return s.read.schema(p.schema).parquet(out)


@query()
def snk_feed_documents(s, d):
    """Two documents of the feed and the digest of each file."""
    out = staged_path(s, "documents")
    p = table(s, d, "pops")
    sinks.write_json_records(p.groupBy(F.lower(F.trim("c1")).alias("pop")).agg(F.count_distinct("c0").alias("prefixes")), f"{out}/pops")
    sinks.write_json_records(table(s, d, "regions").select("id", "country", "region", "city").distinct(), f"{out}/regions")
    files = sinks.digests(s, out).where(F.contains("path", F.lit("/part-")))
    return files.groupBy(F.regexp_extract("path", r"/(pops|regions)/", 1).alias("document")).agg(F.sum("bytes").alias("bytes"), F.count_distinct("sha256").alias("digests"))


@query()
def snk_tile_server(s, d):
    """One tile on demand: only the links whose box touches it are drawn."""
    e = _merc_links(s, d).withColumn("r", F.lit(1.0)).withColumn("g", F.lit(1.0)).withColumn("b", F.lit(1.0))
    z, x, y = 2, 1, 1
    lo = lambda v: v / (1 << z)
    near = (F.greatest("ax", "bx") >= lo(x)) & (F.least("ax", "bx") < lo(x + 1)) & (F.greatest("ay", "by") >= lo(y)) & (F.least("ay", "by") < lo(y + 1))
    return raster.render_tiles(e.where(near), [z], 64).where((F.col("x") == x) & (F.col("y") == y)).select("z", "x", "y", "lit")


# --- scalars ----------------------------------------------------------------------


@query("SELECT id, elevation_ft::VARCHAR AS elevation, iso_country AS country FROM airports WHERE elevation_ft IS NOT NULL")
def fn_legacy_facts(s, d):
    a = table(s, d, "airports").where("elevation_ft IS NOT NULL")
    f = text.facts(F.concat(F.lit("note: elevation="), "elevation_ft", F.lit("; country="), "iso_country", F.lit(" end")))
    return a.select("id", f.alias("f")).select("id", F.col("f")["elevation"].alias("elevation"), F.col("f")["country"].alias("country"))


@query("SELECT s_suppkey, 2015 + (s_suppkey % 12)::INT AS year, (s_suppkey % 150)::INT AS launch, (2015 + s_suppkey % 12, s_suppkey % 150) >= (2021, 82) AS laser FROM supplier")
def fn_designator(s, d):
    """Year and launch of an international designator; later launches have lasers."""
    sup = table(s, d, "supplier")
    t = sup.select("s_suppkey", F.format_string("%d-%03d%s", 2015 + F.col("s_suppkey") % 12, F.col("s_suppkey") % 150, F.lit("AB")).alias("t"))
    year, launch = F.regexp_extract("t", r"^(\d{4})-(\d{3})[A-Z]+$", 1).try_cast("int"), F.regexp_extract("t", r"^(\d{4})-(\d{3})[A-Z]+$", 2).try_cast("int")
    return t.select("s_suppkey", year.alias("year"), launch.alias("launch"), ((year > 2021) | ((year == 2021) & (launch >= 82))).alias("laser"))


_INFRA = (("203.0.113.0", 24), ("198.51.100.0", 24))


@query("SELECT node, floor(cos(radians(lat)) * cos(radians(lon)) * 1000000.0 + 0.5) / 1000000.0 AS up_x, floor(sin(radians(lat)) * 1000000.0 + 0.5) / 1000000.0 AS up_z FROM fx_node_pos", "fx_node_pos")
def x_site(s, d):
    """A ground site: its place and its vertical."""
    up = geo.unit_vector("lat", "lon")
    return fx.node_positions(s, d).select("node", fixed(up[0]).alias("up_x"), fixed(up[2]).alias("up_z"))


@query()
def x_teme_globe(s, d):
    """Satellites' ground points in the earth-fixed frame at an instant."""
    from weftline.operators.orbit import sidereal_angle
    from weftline.plans.worlds import _states

    g = float(sidereal_angle(2461000.5))
    c, k = F.cos(F.lit(g)), F.sin(F.lit(g))
    st = _states(s, d).select("sat", (F.col("x") * c + F.col("y") * k).alias("x"), (F.col("y") * c - F.col("x") * k).alias("y"), "z")
    lat, lon, alt = geo.geodetic("x", "y", "z")
    return st.select("sat", fixed(lat, 3).alias("lat"), fixed(lon, 3).alias("lon"), fixed(alt, 1).alias("alt_km"))


@query("SELECT 2 AS version, count(*) AS links FROM fx_edges WHERE rel = 0", "fx_edges")
def x_backbone_pubsub(s, d):
    """The last value published wins: the table is overwritten whole."""
    out = staged_path(s, "published")
    for version, rel in ((1, -1), (2, 0)):
        fx.edges(s, d).where(F.col("rel") == rel).agg(F.lit(version).alias("version"), F.count("*").alias("links")).write.mode("overwrite").parquet(out)
    return s.read.parquet(out)


@query("SELECT r_regionkey, coalesce((SELECT min(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20), (SELECT min(n_nationkey) FROM nation)) AS step FROM region")
def x_incident_nav(s, d):
    """The step asked for, else the default."""
    n = table(s, d, "nation")
    hit = n.where("n_nationkey > 20").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("hit"))
    default = F.broadcast(n.agg(F.min("n_nationkey").alias("first")))
    r = table(s, d, "region")
    return r.join(hit, r.r_regionkey == hit.n_regionkey, "left").crossJoin(default).select("r_regionkey", F.coalesce("hit", "first").alias("step"))
