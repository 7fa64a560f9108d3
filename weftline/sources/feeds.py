"""Readers of the text feeds. Each parser takes numbered lines (``line``, ``value``), so a file, a table of lines and a stream read alike.

Malformed lines are left out; :func:`bad_lines` counts them. Where several lines speak of one thing, the first holds unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.net import cidr, cidr4
from weftline.operators.ranking import dense_codes, first_per_group


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, plain, gz or bz2: ``line`` orders as the file does, however it is split."""
    t = spark.read.text(path)
    return t.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line"), "value")


def _parts(sep: str) -> Column:
    return F.split("value", sep)


def _at(p: str | Column, k: int) -> Column:
    return F.trim(F.get(p, F.lit(k)))


def bad_lines(lines: DataFrame, good: DataFrame) -> DataFrame:
    """One row: how many lines that aren't blank or comments gave nothing."""
    said = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).agg(F.count("*").alias("n"))
    return said.crossJoin(good.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("bad"))


def prefix_ranges(lines: DataFrame) -> DataFrame:
    """(start, end, asn, name, line) of 'start,end,asn,org' lines with three whole numbers."""
    p = lines.withColumn("p", _parts(","))
    return p.select(_at("p", 0).try_cast("long").alias("start"), _at("p", 1).try_cast("long").alias("end"), _at("p", 2).try_cast("long").alias("asn"), _at("p", 3).alias("name"), "line").where("start IS NOT NULL AND end IS NOT NULL AND asn IS NOT NULL")


def network_names(ranges: DataFrame) -> DataFrame:
    """(asn, name): the first name given for each network that isn't empty."""
    named = ranges.where(F.length("name") > 0).select("asn", "line", "name")
    return first_per_group(named, ["asn"], [F.col("line")]).select("asn", "name")


def place_ranges(lines: DataFrame) -> DataFrame:
    """(start, end, lat, lon, cc, city) of the city CSV: nine columns at least, positions as 32-bit floats, city or else region."""
    p = lines.withColumn("p", _parts(",")).where(F.size("p") >= 9)
    out = p.select(_at("p", 0).try_cast("long").alias("start"), _at("p", 1).try_cast("long").alias("end"), _at("p", 7).try_cast("float").alias("lat"), _at("p", 8).try_cast("float").alias("lon"), _at("p", 2).alias("cc"), F.coalesce(F.nullif(_at("p", 5), F.lit("")), _at("p", 3)).alias("city"))
    return out.where("start IS NOT NULL AND end IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def relationships(lines: DataFrame) -> DataFrame:
    """(line, a, b, rel) of 'a|b|rel' lines; -1 where a provides for b, 0 for peers."""
    p = lines.where(~F.col("value").startswith("#")).withColumn("p", _parts(r"\|"))
    return p.select("line", _at("p", 0).try_cast("long").alias("a"), _at("p", 1).try_cast("long").alias("b"), _at("p", 2).try_cast("int").alias("rel")).where("a IS NOT NULL AND b IS NOT NULL AND rel IS NOT NULL")


def node_numbers(rels: DataFrame) -> DataFrame:
    """(asn, node): networks numbered in order from 0."""
    both = rels.select(F.col("a").alias("asn")).union(rels.select("b"))
    return dense_codes(both, "asn", "node")


def organisations(lines: DataFrame) -> DataFrame:
    """(asn, name, org, country) of the two-section file whose '# format:' lines say what follows; the last line for a thing holds.

    The section of a line is that of the last format line before it: found by an as-of join, not by one window over the file.
    """
    heads = lines.where(F.col("value").startswith("# format:")).select("line", F.when(F.contains("value", F.lit("aut|")), "network").otherwise("org").alias("kind"))
    # a file has a few format lines
    marks = F.broadcast(heads.agg(F.array_sort(F.collect_list(F.struct("line", "kind"))).alias("heads")))
    body = lines.where(~F.col("value").startswith("#") & F.contains("value", F.lit("|"))).crossJoin(marks)
    before = F.filter("heads", lambda h: h["line"] < F.col("line"))
    rows = body.select("line", F.element_at(before, -1)["kind"].alias("kind"), _parts(r"\|").alias("p")).where("kind IS NOT NULL")
    last = lambda df, k: df.groupBy(k).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (k, "line")]), "line").alias("r")).select(k, "r.*")
    net = last(rows.where("kind = 'network'").select("line", _at("p", 0).try_cast("long").alias("asn"), _at("p", 2).alias("name"), _at("p", 3).alias("org_id")).where("asn IS NOT NULL"), "asn")
    org = last(rows.where("kind = 'org'").select("line", _at("p", 0).alias("org_id"), _at("p", 2).alias("org"), _at("p", 3).alias("country")), "org_id")
    return net.join(org, "org_id", "left").select("asn", "name", "org", "country")


def router_networks(lines: DataFrame) -> DataFrame:
    """(router, asn) of 'node.AS N1 42 method' lines; numbers below 1 are unknown and left out."""
    m = lambda k: F.regexp_extract("value", r"^node\.AS\s+N(\d+)\s+(-?\d+)", k)
    return lines.select(m(1).try_cast("long").alias("router"), m(2).try_cast("long").alias("asn")).where("router IS NOT NULL AND asn > 0")


def router_places(lines: DataFrame) -> DataFrame:
    """(router, place, lat, lon) of 'node.geo N1: continent country region city lat lon' lines, tabs between."""
    p = lines.where(F.col("value").startswith("node.geo")).withColumn("p", F.split("value", "\t"))
    return p.select(F.regexp_extract(F.get("p", F.lit(0)), r"N(\d+)", 1).try_cast("long").alias("router"), F.concat_ws("|", _at("p", 2), _at("p", 3), _at("p", 4)).alias("place"), _at("p", 5).try_cast("double").alias("lat"), _at("p", 6).try_cast("double").alias("lon")).where("router IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def router_links(lines: DataFrame, clique: int = 8) -> DataFrame:
    """(link, x, y) of 'link L1: N1:ip N2 N3 ...' lines: all pairs of up to ``clique`` routers, of more only those with the first."""
    ids = F.transform(F.regexp_extract_all("value", F.lit(r"\bN(\d+)"), F.lit(1)), lambda n: n.cast("long"))
    g = lines.where(F.col("value").startswith("link")).select(F.regexp_extract("value", r"\bL(\d+)", 1).try_cast("long").alias("link"), ids.alias("n")).where(F.size("n") >= 2)
    pairs = F.flatten(F.transform("n", lambda x, i: F.transform(F.slice("n", i + 2, F.size("n")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    star = F.transform(F.slice("n", 2, F.size("n")), lambda y: F.struct(F.get("n", F.lit(0)).alias("x"), y.alias("y")))
    return g.select("link", F.explode(F.when(F.size("n") <= clique, pairs).otherwise(star)).alias("p")).select("link", "p.x", "p.y")


def geofeed(lines: DataFrame) -> DataFrame:
    """(prefix, version, plen, lo, hi, country, region, city) of a geofeed; prefixes canonical, codes in upper case, the first line holds."""
    p = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).withColumn("p", _parts(",")).withColumn("c", cidr(_at("p", 0))).where("c.version IS NOT NULL")
    rows = p.select(F.col("c.text").alias("prefix"), "line", "c.version", "c.plen", "c.lo", "c.hi", F.upper(_at("p", 1)).alias("country"), F.upper(_at("p", 2)).alias("region"), _at("p", 3).alias("city"))
    return first_per_group(rows, ["prefix"], [F.col("line")]).drop("line")


def pop_feed(lines: DataFrame) -> DataFrame:
    """(prefix, pop, iata) of 'prefix,pop,iata' lines with a pop; codes in lower case, the first line holds."""
    p = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).withColumn("p", _parts(",")).withColumn("c", cidr(_at("p", 0))).where(F.col("c.version").isNotNull() & (F.length(_at("p", 1)) > 0))
    rows = p.select(F.col("c.text").alias("prefix"), "line", F.lower(_at("p", 1)).alias("pop"), F.lower(_at("p", 2)).alias("iata"))
    return first_per_group(rows, ["prefix"], [F.col("line")]).drop("line")


def pop_prefixes4(lines: DataFrame) -> DataFrame:
    """(lo, hi, plen, pop): the IPv4 part of a pop feed, without leaving the JVM."""
    p = lines.withColumn("p", _parts(",")).withColumn("c", cidr4(_at("p", 0))).where("c IS NOT NULL")
    return first_per_group(p.select("c.lo", "c.hi", "c.plen", "line", F.lower(_at("p", 1)).alias("pop")), ["lo", "hi", "plen"], [F.col("line")]).drop("line")


def airport_ranks(airports: DataFrame) -> DataFrame:
    """(code, id, lat, lon): each code's airport, scheduled and larger ones first, then the first by id."""
    size = F.when(F.col("type") == "large_airport", 0).when(F.col("type") == "medium_airport", 1).otherwise(2)
    rows = airports.where("iata_code IS NOT NULL AND latitude_deg IS NOT NULL").select(F.lower("iata_code").alias("code"), size.alias("size"), F.when(F.col("scheduled_service") == "yes", 0).otherwise(1).alias("plain"), "id", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    return first_per_group(rows, ["code"], [F.col("size"), F.col("plain"), F.col("id")]).select("code", "id", "lat", "lon")


def ping_results(pings: DataFrame) -> DataFrame:
    """(rec_id, prb_id, ts, rtt, least, sent, rcvd): ``rtt`` is the median reply, null if there is none; ``least`` the given minimum if it is >= 0."""
    rtts = F.array_sort(F.filter(F.transform("result", lambda r: r["rtt"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    p = pings.withColumn("v", F.coalesce(rtts, F.array().cast("array<double>"))).withColumn("n", F.size("v"))
    mid = (F.element_at("v", F.greatest(F.lit(1), F.floor((F.col("n") + 1) / 2).cast("int"))) + F.element_at("v", F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int") + 1))) / 2
    given = F.when((F.col("rtt_min") >= 0) & ~F.isnan("rtt_min"), F.col("rtt_min"))
    p = p.withColumn("rtt", F.when(F.col("n") > 0, mid)).withColumn("least", F.coalesce(given, F.when(F.col("n") > 0, F.get("v", F.lit(0)))))
    return p.select("rec_id", "prb_id", F.col("timestamp").alias("ts"), "rtt", "least", "sent", F.coalesce("rcvd", "n").alias("rcvd"))


def trace_hops(replies: DataFrame) -> DataFrame:
    """(rec_id, hop_pos, hop, ip, rtt, replies) of :func:`flat_table` replies: the address that answered most (the first of equals), the median reply."""
    ok = replies.where("from_addr IS NOT NULL AND from_addr <> ''")
    by = ok.groupBy("rec_id", "hop_pos", "hop", "from_addr").agg(F.count("*").alias("n"), F.min("reply_pos").alias("first"))
    best = by.groupBy("rec_id", "hop_pos", "hop").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "from_addr")).alias("k"), F.sum("n").alias("replies"))
    mid = ok.where("rtt IS NOT NULL").groupBy("rec_id", "hop_pos").agg(F.median("rtt").alias("rtt"))
    return best.join(mid, ["rec_id", "hop_pos"], "left").select("rec_id", "hop_pos", "hop", F.col("k.from_addr").alias("ip"), "rtt", "replies")


def pasted_trace(lines: DataFrame, trace: str = "trace") -> DataFrame:
    """(trace, line, hop, ip, host) of pasted traceroutes (``trace`` tells them apart): the first address of a line; lines that go on with the same hop are dropped."""
    head = r"^\s*(\d{1,3})(?:\.\|--|\.|\s)\s*(.*)$"
    p = lines.select(trace, "line", F.regexp_extract("value", head, 1).try_cast("int").alias("hop"), F.regexp_extract("value", head, 2).alias("rest")).where("hop IS NOT NULL").where(~F.lower("rest").rlike("^(traceroute|tracing)"))
    quad = r"(?:^|[^\d.])(\d{1,3}(?:\.\d{1,3}){3})(?:[^\d.]|$)"
    dashed = r"(?:^|[^\d])(\d{1,3}-\d{1,3}-\d{1,3}-\d{1,3})(?:[^\d]|$)"
    name = F.nullif(F.regexp_extract("rest", r"([A-Za-z0-9][\w-]*(?:\.[\w-]+)*\.[A-Za-z]{2,})\b", 1), F.lit(""))
    lit = F.nullif(F.regexp_extract("rest", quad, 1), F.lit(""))
    dash = F.nullif(F.regexp_replace(F.regexp_extract(name, dashed, 1), "-", "."), F.lit(""))
    p = p.select(trace, "line", "hop", F.coalesce(lit, dash).alias("ip"), F.coalesce(name, F.lit("")).alias("host"))
    prev = F.lag("hop").over(Window.partitionBy(trace).orderBy("line"))
    return p.withColumn("prev", prev).where("prev IS NULL OR prev <> hop").drop("prev")


ELEMENTS = T.StructType([T.StructField(n, t) for n, t in (("OBJECT_ID", T.StringType()), ("NORAD_CAT_ID", T.LongType()), ("EPOCH", T.StringType()), ("MEAN_MOTION", T.DoubleType()), ("ECCENTRICITY", T.DoubleType()), ("INCLINATION", T.DoubleType()), ("RA_OF_ASC_NODE", T.DoubleType()), ("ARG_OF_PERICENTER", T.DoubleType()), ("MEAN_ANOMALY", T.DoubleType()), ("BSTAR", T.DoubleType()))])


def elements(json_lines: DataFrame) -> DataFrame:
    """Orbital elements of JSON records; those without number or mean motion are left out, equal numbers keep the latest epoch."""
    e = json_lines.select(F.from_json("value", ELEMENTS).alias("e")).select("e.*").where("NORAD_CAT_ID IS NOT NULL AND MEAN_MOTION > 0")
    rest = [c for c in e.columns if c != "NORAD_CAT_ID"]
    return e.groupBy("NORAD_CAT_ID").agg(F.max_by(F.struct(*rest), "EPOCH").alias("r")).select("NORAD_CAT_ID", "r.*")


def running_deltas(df: DataFrame, group: str, pos: str, delta: str, out: str) -> DataFrame:
    """Values that were written as differences to the one before, within each group."""
    return df.withColumn(out, F.sum(delta).over(Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def site_documents(files: DataFrame) -> DataFrame:
    """(path, id, name, country, lat, lon, notes) of YAML site files (``path``, ``content``): one document each, its first node."""
    schema = "path string, id string, name string, country string, lat double, lon double, notes string"

    def read(batches):
        import pandas as pd
        import yaml

        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    doc = yaml.safe_load(content if isinstance(content, str) else bytes(content).decode("utf-8", "replace"))
                except yaml.YAMLError:
                    doc = None
                node = doc[0] if isinstance(doc, list) and doc else doc
                if isinstance(node, dict):
                    num = lambda k, node=node: float(node[k]) if isinstance(node.get(k), (int, float)) else None
                    out.append((path, *[None if node.get(k) is None else str(node[k]) for k in ("id", "name", "country")], num("lat"), num("lon"), " ".join(str(node.get("notes") or "").split())))
            yield pd.DataFrame(out, columns=["path", "id", "name", "country", "lat", "lon", "notes"])

    return files.select("path", "content").mapInPandas(read, schema)


def zipped_columns(df: DataFrame, columns: list[str], nulls: dict[str, int] | None = None) -> DataFrame:
    """Rows of a columnar JSON document (arrays of equal length); a code that stands for nothing becomes null."""
    rows = df.select(F.posexplode(F.arrays_zip(*columns)).alias("pos", "r")).select("pos", "r.*")
    for c, code in (nulls or {}).items():
        rows = rows.withColumn(c, F.when(F.col(c) != code, F.col(c)))
    return rows


# The compact document's columns, their element and their fixed-point scale.
SCALES = (("n", "MEAN_MOTION", 1e8), ("e", "ECCENTRICITY", 1e7), ("i", "INCLINATION", 1e4), ("raan", "RA_OF_ASC_NODE", 1e4), ("argp", "ARG_OF_PERICENTER", 1e4), ("ma", "MEAN_ANOMALY", 1e4), ("bstar", "BSTAR", 1e9))


def compact_elements(documents: DataFrame) -> DataFrame:
    """Elements of compact column documents (``doc``, ``value``): (doc, pos, NORAD_CAT_ID, OBJECT_ID, epoch_ms, elements...).

    Ids are differences to the one before, epochs milliseconds after the document's base, and a designator that is only a piece's letters is of
    the launch before it, as far as that was one.
    """
    columns = ["id", "epoch", *[k for k, _, _ in SCALES]]
    schema = "epochBase string, intlId array<string>, " + ", ".join(f"{c} array<long>" for c in columns)
    j = documents.select("doc", F.from_json("value", schema).alias("j")).select("doc", "j.*")
    rows = j.select("doc", F.unix_millis(F.to_timestamp(F.regexp_replace("epochBase", "Z$", "+00:00"))).alias("base"), F.posexplode(F.arrays_zip("intlId", *columns)).alias("pos", "r")).select("doc", "base", "pos", "r.*")
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    letters = F.col("intlId").rlike("^[A-Z]+$")
    launch = F.regexp_extract("intlId", r"^(\d{4}-\d{3})[A-Z]+$", 1)  # empty where it is none, which ends the last launch
    last = F.last(F.when(~F.coalesce(letters, F.lit(False)), F.coalesce(launch, F.lit(""))), True).over(upto)
    named = F.when(letters & (F.coalesce(last, F.lit("")) != ""), F.concat(last, "intlId")).otherwise(F.col("intlId"))
    return rows.select("doc", "pos", F.sum("id").over(upto).alias("NORAD_CAT_ID"), named.alias("OBJECT_ID"), (F.col("base") + F.col("epoch")).alias("epoch_ms"), *[(F.col(k) / F.lit(scale)).alias(name) for k, name, scale in SCALES])


def first_answer(sources: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame, list[tuple[str, str]]]:
    """(source, its rows, what the sources before said): the first source that gives rows; if none does, an error with all reasons."""
    tried: list[tuple[str, str]] = []
    for name, load in sources:
        try:
            rows = load()
            if rows.head(1):
                return name, rows, tried
            tried.append((name, "no rows"))
        except Exception as e:  # noqa: BLE001 - whatever a source does, the next one is asked
            tried.append((name, type(e).__name__))
    raise ValueError("no source answered: " + "; ".join(f"{n}: {e}" for n, e in tried))
