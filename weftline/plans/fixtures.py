"""Views over the driver's tables that stand for ranges, places, links and samples, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.functions.net import ipv4_number
from weftline.plans.tables import table


def prefixes(spark: SparkSession, d: str) -> DataFrame:
    """(start, end, asn): 16 order numbers each."""
    k = F.expr("o_orderkey div 16")
    return table(spark, d, "orders").groupBy(k.alias("k")).agg((F.min_by("o_custkey", "o_orderkey") % 97 + 1).alias("asn")).select((F.col("k") * 16).alias("start"), (F.col("k") * 16 + 15).alias("end"), "asn")


def places(spark: SparkSession, d: str) -> DataFrame:
    """(start, end, lat, lon, cc, city): 24 order numbers each, placed by the customer's nation."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    k = F.expr("o_orderkey div 24")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy(k.alias("k")).agg(F.min_by("c_nationkey", "o_orderkey").alias("nk"))
    g = g.join(n, g.nk == n.n_nationkey)
    return g.select((F.col("k") * 24).alias("start"), (F.col("k") * 24 + 23).alias("end"), (-60.0 + 5 * F.col("nk")).alias("lat"), (-170.0 + 13 * F.col("nk")).alias("lon"), F.col("n_name").alias("cc"), F.concat(F.lit("C"), F.col("nk")).alias("city"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(eid, a, b, rel): rel -1 means a provides for b, 0 that they are peers. eid orders the links."""
    r, n, s = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    paid = li.join(o, li.l_orderkey == o.o_orderkey).select("o_custkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("w"))
    spend = paid.repartition("o_custkey").groupBy("o_custkey", "l_suppkey").agg(F.sum("w").alias("w"))  # one shuffle for the sums and their order
    top = spend.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("w"), "l_suppkey"))).where("k <= 2")
    # a supplier peers with the next four of its nation, so a nation with many suppliers has few links for each
    following = [F.lead("s_suppkey", k).over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) for k in (1, 2, 3, 4)]
    beside = s.select("s_suppkey", F.array(*following).alias("next")).select("s_suppkey", F.explode(F.array_compact("next")).alias("other"))
    link = lambda df, a, b, rel: df.select(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(rel).alias("rel"))
    parts = [
        link(n, F.col("n_regionkey") + 1_000_000, F.col("n_nationkey") + 2_000_000, -1),
        link(s, F.col("s_nationkey") + 2_000_000, F.col("s_suppkey") + 3_000_000, -1),
        link(top, F.col("l_suppkey") + 3_000_000, F.col("o_custkey") + 4_000_000, -1),
        link(r.alias("x").join(r.alias("y"), F.expr("x.r_regionkey < y.r_regionkey")), F.col("x.r_regionkey") + 1_000_000, F.col("y.r_regionkey") + 1_000_000, 0),
        link(beside, F.col("s_suppkey") + 3_000_000, F.col("other") + 3_000_000, 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select((F.col("a") * 10_000_000 + F.col("b")).alias("eid"), "a", "b", "rel")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.select(F.col("a").alias("node")).union(e.select("b")).distinct()


def node_positions(spark: SparkSession, d: str) -> DataFrame:
    """(node, lat, lon) by the nation that the node belongs to; regions lie at their first nation."""
    n, s, c = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "customer")
    r = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("nk"))
    at = lambda df, node, nk: df.select(node.cast("long").alias("node"), (-60.0 + 5 * nk).alias("lat"), (-170.0 + 13 * nk).alias("lon"))
    return at(r, F.col("n_regionkey") + 1_000_000, F.col("nk")).union(at(n, F.col("n_nationkey") + 2_000_000, F.col("n_nationkey"))).union(at(s, F.col("s_suppkey") + 3_000_000, F.col("s_nationkey"))).union(at(c, F.col("c_custkey") + 4_000_000, F.col("c_nationkey")))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(probe, ts, rtt, id) of the events."""
    return table(spark, d, "events").select(F.col("user_id").alias("probe"), "ts", F.col("value").alias("rtt"), F.col("event_id").alias("id"))


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ip, n): IPv4 literals in the documents, and the source addresses of the pings."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), F.lit(1))).alias("ip"))
    src = table(spark, d, "pings").where(F.col("src_addr").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).select(F.col("rec_id").alias("doc_id"), F.col("src_addr").alias("ip"))
    return docs.unionByName(src).withColumn("n", ipv4_number("ip"))


_RUNS = "CASE " + " ".join(f"WHEN regexp_matches(t, '(^|:)0(:0){{{k - 1}}}(:|$)') THEN regexp_replace(t, '(^|:)0(:0){{{k - 1}}}(:|$)', '::')" for k in range(8, 1, -1)) + " ELSE t END"
# canonical prefixes of the PoP feed in SQL: octets or hextets as numbers, host bits cleared, the longest run of zeros (the first of equals) compressed
_CANONICAL = f"""WITH raw AS (SELECT *, string_split(trim(c0), '/') AS p FROM pops),
cut AS (SELECT snap, line_no, c0, c1, c2, lower(p[1]) AS a, TRY_CAST(p[2] AS INT) AS n FROM raw WHERE len(p) = 2 AND regexp_full_match(p[2], '[0-9]+')),
four AS (SELECT * EXCLUDE (a), list_transform(string_split(a, '.'), lambda x: x::INT) AS o FROM cut WHERE regexp_full_match(a, '(0|[1-9][0-9]{{0,2}})(\\.(0|[1-9][0-9]{{0,2}})){{3}}') AND n <= 32),
net4 AS (SELECT * REPLACE ([o[i] & ((255::BIGINT << (8 - least(8, greatest(0, n - 8 * (i - 1))))) & 255) for i in [1, 2, 3, 4]] AS o) FROM four WHERE list_max(o) <= 255),
halves AS (SELECT *, string_split(a, '::') AS h FROM cut WHERE a LIKE '%:%' AND n <= 128),
sides AS (SELECT * EXCLUDE (h), len(h) AS k, CASE WHEN h[1] = '' THEN [] ELSE string_split(h[1], ':') END AS l, CASE WHEN coalesce(h[2], '') = '' THEN [] ELSE string_split(h[2], ':') END AS r FROM halves WHERE len(h) <= 2),
six AS (SELECT * EXCLUDE (l, r), list_concat(l, list_transform(range(8 - len(l) - len(r)), lambda z: '0'), r) AS g FROM sides WHERE k = 2 AND len(l) + len(r) <= 7 OR k = 1 AND len(l) = 8),
num6 AS (SELECT * REPLACE (list_transform(g, lambda x: ('0x' || x)::INT) AS g) FROM six WHERE len(list_filter(g, lambda x: NOT regexp_full_match(x, '[0-9a-f]{{1,4}}'))) = 0),
net6 AS (SELECT * REPLACE ([g[i] & ((65535::BIGINT << (16 - least(16, greatest(0, n - 16 * (i - 1))))) & 65535) for i in [1, 2, 3, 4, 5, 6, 7, 8]] AS g) FROM num6),
plain6 AS (SELECT *, lower(array_to_string(list_transform(g, lambda x: to_hex(x)), ':')) AS t FROM net6)
SELECT snap, line_no, c0, c1, c2, 4 AS version, n AS plen, array_to_string(o, '.') || '/' || n AS text, array_to_string(list_transform(o, lambda x: lpad(bin(x), 8, '0')), '') AS bits FROM net4
UNION ALL SELECT snap, line_no, c0, c1, c2, 6, n, {_RUNS} || '/' || n, array_to_string(list_transform(g, lambda x: lpad(bin(x), 16, '0')), '') FROM plain6"""
_CTE = {
    "fx_canon": ("", _CANONICAL),
    "fx_prefix": ("", "SELECT k * 16 AS start, k * 16 + 15 AS \"end\", asn FROM (SELECT o_orderkey // 16 AS k, min_by(o_custkey, o_orderkey) % 97 + 1 AS asn FROM orders GROUP BY 1)"),
    "fx_geo": ("", "SELECT k * 24 AS start, k * 24 + 23 AS \"end\", -60.0::DOUBLE + 5 * nk AS lat, -170.0::DOUBLE + 13 * nk AS lon, n_name AS cc, concat('C', nk) AS city FROM (SELECT o_orderkey // 24 AS k, min_by(c_nationkey, o_orderkey) AS nk FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) JOIN nation ON nk = n_nationkey"),
    "fx_edges": ("", """SELECT a * 10000000 + b AS eid, a, b, rel FROM (
      SELECT n_regionkey::BIGINT + 1000000 AS a, n_nationkey::BIGINT + 2000000 AS b, -1 AS rel FROM nation
      UNION ALL SELECT s_nationkey + 2000000, s_suppkey + 3000000, -1 FROM supplier
      UNION ALL SELECT l_suppkey + 3000000, o_custkey + 4000000, -1 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, l_suppkey) AS k FROM (SELECT o_custkey, l_suppkey, sum(round(l_extendedprice * 100)::BIGINT) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE k <= 2
      UNION ALL SELECT x.r_regionkey + 1000000, y.r_regionkey + 1000000, 0 FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey
      UNION ALL SELECT x.s_suppkey + 3000000, y.s_suppkey + 3000000, 0 FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) x JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) y ON x.s_nationkey = y.s_nationkey AND y.k BETWEEN x.k + 1 AND x.k + 4)"""),
    "fx_nodes": ("fx_edges", "SELECT a AS node FROM fx_edges UNION SELECT b FROM fx_edges"),
    "fx_node_pos": ("", """SELECT node, -60.0::DOUBLE + 5 * nk AS lat, -170.0::DOUBLE + 13 * nk AS lon FROM (
      SELECT n_regionkey::BIGINT + 1000000 AS node, min(n_nationkey) AS nk FROM nation GROUP BY 1
      UNION ALL SELECT n_nationkey + 2000000, n_nationkey FROM nation UNION ALL SELECT s_suppkey + 3000000, s_nationkey FROM supplier UNION ALL SELECT c_custkey + 4000000, c_nationkey FROM customer)"""),
    "fx_ping": ("", "SELECT user_id AS probe, ts, value AS rtt, event_id AS id FROM events"),
    "fx_ips": ("", """SELECT doc_id, ip, CASE WHEN p[1]::INT <= 255 AND p[2]::INT <= 255 AND p[3]::INT <= 255 AND p[4]::INT <= 255 THEN p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT END AS n FROM (
      SELECT doc_id, ip, string_split(ip, '.') AS p FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(\\d{1,3}(?:\\.\\d{1,3}){3})\\b', 1)) AS ip FROM documents UNION ALL SELECT rec_id, src_addr FROM pings WHERE regexp_matches(src_addr, '^\\d{1,3}(\\.\\d{1,3}){3}$')))"""),
}


def with_sql(names: str, body: str) -> str:
    """``body`` after the CTEs it names, and those they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in _CTE[n][0].split():
            need(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    lead = ", ".join(f"{n} AS ({_CTE[n][1]})" for n in order)
    body = body.strip()
    return f"WITH {lead}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {lead} {body}"
