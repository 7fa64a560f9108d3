"""Links between PoPs inferred from traceroutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import net
from weftline.operators import intervals
from weftline.plans.problems import _HOPS, trace_replies
from weftline.plans.relational import _POPS4, _pop_table
from weftline.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_OWN = (("203.0.113.0", 24), ("198.51.100.0", 24), ("240.255.0.0", 16))
_NUM = "CASE WHEN regexp_matches({0}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') AND len(list_filter(string_split({0}, '.'), lambda x: TRY_CAST(x AS INT) > 255)) = 0 THEN list_reduce(list_transform(string_split({0}, '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) END"
_LPM = "LEFT JOIN LATERAL (SELECT pop FROM t4 WHERE num BETWEEN t4.lo AND t4.lo + pow(2, 32 - plen)::BIGINT - 1 ORDER BY plen DESC LIMIT 1) t ON true"


def agg_backbone_evidence(s, d):
    """Links between PoPs: a traceroute from behind one PoP meets a prefix of another ('prefix'), or a router that traceroutes from behind the other cross too
    ('shared' if it is the first router on both sides, else 'transit'). A link seen only by shared routers has low confidence.

    What a router is crossed by is first collapsed to its PoPs, a bounded number, so no router's traceroutes are paired with each other.
    """
    pops = _pop_table(s, d).where("pop <> ''")
    t = table(s, d, "traceroutes").select("rec_id", "prb_id", "msm_id", net.ipv4_number("from_addr").alias("num")).where("num IS NOT NULL")
    home = intervals.longest_prefix(t, "num", pops).where("pop IS NOT NULL").select("rec_id", "prb_id", "msm_id", F.col("pop").alias("home"))
    first = trace_replies(s, d).where("from_addr <> ''").groupBy("rec_id", "hop_pos").agg(F.min_by("from_addr", "reply_pos").alias("ip"))
    hops = first.join(home, "rec_id").withColumn("num", net.ipv4_number("ip")).where("num IS NOT NULL")
    hit = intervals.longest_prefix(hops, "num", pops)
    direct = hit.where("pop IS NOT NULL AND pop <> home").select("rec_id", "prb_id", "home", F.col("pop").alias("other"), F.lit("prefix").alias("kind"), F.lit(None).cast("string").alias("router"))
    own = hit.where(F.col("pop").isNull() & net.in_blocks("num", _OWN))
    depth = own.groupBy("rec_id").agg(F.min("hop_pos").alias("least"))
    crossed = own.join(depth, "rec_id").select("rec_id", "prb_id", "home", F.col("ip").alias("router"), (F.col("hop_pos") == F.col("least")).alias("edge"))
    at = crossed.groupBy("router", "home").agg(F.max("edge").alias("edge"))
    lists = at.groupBy("router").agg(F.collect_list(F.struct("home", "edge")).alias("pops")).where(F.size("pops") > 1)  # as many as there are PoPs
    seen = crossed.select("rec_id", "prb_id", "home", "router").distinct().join(lists, "router")
    mine = F.element_at(F.filter("pops", lambda p: p["home"] == F.col("home")), 1)["edge"]
    met = seen.withColumn("mine", mine).select("rec_id", "prb_id", "home", "router", "mine", F.explode("pops").alias("p")).where("p.home <> home")
    shared = met.select("rec_id", "prb_id", "home", F.col("p.home").alias("other"), F.when(F.col("mine") & F.col("p.edge"), "shared").otherwise("transit").alias("kind"), "router")
    rows = direct.unionByName(shared)
    g = rows.groupBy(F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b")).agg(F.count_distinct("rec_id").alias("evidence"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"), F.count_distinct("router").alias("routers"), F.count_distinct("prb_id").alias("probes"))
    return g.withColumn("confidence", F.when(F.col("kinds") == "shared", "low").otherwise("medium"))


QUERIES["agg_backbone_evidence"] = agg_backbone_evidence
SQL["agg_backbone_evidence"] = f"""WITH {_HOPS}, {_POPS4.replace('a4 AS', 'unused4 AS').replace('FROM a4', 'FROM unused4')}, tt4 AS (SELECT * FROM t4 WHERE pop <> ''),
tn AS (SELECT rec_id, prb_id, {_NUM.format('from_addr')} AS num FROM traceroutes), home AS (SELECT rec_id, prb_id, t.pop AS home FROM tn {_LPM.replace('FROM t4', 'FROM tt4 t4')} WHERE num IS NOT NULL AND t.pop IS NOT NULL),
firsts AS (SELECT rec_id, hop_pos, arg_min(from_addr, reply_pos) AS ip FROM replies WHERE from_addr <> '' GROUP BY 1, 2), hn AS (SELECT f.rec_id, hop_pos, ip, prb_id, home, {_NUM.format('ip')} AS num FROM firsts f JOIN home USING (rec_id)),
hit AS (SELECT hn.*, t.pop FROM hn {_LPM.replace('FROM t4', 'FROM tt4 t4')} WHERE num IS NOT NULL),
own AS (SELECT *, min(hop_pos) OVER (PARTITION BY rec_id) = hop_pos AS edge FROM hit WHERE pop IS NULL AND (num BETWEEN 3405803776 AND 3405804031 OR num BETWEEN 3325256704 AND 3325256959 OR num BETWEEN 4043243520 AND 4043309055)),
bypop AS (SELECT ip AS router, home, bool_or(edge) AS edge FROM own GROUP BY 1, 2),
met AS (SELECT DISTINCT o.rec_id, o.prb_id, o.home, q.home AS other, CASE WHEN p.edge AND q.edge THEN 'shared' ELSE 'transit' END AS kind, o.ip AS router FROM own o JOIN bypop p ON p.router = o.ip AND p.home = o.home JOIN bypop q ON q.router = o.ip AND q.home <> o.home),
rows_ AS (SELECT rec_id, prb_id, home, pop AS other, 'prefix' AS kind, NULL AS router FROM hit WHERE pop IS NOT NULL AND pop <> home UNION ALL SELECT * FROM met),
g AS (SELECT least(home, other) AS a, greatest(home, other) AS b, count(DISTINCT rec_id) AS evidence, array_to_string(list_sort(list(DISTINCT kind)), '+') AS kinds, count(DISTINCT router) AS routers, count(DISTINCT prb_id) AS probes FROM rows_ GROUP BY 1, 2)
SELECT *, CASE WHEN kinds = 'shared' THEN 'low' ELSE 'medium' END AS confidence FROM g"""
