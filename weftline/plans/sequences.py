"""Queries over ordered rows: circles cut at their gaps, densest stretches, hops that locate each other, statuses over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import net
from weftline.operators import intervals, sequences
from weftline.plans import fixtures as fx
from weftline.plans.fixtures import with_sql
from weftline.plans.problems import _HOPS, trace_replies
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


_TURN = "(event_id * 137.508) % 360"


@query(f"WITH a AS (SELECT user_id AS g, event_id AS id, {_TURN} AS t FROM events), w AS (SELECT *, row_number() OVER o AS r, count(*) OVER (PARTITION BY g) AS c, coalesce(lead(t) OVER o, min(t) OVER (PARTITION BY g) + 360) - t AS gap FROM a WINDOW o AS (PARTITION BY g ORDER BY t, id)), k AS (SELECT *, first_value(r) OVER (PARTITION BY g ORDER BY gap DESC, r) AS cut FROM w), s AS (SELECT g, id, t, (r - cut - 1 + c) % c AS pos, lag(gap) OVER (PARTITION BY g ORDER BY (r - cut - 1 + c) % c) AS before FROM k), i AS (SELECT *, sum(CASE WHEN before > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY pos) AS island FROM s) SELECT g AS user_id, island::INT AS island, count(*) AS members, arg_min(id, pos) AS first, arg_max(id, pos) AS last FROM i GROUP BY 1, 2 HAVING count(*) >= 4")
def win_gaps_islands(s, d):
    """Islands of angles on a circle that is cut at its widest gap and split at gaps of more than eight degrees; four members at least."""
    e = table(s, d, "events").select(F.col("user_id"), "event_id", ((F.col("event_id") * 137.508) % 360).alias("turn"))
    i = sequences.circle_islands(e, "user_id", "turn", "event_id", 8.0)
    g = i.groupBy("user_id", "island").agg(F.count("*").alias("members"), F.min_by("event_id", "pos").alias("first"), F.max_by("event_id", "pos").alias("last"))
    return g.where("members >= 4")


def _densest_sql(rounds: int) -> str:
    """The extractions one after the other: each round takes the fullest stretch of what is left."""
    out = "l0 AS (SELECT user_id AS g, event_id AS id, value AS v FROM events)"
    for k in range(rounds):
        out += f", c{k} AS (SELECT g, v AS lo, count(*) OVER (PARTITION BY g ORDER BY v RANGE BETWEEN CURRENT ROW AND 12.0 FOLLOWING) AS n FROM l{k}), b{k} AS (SELECT g, arg_min(lo, (-n, lo)) AS lo, max(n) AS n FROM c{k} GROUP BY 1 HAVING max(n) >= 6), l{k + 1} AS (SELECT l.* FROM l{k} l JOIN b{k} b ON b.g = l.g WHERE l.v < b.lo OR l.v > b.lo + 12.0)"
    return out


@query(f"WITH {_densest_sql(20)} SELECT g AS user_id, shell, lo, n AS members FROM (" + " UNION ALL ".join(f"SELECT g, {k} AS shell, lo, n FROM b{k}" for k in range(20)) + ")")
def win_densest(s, d):
    """Stretches of twelve that hold most of a user's values, taken out one after the other while one holds six."""
    e = table(s, d, "events").select("user_id", "event_id", "value")
    return sequences.densest_stretches(e, "user_id", "value", "event_id", 12.0, 6)


@query("WITH RECURSIVE e AS (SELECT user_id AS g, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type = 'purchase' AS fixed_, value AS v FROM events), n AS (SELECT g, k, first_value(CASE WHEN fixed_ THEN v END IGNORE NULLS) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM e), r(g, k, at_) AS (SELECT e.g, e.k, CASE WHEN fixed_ THEN v WHEN later IS NULL THEN NULL WHEN abs(v - later) <= abs(v + 10 - later) THEN v ELSE v + 10 END FROM e JOIN n USING (g, k) WHERE k = 1 UNION ALL SELECT e.g, e.k, CASE WHEN fixed_ THEN v WHEN coalesce(r.at_, n.later) IS NULL THEN NULL WHEN abs(v - coalesce(r.at_, n.later)) <= abs(v + 10 - coalesce(r.at_, n.later)) THEN v ELSE v + 10 END FROM r JOIN e ON e.g = r.g AND e.k = r.k + 1 JOIN n ON n.g = e.g AND n.k = e.k) SELECT id AS event_id, at_ AS located FROM r JOIN e USING (g, k)")
def win_last_located(s, d):
    """Hops with two candidates take the one nearest the last located hop, else the next fixed one; what is located anchors the hops after it."""
    e = table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.array("value")).otherwise(F.array(F.col("value"), F.col("value") + 10)).alias("options"))
    return sequences.locate_along(e, "user_id", "event_id", "options", "located").select("event_id", "located")


_ROUTED = "own_ AS (SELECT lo, min(asn) AS asn FROM (SELECT 3221225472 + start * 4096 AS lo, asn FROM fx_prefix) GROUP BY 1), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, hop_pos ORDER BY reply_pos) AS k FROM replies WHERE from_addr <> '') WHERE k = 1), steps AS (SELECT DISTINCT n.rec_id, n.hop_pos, f.from_addr AS host, CASE WHEN regexp_matches(f.from_addr, '^\\d{1,3}(\\.\\d{1,3}){3}$') AND len(list_filter(string_split(f.from_addr, '.'), lambda x: TRY_CAST(x AS INT) > 255)) = 0 THEN list_reduce(list_transform(string_split(f.from_addr, '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) END AS num FROM numbered n LEFT JOIN firsts f ON f.rec_id = n.rec_id AND f.hop_pos = n.hop_pos), hit AS (SELECT s.*, CASE WHEN s.num <= o.lo + 65535 THEN o.asn END AS asn FROM steps s ASOF LEFT JOIN own_ o ON s.num >= o.lo), st AS (SELECT *, CASE WHEN host IS NULL THEN 'timeout' WHEN num IS NULL THEN 'nameonly' WHEN num BETWEEN 3232235520 AND 3232301055 OR num BETWEEN 167772160 AND 184549375 OR num BETWEEN 1681915904 AND 1686110207 THEN 'private' WHEN asn IS NULL THEN 'unrouted' WHEN asn % 5 = 0 THEN 'missing' ELSE 'ok' END AS status FROM hit)"


@query(f"WITH {_HOPS}, {_ROUTED}, ok AS (SELECT rec_id, hop_pos, asn, lag(asn) OVER (PARTITION BY rec_id ORDER BY hop_pos) AS before FROM st WHERE status = 'ok') SELECT st.rec_id, st.hop_pos::INT AS hop_pos, status, CASE WHEN status = 'ok' THEN st.asn END AS node, coalesce(ok.before IS NULL OR ok.before <> ok.asn, false) AND ok.asn IS NOT NULL AS waypoint FROM st LEFT JOIN ok ON ok.rec_id = st.rec_id AND ok.hop_pos = st.hop_pos", "fx_prefix")
def join_trace_resolve(s, d):
    """Each hop's status by the first rule that holds (timeout, name only, private, unrouted, missing, ok), its node, and whether it is a waypoint: a node unlike the last one's."""
    from weftline.plans.problems import p1_hops

    first = trace_replies(s, d).where("from_addr <> ''").groupBy("rec_id", "hop_pos").agg(F.min_by("from_addr", "reply_pos").alias("host"))
    hops = p1_hops(s, d).select("rec_id", "hop_pos").distinct().join(first, ["rec_id", "hop_pos"], "left").withColumn("num", net.ipv4_number("host"))
    owners = fx.prefixes(s, d).groupBy((F.lit(3221225472) + F.col("start") * 4096).alias("lo")).agg(F.min("asn").alias("asn"))
    hit = intervals.last_before(hops, owners.withColumn("owner", F.struct("lo", "asn")), "num", "lo", "owner")
    asn = F.when(F.col("num") <= F.col("owner.lo") + 65535, F.col("owner.asn"))
    private = net.in_blocks("num", (("192.168.0.0", 16), ("10.0.0.0", 8), ("100.64.0.0", 10)))
    status = F.when(F.col("host").isNull(), "timeout").when(F.col("num").isNull(), "nameonly").when(private, "private").when(asn.isNull(), "unrouted").when(asn % 5 == 0, "missing").otherwise("ok")
    rows = hit.select("rec_id", "hop_pos", status.alias("status"), F.when(status == "ok", asn).alias("node"))
    before = F.last("node", True).over(Window.partitionBy("rec_id").orderBy("hop_pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("waypoint", F.col("node").isNotNull() & ~F.coalesce(before == F.col("node"), F.lit(False)))


@query("WITH steps AS (SELECT r_regionkey AS step FROM region), said AS (SELECT n_nationkey AS centre, n_regionkey AS step, CASE n_nationkey % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'degraded' ELSE 'up' END AS status, CASE WHEN n_nationkey % 5 = 0 THEN '*' ELSE ((n_nationkey + 1) % 25)::VARCHAR END AS to_ FROM nation), now_ AS (SELECT steps.step, c.n_nationkey AS centre, coalesce(s.status, 'up') AS status FROM steps CROSS JOIN nation c LEFT JOIN said s ON s.centre = c.n_nationkey AND s.step <= steps.step), links AS (SELECT s.step, s.centre, n.n_nationkey AS other FROM said s JOIN nation n ON CASE WHEN s.to_ = '*' THEN n.n_nationkey <> s.centre ELSE n.n_nationkey = s.to_::BIGINT END) SELECT n.step, n.centre, n.status, l.other FROM now_ n LEFT JOIN links l ON l.step = n.step AND l.centre = n.centre")
def gr_incident(s, d):
    """A timeline: the status of every centre at each step (the last one said), and the links that a step draws, '*' to all other centres."""
    n = table(s, d, "nation")
    k = F.col("n_nationkey")
    said = n.select(k.alias("centre"), F.col("n_regionkey").alias("at"), F.when(k % 3 == 0, "down").when(k % 3 == 1, "degraded").otherwise("up").alias("said"), F.when(k % 5 == 0, "*").otherwise(((k + 1) % 25).cast("string")).alias("to"))
    steps = F.broadcast(table(s, d, "region").select(F.col("r_regionkey").alias("step")))  # a timeline has few steps
    now = n.select(k.alias("centre")).crossJoin(steps).join(said.select("centre", "at", "said"), "centre", "left")
    now = now.select("step", "centre", F.when(F.col("at") <= F.col("step"), F.col("said")).otherwise("up").alias("status"))
    others = n.select(k.alias("other"))
    some = said.where("to <> '*'").select(F.col("at").alias("step"), "centre", F.col("to").cast("long").alias("other")).join(others, "other", "left_semi")
    fan = said.where("to = '*'").select(F.col("at").alias("step"), "centre").join(F.broadcast(others), F.col("centre") != F.col("other"))  # what the star asks for
    return now.join(some.unionByName(fan.select("other", "step", "centre")), ["step", "centre"], "left").select("step", "centre", "status", "other")
