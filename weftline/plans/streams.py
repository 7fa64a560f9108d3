"""Queries that run a stream over a table and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.tables import table
from weftline.streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _events(s, d):
    return feed.table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_NTZ = lambda c: F.col(c).cast("timestamp_ntz")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumbling(s, d):
    out = feed.run_to_table(_events(s, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")), "tumbling", "complete")
    return out.select(_NTZ("window.start").alias("start"), "event_type", "n")


@query("WITH k AS (SELECT unnest([0, 15, 30, 45]) AS m), w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(m) AS start FROM events, k) SELECT start, count(*) AS n FROM w GROUP BY 1")
def st_sliding(s, d):
    out = feed.run_to_table(feed.rates(_events(s, d), "ts", "1 hour", "15 minutes"), "sliding", "complete")
    return out.select(_NTZ("window.start").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k")
def st_session(s, d):
    out = feed.run_to_table(_events(s, d).groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")), "session", "complete")
    return out.select("user_id", _NTZ("session_window.start").alias("start"), "n")


@query("SELECT DISTINCT data.id AS id, data.peer AS peer FROM ris_frames WHERE data.id IS NOT NULL")
def st_dedup(s, d):
    """Identifiers once each: all deliveries lie within the watermark's delay here."""
    f = feed.table_stream(s, d, "ris_frames").where("data.id IS NOT NULL").select("data.id", "data.peer", "received_at").withWatermark("received_at", "400 days")
    return feed.run_to_table(feed.first_deliveries(f, ["id", "peer"]).select("id", "peer"), "dedup")


_BUCKETS = "b AS (SELECT floor(epoch_ms(received_at) / 1000)::BIGINT AS sec, max(epoch_ms(received_at)) AS now, count(*) AS frames, count(*) FILTER (data.type = 'UPDATE') AS updates, coalesce(sum(len(flatten(list_transform(data.announcements, lambda x: x.prefixes)))), 0)::BIGINT AS announces, coalesce(sum(len(data.withdrawals)), 0)::BIGINT AS withdraws FROM ris_frames WHERE received_at IS NOT NULL GROUP BY 1)"


@query(f"WITH {_BUCKETS}, t AS (SELECT sec, now, sum(frames) OVER w AS frames, sum(updates) OVER w AS updates, sum(announces) OVER w AS announces, sum(withdraws) OVER w AS withdraws FROM b WINDOW w AS (ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT sec, frames::BIGINT AS frames, updates::BIGINT AS updates, announces::BIGINT AS announces, withdraws::BIGINT AS withdraws, floor(frames * 60000.0 / least(60000, greatest(now - (SELECT min(epoch_ms(received_at)) FROM ris_frames), 1000)) * 1000 + 0.5) / 1000 AS per_minute FROM t")
def st_rate(s, d):
    """Four counters over the last sixty seconds, in buckets of a second that the stream keeps; scaled to a minute while it has run for less."""
    f = feed.table_stream(s, d, "ris_frames").where("received_at IS NOT NULL")
    said = F.coalesce(F.size(F.flatten(F.transform("data.announcements", lambda a: a["prefixes"]))), F.lit(0))
    gone = F.coalesce(F.size("data.withdrawals"), F.lit(0))
    b = f.groupBy(F.floor(F.unix_millis("received_at") / 1000).cast("long").alias("sec")).agg(F.max(F.unix_millis("received_at")).alias("now"), F.min(F.unix_millis("received_at")).alias("since"), F.count("*").alias("frames"), F.count_if(F.coalesce(F.col("data.type") == "UPDATE", F.lit(False))).alias("updates"), F.sum(F.greatest(said, F.lit(0))).alias("announces"), F.sum(F.greatest(gone, F.lit(0))).alias("withdraws"))
    out = feed.run_to_table(b, "rate", "complete")
    since = F.broadcast(out.agg(F.min("since").alias("start")))
    t = feed.sliding_counts(out, ["frames", "updates", "announces", "withdraws"]).join(out.select("sec", "now"), "sec").crossJoin(since)
    span = F.least(F.lit(60_000), F.greatest(F.col("now") - F.col("start"), F.lit(1000)))
    return t.select("sec", "frames", "updates", "announces", "withdraws", (F.floor(F.col("frames") * 60000.0 / span * 1000 + 0.5) / 1000).alias("per_minute"))


_VIA = "list_contains(list_transform(coalesce(data.path, []), lambda h: h = '4200000372' OR list_contains(string_split(regexp_replace(h, '[{} ]', '', 'g'), ','), '4200000372')), true)"
_PREFIXES = f"u AS (SELECT delivery_id, {_VIA} AS via, coalesce(data.path[-1] = '4200000372', false) AS own, flatten(list_transform(coalesce(data.announcements, []), lambda a: coalesce(a.prefixes, []))) AS ann, coalesce(data.withdrawals, []) AS wd FROM ris_frames WHERE frame_type = 'ris_message' AND data.type = 'UPDATE'), r AS (SELECT delivery_id, via, own, 'a' AS kind, unnest(ann) AS prefix FROM u UNION ALL SELECT delivery_id, via, own, 'w', unnest(wd) FROM u), listed AS (SELECT DISTINCT trim(c0) AS prefix FROM pops WHERE snap = (SELECT max(snap) FROM pops)), first AS (SELECT prefix, min(delivery_id) AS at_ FROM r WHERE own AND kind = 'a' GROUP BY 1), kept AS (SELECT r.delivery_id, r.prefix, kind, via FROM r LEFT JOIN first f ON f.prefix = r.prefix LEFT JOIN listed l ON l.prefix = r.prefix WHERE r.prefix IS NOT NULL AND (kind = 'a' AND via OR coalesce(r.delivery_id >= f.at_, false) OR l.prefix IS NOT NULL))"


def _kept(s, d, ours: bool):
    p = table(s, d, "pops")
    listed = p.join(F.broadcast(p.agg(F.max("snap").alias("snap"))), "snap").select(F.trim("c0").alias("prefix"))
    rows = feed.prefix_events(feed.table_stream(s, d, "ris_frames"), "delivery_id", "4200000372")
    return feed.run_to_table(feed.kept_prefixes(rows, "delivery_id", listed if ours else None), "parse")


@query(f"WITH {_PREFIXES} SELECT delivery_id, via, count(*) FILTER (kind = 'a') AS announced, count(*) FILTER (kind = 'w') AS withdrawn FROM kept GROUP BY 1, 2")
def st_parse(s, d):
    """Updates decoded from frames: announcements through one network or of our prefixes, withdrawals of ours; ours are the feed's and those it originated."""
    k = _kept(s, d, True)
    return k.groupBy("delivery_id", "via").agg(F.count_if(F.col("kind") == "a").alias("announced"), F.count_if(F.col("kind") == "w").alias("withdrawn"))


@query(f"WITH {_PREFIXES} SELECT r.delivery_id, r.prefix, kind, via FROM r LEFT JOIN first f ON f.prefix = r.prefix WHERE r.prefix IS NOT NULL AND (kind = 'a' AND via OR coalesce(r.delivery_id >= f.at_, false))")
def st_seen(s, d):
    """The growing set of originated prefixes at work: what it has learnt lets later rows of a prefix through."""
    return _kept(s, d, False)


@query(f"WITH cover AS (SELECT DISTINCT string_split(trim(c0), '.')[1] || '.' || string_split(trim(c0), '.')[2] AS p16 FROM pops WHERE trim(c0) NOT LIKE '%:%' AND snap = (SELECT max(snap) FROM pops)), f AS (SELECT delivery_id, {_VIA} AS via, list_distinct(list_transform(list_filter(coalesce(data.withdrawals, []), lambda w: w NOT LIKE '%:%'), lambda w: string_split(w, '.')[1] || '.' || string_split(w, '.')[2])) AS gone FROM ris_frames WHERE frame_type = 'ris_message') SELECT delivery_id FROM f WHERE via OR len(list_intersect(gone, (SELECT list(p16) FROM cover))) > 0")
def st_subscribe(s, d):
    """The subscription's filter, at the scan: paths through a network, and withdrawals below the covering /16 of our prefixes."""
    p = table(s, d, "pops")
    latest = p.join(F.broadcast(p.agg(F.max("snap").alias("snap"))), "snap").select(F.trim("c0").alias("c0")).where(~F.contains("c0", F.lit(":")))
    first = lambda c: F.substring_index(c, ".", 2)
    cover = latest.select(first("c0").alias("p16")).distinct()  # at most 65,536
    f = feed.table_stream(s, d, "ris_frames").where(F.col("frame_type") == "ris_message")
    path = F.coalesce(F.col("data.path"), F.array().cast("array<string>"))
    via = F.exists(path, lambda h: (h == "4200000372") | F.array_contains(F.split(F.regexp_replace(h, "[{} ]", ""), ","), "4200000372"))
    gone = F.array_distinct(F.transform(F.filter(F.coalesce("data.withdrawals", F.array().cast("array<string>")), lambda w: ~F.contains(w, F.lit(":"))), first))
    lists = cover.agg(F.collect_set("p16").alias("cover"))
    hit = f.select("delivery_id", via.alias("via"), gone.alias("gone")).crossJoin(F.broadcast(lists)).where(F.col("via") | F.arrays_overlap("gone", "cover"))
    return feed.run_to_table(hit.select("delivery_id"), "subscribe")


@query()
def st_throttle(s, d):
    """At most one event of a type each second, the first allowed."""
    return feed.run_to_table(feed.throttled(_events(s, d), "event_type", "ts", 1000), "throttle")


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 200")
def st_ring(s, d):
    out = feed.run_to_table(_events(s, d).select("event_id", "value"), "ring", each=feed.keep_newest("event_id", 200))
    return out.select("event_id", "value")


@query("WITH o AS (SELECT user_id, event_id, event_type, floor((epoch_ms(ts) - 900000 * 0.8) / 900000)::BIGINT AS slot, event_type = 'error' AS gone FROM events), g AS (SELECT *, sum(gone::INT) OVER (PARTITION BY user_id, slot ORDER BY event_id) AS k FROM o) SELECT user_id, event_id, slot, CASE WHEN NOT gone THEN first_value(event_type) OVER (PARTITION BY user_id, slot, k, gone ORDER BY event_id) END AS held FROM g")
def st_slot_hold(s, d):
    """What each user is served by: a choice held for its slot, here of a quarter of an hour, until an error drops it."""
    e = _events(s, d).withColumn("gone", F.col("event_type") == "error")
    return feed.run_to_table(feed.held_choices(e, "user_id", "ts", "event_id", "event_type", "gone", 900_000, 720_000), "hold")


@query("SELECT time_bucket(INTERVAL 15 SECOND, ts, TIMESTAMP '2024-01-01 00:00:12') AS start, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def st_slot_cache(s, d):
    """What is recomputed once for each 15 second slot, whose starts lie at 12, 27, 42 and 57 seconds."""
    w = F.window("ts", "15 seconds", "15 seconds", "12 seconds")
    out = feed.run_to_table(_events(s, d).groupBy(w).agg(F.count("*").alias("n"), F.max("value").alias("most")), "slots", "complete")
    return out.select(_NTZ("window.start").alias("start"), "n", "most")


@query()
def st_coalesce(s, d):
    """Requests of each user that are run when each keeps it busy for an hour: of those that wait the newest wins."""
    return feed.run_to_table(feed.coalesced(_events(s, d), "user_id", "ts", "event_id", 3_600_000), "coalesce")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 600")
def st_perf_ring(s, d):
    """The newest six hundred records of each kind."""
    e = _events(s, d).select("event_type", "event_id")
    return feed.run_to_table(e, "rings", each=feed.keep_newest("event_id", 600, "event_type")).select("event_type", "event_id")


@query("SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 1 HOUR")
def st_view_frames(s, d):
    """Views and the clicks within an hour after them, joined as two streams."""
    e = _events(s, d).select("event_id", "user_id", "ts", "event_type")
    v = e.where("event_type = 'view'").withWatermark("ts", "400 days")
    c = e.where("event_type = 'click'").withWatermark("ts", "400 days")
    j = feed.matched(v, c, "user_id", "ts", "1 HOUR").select(F.col("a.event_id").alias("view_id"), F.col("b.event_id").alias("click_id"))
    return feed.run_to_table(j, "matched")


@query("WITH f AS (SELECT data.host AS host, delivery_id, epoch_ms(received_at) AS t FROM ris_frames WHERE data.host IS NOT NULL AND received_at IS NOT NULL), g AS (SELECT *, max(t) OVER (PARTITION BY host ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f) SELECT host, delivery_id, t - last AS gap, CASE WHEN last IS NULL THEN 'open' ELSE 'stalled' END AS state FROM g WHERE last IS NULL OR t - last > 3600000")
def st_stall(s, d):
    """The watchdog of each collector's connection: where it opened and where it had been silent for more than an hour."""
    f = feed.table_stream(s, d, "ris_frames").where("data.host IS NOT NULL").select("data.host", "received_at", "delivery_id")
    return feed.run_to_table(feed.stalls(f, "host", "received_at", "delivery_id", 3_600_000), "stall")


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 1 WHEN event_type = 'error' AND event_id % 3 = 0 THEN -1 ELSE 0 END AS said FROM events), w AS (SELECT *, last_value(nullif(said, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS now, row_number() OVER (PARTITION BY user_id, said = 0 ORDER BY event_id) AS k FROM e), f AS (SELECT user_id, arg_min(said, event_id) AS first FROM e WHERE said <> 0 GROUP BY 1) SELECT user_id, event_id FROM w LEFT JOIN f USING (user_id) WHERE said = 0 AND (now = 1 OR now IS NULL AND first = 1 AND k <= 100)")
def st_queue(s, d):
    """Events that are sent: a hundred wait for consent at most, a grant sends them, a denial drops them."""
    third = "event_type = '{}' AND event_id % 3 = 0"
    return feed.run_to_table(feed.consent_queue(_events(s, d), "user_id", "event_id", third.format("signup"), third.format("error")), "queue")
