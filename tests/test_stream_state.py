"""Keyed state of the streams over several micro-batches, against plain walks."""

import random

import pytest

from weftline.streaming import feed

SCHEMA = "id long, user long, kind string, at timestamp, extra string"


@pytest.fixture
def events():
    rng, t, out = random.Random(7), 1_700_000_000_000, []
    for i in range(400):
        t += rng.choice([10, 300, 900, 1100, 5000])
        out.append((i, rng.randrange(4), rng.choice(["view", "click", "error", "grant", "deny"]), t))
    return out


def streamed(spark, tmp_path, rows, operate, parts=4, **kw):
    """The operator's result over the rows in several batches of one stream."""
    (tmp_path / "in").mkdir(exist_ok=True)
    size = -(-len(rows) // parts) or 1
    for k in range(0, max(len(rows), 1), size):
        df = spark.createDataFrame([(i, u, kind, t, None) for i, u, kind, t in rows[k : k + size]], "id long, user long, kind string, t long, extra string")
        df.selectExpr("id", "user", "kind", "timestamp_millis(t) AS at", "extra").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return [tuple(r) for r in feed.run_to_table(operate(stream), "state", **kw).collect()]


def test_throttle(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda e: feed.throttled(e, "user", "at", 1000))
    want, last = [], {}
    for _i, u, _k, t in events:
        if u not in last or t - last[u] >= 1000:
            want.append((u, t))
            last[u] = t
    assert sorted(got) == sorted(want)


def test_newest_request_wins_while_busy(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda e: feed.coalesced(e, "user", "at", "id", 4000))
    want, free, waiting = [], {}, {}
    for i, u, _k, t in events:
        if u in waiting and t >= free[u]:
            want.append((u, waiting.pop(u)))
            free[u] += 4000
        if u not in free or t >= free[u]:
            want.append((u, i))
            free[u] = t + 4000
        else:
            waiting[u] = i
    assert sorted(got) == sorted(want) and len(want) < len(events)


def test_consent(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda e: feed.consent_queue(e, "user", "id", "kind = 'grant'", "kind = 'deny'", 2))
    want, allowed, queue = [], {}, {}
    for i, u, k, _t in events:
        if k == "grant":
            want += [(u, x) for x in queue.pop(u, [])]
            allowed[u] = True
        elif k == "deny":
            queue.pop(u, None)
            allowed[u] = False
        elif allowed.get(u):
            want.append((u, i))
        elif u not in allowed and len(queue.setdefault(u, [])) < 2:
            queue[u].append(i)
    assert sorted(got) == sorted(want)


def test_choice_is_held_until_it_is_gone(spark, tmp_path, events):
    from pyspark.sql import functions as F

    got = streamed(spark, tmp_path, events, lambda e: feed.held_choices(e.withColumn("gone", F.col("kind") == "error"), "user", "at", "id", "kind", "gone", 15_000, 12_000))
    want, state = [], {}
    for i, u, k, t in events:
        slot = (t - 12_000) // 15_000
        was, held = state.get(u, (None, None))
        held = held if was == slot else None
        held = None if k == "error" else held or k
        state[u] = (slot, held)
        want.append((u, i, slot, held))
    assert sorted(got) == sorted(want)


def test_stalls_and_rings(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda e: feed.stalls(e, "user", "at", "id", 8000))
    want, last = [], {}
    for i, u, _k, t in events:
        if u not in last:
            want.append((u, i, None, "open"))
        elif t - last[u] > 8000:
            want.append((u, i, t - last[u], "stalled"))
        last[u] = t
    assert sorted(got) == sorted(want)


def test_ring_of_each_kind(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda e: e.select("kind", "id"), each=feed.keep_newest("id", 5, "kind"))
    want = [(k, i) for k in {e[2] for e in events} for i in sorted((e[0] for e in events if e[2] == k), reverse=True)[:5]]
    assert sorted(got) == sorted(want)


def test_what_is_learnt_lets_later_rows_through(spark, tmp_path):
    rows = [(1, "p", "w", False, False), (2, "p", "a", False, True), (3, "p", "w", False, False), (4, "q", "w", False, False), (5, "q", "a", True, False), (6, "r", "w", False, False)]
    (tmp_path / "in").mkdir()
    schema = "n long, prefix string, kind string, via boolean, own boolean"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = feed.run_to_table(feed.kept_prefixes(stream(), "n"), "kept")
    assert sorted(r.n for r in out.collect()) == [2, 3, 5]
    listed = spark.createDataFrame([("r",), ("r",)], "prefix string")
    assert sorted(r.n for r in feed.run_to_table(feed.kept_prefixes(stream(), "n", listed), "kept").collect()) == [2, 3, 5, 6]


def test_sliding_counts(spark):
    rng = random.Random(3)
    secs = sorted(rng.sample(range(1000), 200))
    b = spark.createDataFrame([(x, rng.randrange(5)) for x in secs], "sec long, n long")
    held = {r.sec: r.n for r in b.collect()}
    got = {r.sec: r.n for r in feed.sliding_counts(b, ["n"]).collect()}
    assert got == {x: sum(held[y] for y in secs if x - 59 <= y <= x) for x in secs}


def test_empty_streams(spark, tmp_path):
    for k, operate in enumerate((lambda e: feed.throttled(e, "user", "at"), lambda e: feed.coalesced(e, "user", "at", "id", 10), lambda e: feed.consent_queue(e, "user", "id", "false", "false"), lambda e: feed.stalls(e, "user", "at", "id", 5))):
        (tmp_path / str(k)).mkdir()
        assert streamed(spark, tmp_path / str(k), [], operate) == []
