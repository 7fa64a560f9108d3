import random

from weftline.operators.late import corrected_aggregates, fates, first_copies, period_closes, seconds

SCHEMA = "m long, p long, e long, a long, rec long, v int, start string, close string"


def events(spark, rows):
    return first_copies(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), ["m", "p"], "e", "a", "rec", ["v"])


def brute(rows):
    s = lambda x: None if x is None else x // 10**9 if abs(x) >= 10**17 else x // 10**6 if abs(x) >= 10**14 else x // 1000 if abs(x) >= 10**11 else x
    first = {}
    for m, p, e, a, rec, _v in rows:
        if e is not None and a is not None:
            k = (m, p, s(e))
            first[k] = min(first.get(k, (s(a), rec)), (s(a), rec))
    out = []
    for (_m, _p, e), (a, rec) in first.items():
        behind = a - (e // 3600 * 3600 + 3600)
        if behind > 600:
            out.append((rec, "late" if behind <= 6 * 3600 else "cut"))
    return sorted(out)


def test_fates_equal_brute_force(spark):
    rng, rows, t0 = random.Random(4), [], 1_700_000_000
    for k in range(600):
        e = t0 + rng.randrange(20 * 3600)
        a = e + rng.choice([-300, 5, 60, 900, 4000, 9000, 40_000])
        rows.append((1, rng.choice([1, 1, 1, 2, 3, None]), e, a, k, k))
        if k % 9 == 0:
            rows.append((1, rows[-1][1], e * 1000, (a + 7000) * 1000, 10_000 + k, k))
    rows += [(1, 1, None, 5, 1, 1), (1, 1, 5, None, 1, 1), (1, 1, 77, t0, 90_000, 1), rows[0]]
    assert sorted((r.rec, r.fate) for r in fates(events(spark, rows), "p", hold=600, grace=600).select("rec", "fate").collect()) == brute(rows)


def walked(rows, idle, hold=None, tick=60, h=3600):
    """When each hour closes, by walking tick by tick through the arrivals."""
    f = [(p, e, a) for _m, p, e, a, *_ in rows if p is not None and e is not None and a is not None]
    closes = {}
    for end in range(min(a for *_, a in f) // h * h, max(a for *_, a in f) + 2 * h, h):
        out = end
        for s in {p for p, *_ in f}:
            at = sorted({a // tick * tick for p, _e, a in f if p == s})
            last = max((x for x in at if x < end), default=None)
            if last is None or last + tick + idle <= end:
                continue
            for x in at:
                if x > last and x < last + tick + idle:
                    last = x
            passed = min((a for p, e, a in f if p == s and e >= end and e <= a), default=10**18)
            out = max(out, min(passed, last + tick + idle, end + hold if hold is not None else 10**18))
        if out > end:
            closes[end - h] = -(-out // tick) * tick
    return closes


def test_closes_equal_a_walk_through_the_arrivals(spark):
    rng, rows, t0 = random.Random(6), [], 1_700_000_000
    for s in range(4):
        a = t0 + rng.randrange(4000)
        for k in range(150):
            a += rng.choice([5, 20, 60, 200, 400, 2000])
            rows.append((k, s, a - rng.choice([-50, 1, 10, 300, 4000, 9000]), a, k, k))
    ev = events(spark, rows)
    for hold in (None, 600):
        got = {r.start: r.close for r in period_closes(ev, "p", idle=300, hold=hold).collect()}
        want = walked(rows, 300, hold)
        assert {k: v for k, v in got.items() if v > k + 3600} == want and len(want) > 5


def test_a_source_that_lags_changes_a_record(spark):
    h = 3600
    rows = [(1, 1, h - 9, h - 5, 1, 1), (1, 1, h + 5, h + 30, 2, 1), (1, 2, h - 90, h - 20, 3, 1), (1, 3, h - 80, h + 200, 4, 1), (1, None, h - 70, h + 9000, 9, 1)]
    # source 2 was busy at the end and holds the hour until it is idle; source 3 comes in meanwhile
    assert {r.start: r.close for r in period_closes(events(spark, rows), "p", idle=300).collect()}[0] == h + 300
    assert sorted((r.rec, r.fate) for r in fates(events(spark, rows), "p", idle=300).collect()) == [(9, "late")]
    # it shows a later event: the hour closes at once, and the record of source 3 is diverted
    on = [*rows, (1, 2, h + 1, h + 50, 5, 1)]
    assert {r.start: r.close for r in period_closes(events(spark, on), "p", idle=300).collect()}[0] == h + 60
    assert sorted((r.rec, r.fate) for r in fates(events(spark, on), "p", idle=300).collect()) == [(4, "late"), (9, "late")]
    # so does a punctuation, which is a control record
    says = spark.createDataFrame([(2, h, h + 10)], "p long, bound_s long, arrival_s long")
    assert {r.start: r.close for r in period_closes(events(spark, rows), "p", idle=300, punctuations=says).collect()}[0] == h + 60
    assert sorted(r.rec for r in fates(events(spark, rows), "p", idle=300, punctuations=says).collect()) == [4, 9]
    agg = {r.start: r for r in corrected_aggregates(events(spark, rows), "p", "v", idle=300, punctuations=says).collect()}[0]
    assert (agg.close, agg.n_on_time, agg.n_late, agg.total_at_close, agg.total) == (h + 60, 2, 2, 2, 4)
    # a hold bounds what a lagging source can do
    assert {r.start: r.close for r in period_closes(events(spark, rows), "p", idle=300, hold=120).collect()}[0] == h + 120


def test_edges(spark):
    assert fates(events(spark, []), "p").count() == 0
    agg = corrected_aggregates(events(spark, [(1, 1, 10, 20, 1, 5), (1, 1, 11, 3600 + 700, 2, None), (1, 2, 12, 99_999, 3, 7)]), "p", "v").collect()
    assert [tuple(r) for r in agg] == [(0, 3600, 1, 1, 1, 5, 5, 5, 5)]
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (1_700_000_000_123_456_789,), (None,)], "t long")
    assert [r.s for r in df.select(seconds("t").alias("s")).collect()] == [1_700_000_000] * 4 + [None]


def test_stream_keeps_correcting(spark, tmp_path):
    from weftline.streaming import late

    schema = "event_s long, arrival_s long, p long, v int, start string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/progress"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    (tmp_path / "in").mkdir()
    late.follow(stream(), "p", "v", out, marks)
    assert late.merged(spark, out).count() == 0
    put([(10, 20, 1, 5, "x"), (3700, 3710, 1, 1, "x"), (None, 5, 1, 1, "x")])
    late.follow(stream(), "p", "v", out, marks)
    put([(11, 3600 + 700, 2, 7, "x"), (12, 99_999, 2, 9, "x"), (13, None, 2, 9, None)])
    late.follow(stream(), "p", "v", out, marks)
    got = {r.start: (r.n_on_time, r.n_late, r.n_cut, r.total, r.close) for r in late.merged(spark, out).collect()}
    assert got[0] == (1, 1, 1, 12.0, 3600) and got[3600][:2] == (1, 0)


def test_punctuations_in_a_stream(spark, tmp_path):
    from weftline.streaming import late

    h, schema = 3600, "event_s long, arrival_s long, p long, v int, bound long"
    (tmp_path / "in").mkdir()
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: late.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "p", "v", f"file://{tmp_path}/out", f"file://{tmp_path}/progress", "bound")
    put([(h - 9, h - 5, 1, 1, None), (h - 80, h + 200, 3, 1, None)])
    go()
    read = lambda: {r.start: (r.n_on_time, r.n_late, r.close) for r in late.merged(spark, f"file://{tmp_path}/out").collect()}
    assert read() == {0: (2, 0, h + 300)}
    put([(None, h + 20, 1, None, h)])
    go()
    assert read() == {0: (1, 1, h + 60)}
