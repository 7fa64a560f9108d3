import random

import numpy as np
from pyspark.sql import functions as F

from weftline.operators.redelivery import FAN, MessageIndex, _lowest, surplus

SCHEMA = "n long, b long, i string, p string, t double, d string, home string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(r.n for r in surplus(df, "n", F.col("i"), F.col("p"), F.round(F.col("t") * 1000), **kw).collect())


def brute(rows):
    norm = lambda s: None if s is None else s.strip(" ").lower()
    ms = lambda t: None if t is None else round(t * 1000)
    out = set()
    for n, _b, i, p, t, in rows:
        if i is not None:
            for m, _c, j, q, u in rows:
                near = ms(t) is None and ms(u) is None or (ms(t) is not None and ms(u) is not None and abs(ms(t) - ms(u)) <= 1000)
                if m < n and norm(i) == norm(j) and norm(p) == norm(q) and near:
                    out.add(n)
    return sorted(out)


def test_equals_brute_force(spark):
    rng, rows = random.Random(6), []
    for n in range(500):
        i = rng.choice([f"id{rng.randrange(40)}", " ID1 ", "id1", None, "", f"u{n}"])
        rows.append((n, n // 20, i, rng.choice(["p", "P ", None]), rng.choice([7200.0, 3599.8, 3600.4, 1.0, 1.9, None, rng.randrange(20_000) / 1.0])))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, slab_s=2) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, None, "p", 1.0), (2, 1, None, "p", 1.0)]) == []
    long = "x" * 100_000
    assert run(spark, [(5, 2, long, None, 0.0), (3, 1, long, None, 0.5), (4, None, long, None, 900.0)]) == [5]


def test_later_batches_are_held_against_earlier_ones(spark, tmp_path):
    rng, rows = random.Random(8), []
    for n in range(400):
        rows.append((n, n // 40, rng.choice([f"id{rng.randrange(30)}", " ID1 ", "", f"u{n}"]), rng.choice(["p", None]), rng.choice([7200.0, 7199.5, 1.0, 1.9, None, rng.randrange(9000) / 1.0])))
    path, got = f"file://{tmp_path}/index", []
    for b in range(10):  # more batches than runs of a level
        got += run(spark, rows[40 * b : 40 * b + 40], index=path)
    assert sorted(got) == brute(rows)
    version, runs = MessageIndex(spark, path).manifest()
    assert version == 10 and len(runs) < FAN and any(level for _, level in runs)
    kept = MessageIndex(spark, path).read([r for r, _ in runs])
    assert kept.distinct().count() == len({(i.strip(" ").lower(), p, t) for _, _, i, p, t in rows})
    # a batch that comes twice is surplus as a whole
    assert run(spark, rows[:40], index=path) == [r[0] for r in rows[:40]]


def test_an_identifier_with_very_many_times(spark):
    df = spark.range(60_000).selectExpr("id AS n", "'same' AS i", "'p' AS p", "id * 1001 AS t")
    assert surplus(df, "n", F.col("i"), F.col("p"), F.col("t")).count() == 0
    near = spark.range(60_000).selectExpr("id AS n", "'same' AS i", "'p' AS p", "id AS t")
    assert surplus(near, "n", F.col("i"), F.col("p"), F.col("t")).count() == 59_999


def test_busy_hours_are_cut_though_a_clock_is_wrong(spark, monkeypatch):
    from weftline.operators import redelivery

    rng = random.Random(9)
    rows = [(n, 0, f"id{rng.randrange(900)}", "p", 7200.0 + rng.randrange(50)) for n in range(1500)] + [(9000, 0, "id1", "p", -5e9), (9001, 0, "id1", "p", 4e9)]
    monkeypatch.setattr(redelivery, "PREFIX_ROWS", 100)
    assert run(spark, rows) == brute(rows)


def test_lowest_of_stretches():
    rng = np.random.default_rng(2)
    x, lo = rng.integers(0, 1000, 200), rng.integers(0, 199, 100)
    hi = np.minimum(lo + rng.integers(0, 120, 100), 200)
    assert _lowest(x, lo, hi).tolist() == [int(x[a:b].min()) if b > a else np.iinfo(np.int64).max for a, b in zip(lo, hi, strict=True)]
