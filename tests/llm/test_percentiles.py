import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.percentiles import counted_runs, group_percentiles

QS = [0.0, 0.05, 0.5, 0.95, 1.0]


def run(df):
    return {tuple(r[:-2]): (r.n, list(r["at"])) for r in group_percentiles(df, ["a", "b"], "v", QS).collect()}


def brute(rows):
    held = {}
    for a, b, v, *_ in rows:
        if v is not None and np.isfinite(v):
            held.setdefault((a, b), []).append(v)
    return {k: (len(v), np.quantile(v, QS)) for k, v in held.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, (n, q) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], q, rtol=1e-12)


def test_equals_numpy_with_hot_group_over_many_partitions(spark):
    rng, rows = random.Random(1), []
    for i in range(20_000):
        hot = rng.random() < 0.6
        rows.append((7 if hot else rng.choice([None, *range(40)]), "h" if hot else rng.choice(["x", "", None]), rng.choice([rng.gauss(50, 9), 3.0, None, float("nan"), float("inf")]), "clash"))
    df = spark.createDataFrame(rows, "a int, b string, v double, part string")
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            same(run(df), brute(rows))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_days_combine(spark):
    rows = [(i % 3, "x", float(i * 37 % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, v double")
    days = [counted_runs(df.where(F.col("v") % 2 == k), ["a", "b"], "v") for k in (0, 1)]
    both = group_percentiles(days[0].unionByName(days[1]), ["a", "b"], "v", QS, "w")
    same({tuple(r[:-2]): (r.n, list(r["at"])) for r in both.collect()}, brute(rows))


def test_one_value_ten_million_times(spark):
    df = spark.range(10_000_000, numPartitions=8).selectExpr("1 AS a", "'x' AS b", "IF(id = 77, 9.0, 5.0) AS v")
    assert run(df) == {(1, "x"): (10_000_000, [5.0, 5.0, 5.0, 5.0, 9.0])}
    assert counted_runs(df, ["a", "b"], "v").count() < 100


def test_long_groups_go_out_as_they_come(spark, monkeypatch):
    from weftline.llm import percentiles

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice("xy"), round(rng.gauss(0, 9), 2)) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "a int, b string, v double")
    for held in (1, 50, 3000):
        monkeypatch.setattr(percentiles, "ROWS_HELD", held)
        same(run(df), brute(rows))


def test_weights(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 3), (1, "x", 2.0, 1), (1, "x", 9.0, 0), (1, "x", 9.0, None)], "a int, b string, v double, k int")
    assert [tuple(r) for r in group_percentiles(df, ["a", "b"], "v", [0.5, 1.0], "k").collect()] == [(1, "x", 4, [1.0, 2.0])]


def test_edges(spark):
    schema = "a int, b string, v double"
    assert run(spark.createDataFrame([], schema)) == {}
    assert run(spark.createDataFrame([(1, "x", None), (1, "x", float("nan"))], schema)) == {}
    assert run(spark.createDataFrame([(1, "x" * 50_000, 4.0)] * 3, schema)) == {(1, "x" * 50_000): (3, [4.0] * 5)}


def test_any_key_names(spark):
    df = spark.createDataFrame([(1, "a", 5, 2.0, 9), (1, "a", 5, 4.0, 9), (2, None, 5, 1.0, 9)], "part int, end string, idx int, v double, n int")
    got = group_percentiles(df, ["part", "end", "idx"], "v", [0.5])
    assert got.columns == ["part", "end", "idx", "n", "at"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", 5, 2, [3.0]), (2, None, 5, 1, [1.0])]
