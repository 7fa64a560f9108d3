import random

import numpy as np

from weftline.operators.snapshots import Bitmap, assign_ordinals, canonical_prefix, snapshot_changes, with_canonical_prefix

SCHEMA = "snap string, line_no long, c0 string, c1 string, c2 string, change string, bucket string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, snapshot_changes(df, "snap", "c0", ["c1", "c2"], "line_no", **kw).collect()))


def brute(rows):
    held = {}
    for s, n, k, *v in rows:
        if s is not None and k is not None:
            held.setdefault(s, {})
            at = (n if n is not None else 1 << 63,)
            if k not in held[s] or at < held[s][k][0]:
                held[s][k] = (at, v)
    out, names = [], sorted(held)
    for a, b in zip(names, names[1:], strict=False):
        x, y = held[a], held[b]
        out += [(b, k, "added") for k in y.keys() - x.keys()] + [(b, k, "removed") for k in x.keys() - y.keys()]
        out += [(b, k, "changed") for k in x.keys() & y.keys() if x[k][1] != y[k][1]]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for s in ("s1", "s2", "s3", "s4"):
        for n in range(120):
            rows.append((s, n, f"k{rng.randrange(90)}", rng.choice(["a", "b", None]), rng.choice(["x", None])))
    rows += [("s1", 1, None, "a", "a"), (None, 1, "k1", "a", "a"), ("s2", None, "only", "a", None)]
    for bucket in (8, 1000):
        assert run(spark, rows, bucket=bucket) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [("s1", 1, "k", "a", "b")]) == []
    same = [("s1", 1, "k", None, "b"), ("s2", 9, "k", None, "b"), ("s2", 9, "k", None, "b")]
    assert run(spark, same) == []
    long = "k" * 100_000
    assert run(spark, [("s1", 1, long, "", None), ("s2", 1, "z", None, None)]) == sorted([("s2", long, "removed"), ("s2", "z", "added")])


def test_ordinals_persist(spark):
    first = assign_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string"), "k", bucket=10)
    kept = {r.key: (r.bucket, r.ordinal) for r in first.collect()}
    more = assign_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(30, 90)], "k string"), "k", known=first, bucket=10)
    now = {r.key: (r.bucket, r.ordinal) for r in more.collect()}
    # the ordinals stay, the buckets are split as the keys grow
    assert len(set(now.values())) == 90 and all(now[k][1] == v[1] for k, v in kept.items()) and len({b for b, _ in now.values()}) > len({b for b, _ in kept.values()})


def test_bitmaps_are_sets_and_small():
    rng = random.Random(4)
    for most, n in ((50, 20), (200_000, 300), (70_000, 60_000), (10**9, 5000)):
        a, b = ({rng.randrange(most) for _ in range(n)} for _ in range(2))
        x, y = Bitmap.of(np.array(sorted(a))), Bitmap.of(np.array(sorted(b)))
        assert (x & y).members().tolist() == sorted(a & b) and x.and_not(y).members().tolist() == sorted(a - b)
        assert Bitmap.from_bytes(x.to_bytes()).members().tolist() == sorted(a)
        assert len(x.to_bytes()) <= min(2 * len(a), 8192 * (most // 65_536 + 1)) + 16 * len(x.parts)
    assert Bitmap.of(np.zeros(0, int)).members().tolist() == [] and Bitmap.from_bytes(b"").parts == {}


def test_deliveries_of_later_calls_follow(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{s}", n, f"k{rng.randrange(60 + 60 * s)}", rng.choice(["a", None]), "x") for s in range(6) for n in range(40 + 40 * s)]
    rows += [("s3", 999, "gone", "a", "a")]
    state = f"file://{tmp_path}/state"
    got = []
    for part in (("s0", "s1"), ("s2",), ("s3",), ("s4", "s5")):  # keys grow, so buckets are split on the way
        got += run(spark, [r for r in rows if r[0] in part], state=state, bucket=32)
    assert sorted(got) == brute(rows)


def test_canonical_prefixes(spark):
    cases = {" 10.1.2.3/24 ": "10.1.2.0/24", "2001:DB8:0:0::1/48": "2001:db8::/48", "10.0.0.0": None, "999.1.1.1/8": None, "10.0.0.0/60": None, "": None, None: None, "prefix": None}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.k for r in with_canonical_prefix(df, "c", "k").collect()} == cases
    assert canonical_prefix("0.0.0.0/0") == "0.0.0.0/0"
