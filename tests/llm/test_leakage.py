import random
import re

import numpy as np

from weftline.llm import leakage
from weftline.llm.leakage import leak_places, leaks, suffix_array, without_leaks, words_of_all

WORD = re.compile(r"[^\W_]+")


def run(spark, docs, items, words=4):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(*x, "clash") for x in items], "key long, text string, doc_id string")
    return {(r.doc_id, r.key): r.run for r in leaks(d, e, "doc_id", "text", "key", "text", words).collect()}


def brute(docs, items, words=4):
    out = {}
    for d, t in docs:
        a = WORD.findall((t or "").lower())
        for k, s in items:
            b = WORD.findall((s or "").lower())
            best, row = 0, [0] * (len(b) + 1)
            for x in a:
                row = [0] + [row[j] + 1 if x == b[j] else 0 for j in range(len(b))]
                best = max(best, *row)
            if best >= words:
                out[d, k] = max(best, out.get((d, k), 0))
    return out


def texts(n, seed, width):
    rng = random.Random(seed)
    join = lambda w: "".join(x.upper() + rng.choice([" ", "_", ", ", "\n", " - "]) if rng.random() < 0.3 else x + " " for x in w)
    return [(i, join([rng.choice(["a", "b", "ça", "Ünï", "9", "the"]) for _ in range(rng.randrange(width))])) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    docs, items = texts(60, 1, 60), texts(25, 2, 30)
    docs += [(900, None), (901, ""), (902, "_ - _"), docs[3]]
    items += [(900, None), (901, ""), items[2]]
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 200)  # several blocks
    assert run(spark, docs, items) == brute(docs, items)


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK_CHARS", 50)
    t = [x for _, x in texts(30, 5, 80)]
    whole = {i: len(h) for i, h in words_of_all(t)}
    assert [whole[i] for i in range(30)] == [len(WORD.findall(x.lower())) for x in t]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e")]) == {} and run(spark, [(1, "a b c d e")], []) == {}


def test_removal(spark):
    d = spark.createDataFrame([(1, "one two three four five"), (2, "other")], "doc_id long, text string")
    e = spark.createDataFrame([(7, "zero one TWO three-four")], "item_id long, text string")
    found = leaks(d, e, "doc_id", "text", "item_id", "text", 4)
    assert [r.doc_id for r in without_leaks(d, found, "doc_id").collect()] == [2]


def test_suffix_array_orders_by_depth():
    rng = np.random.default_rng(3)
    for n, k, depth in ((1, 1, 4), (50, 2, 12), (300, 3, 12), (300, 200, 5), (40, 1, 7)):
        s = rng.integers(0, k, n)
        s[-1] = 0
        got = [tuple(s[i : i + depth]) for i in suffix_array(s, depth)]
        pad = [g + (0,) * (depth - len(g)) for g in got]
        assert pad == sorted(pad)


def test_places_of_all_longest_runs(spark, monkeypatch):
    docs, items = texts(40, 7, 50), texts(15, 8, 30)
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "key long, text string")
    want, words = set(), 3
    for k, t in docs:
        a = WORD.findall(t.lower())
        for m, s in items:
            b = WORD.findall(s.lower())
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if n >= words:
                            want.add((k, m, i, j, n))
    for hits, block in ((4_000_000, 32 << 20), (37, 150)):  # few hits at a time, many blocks over written shards
        monkeypatch.setattr(leakage, "HITS", hits)
        monkeypatch.setattr(leakage, "BLOCK_BYTES", block)
        assert set(map(tuple, leak_places(d, e, "doc_id", "text", "key", "text", words).collect())) == want


def test_boilerplate_everywhere(spark):
    passage = " ".join(f"w{i}" for i in range(90))
    d = spark.createDataFrame([(k, f"{passage} x{k}") for k in range(3000)], "doc_id long, text string").coalesce(1)
    e = spark.createDataFrame([(k, f"y{k} {passage}") for k in range(60)], "key long, text string")
    got = leaks(d, e, "doc_id", "text", "key", "text")
    assert got.count() == 180_000 and got.agg({"run": "min"}).first()[0] == 90
