import json
import random

from weftline.operators.nested import Field, Table, flat_table, flat_tables, triples

FIELDS = [Field("hop", "[].hop", "int"), Field("addr", "[].result[].from"), Field("rtt", "[].result[].rtt", "double")]


def replies(spark, rows, **kw):
    df = spark.createDataFrame(rows, "rec_id long, result string, hop string, rtt string")
    out = flat_table(df, ["rec_id"], "result", "[].result[]", FIELDS, ["hop_pos", "reply_pos"], wrapper="result", **kw)
    return sorted(map(tuple, out.collect()), key=repr)


def test_shapes_and_damage(spark):
    good = [{"hop": 1, "result": [{"from": "a", "rtt": 1}, None, {"from": "b", "rtt": "2.5"}]}, None, {"hop": "3", "result": {"from": "c", "rtt": -1}}, {"result": [{"x": "*"}]}]
    texts = [json.dumps(good), json.dumps({"result": good}), json.dumps(json.dumps(good)), json.dumps(good)[:-3], "", None, "null", "[NaN]", "[" * 20_000, "7", '"text"', "[]"]
    want = [(1, 0, 0, 1, "a", 1.0), (1, 0, 2, 1, "b", 2.5), (1, 2, 0, 3, "c", -1.0), (1, 3, 0, None, None, None)]
    got = replies(spark, [(i + 1, t, "clash", "clash") for i, t in enumerate(texts)])
    assert got == sorted([(k, *w[1:]) for k in (1, 2, 3) for w in want], key=repr)


def test_null_entries_can_be_kept(spark):
    t = json.dumps([{"hop": 1, "result": [None, {"from": "a", "rtt": 1}]}])
    assert replies(spark, [(1, t, None, None)], keep_empty=True) == sorted([(1, 0, 0, 1, None, None), (1, 0, 1, 1, "a", 1.0)], key=repr)


def test_empty_table_repeated_rows_and_long_text(spark):
    assert replies(spark, []) == []
    t = json.dumps([{"hop": h, "result": [{"from": "x" * 50, "rtt": h}] * 40} for h in range(400)])
    got = replies(spark, [(1, t, None, None), (1, t, None, None)])
    assert len(got) == 2 * 400 * 40 and len(set(got)) == 400 * 40


def test_against_plain_walk(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(200):
        hops = []
        for p in range(rng.randrange(5)):
            res = [rng.choice([None, {"x": "*"}, {"from": "", "rtt": 2.0}, {"from": f"h{p}", "rtt": rng.choice([1.5, "7", "n/a", None, True])}]) for _ in range(rng.randrange(4))]
            hops.append(rng.choice([None, {"hop": p, "result": res}, {"hop": p, "error": "e"}]))
            if isinstance(hops[-1], dict):
                for q, r in enumerate(hops[-1].get("result", [])):
                    if isinstance(r, dict):
                        v = r.get("rtt")
                        v = None if v is True or v == "n/a" or v is None else float(v)
                        want.append((k, p, q, p, r.get("from"), v))
        rows.append((k, json.dumps(hops), None, None))
    assert replies(spark, rows) == sorted(want, key=repr)


def test_triples_round_trip(spark):
    doc = {"a": [{"b": 1, "c": [True, None]}, {"b": "x"}], "d": 2.5}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None)], "k long, t string")
    got = {(r.path, tuple(r.ordinals)): r.value for r in triples(df, ["k"], "t").collect()}
    assert got == {("a[].b", (0,)): "1", ("a[].c[]", (0, 0)): "true", ("a[].c[]", (0, 1)): None, ("a[].b", (1,)): "x", ("d", ()): "2.5"}


def test_members_given_twice_late_numbers_and_odd_shapes(spark):
    texts = [
        '[{"result":[{"from":"a","rtt":1},{"from":"b","rtt":2}],"result":[{"from":"c","rtt":3,"rtt":4}],"hop":9}]',  # the last member holds; the number comes after the list
        '[{"hop":1,"result":"[{\\"from\\":\\"q\\\\u00e9\\",\\"rtt\\":1}]"},{"hop":2,"result":"[broken"},[1],3,"x",{}]',
        '[{"hop":01}]',
        '[{"hop":1,}]',
        '[{"hop":1}] x',
        '[{"hop":1.0,"result":[{"from":{"x":1},"rtt":[2]},{"from":5,"rtt":true}]}]',
    ]
    got = replies(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    want = [(0, 0, 0, 9, "c", 4.0), (1, 0, 0, 1, "q\u00e9", 1.0), (5, 0, 0, 1, None, None), (5, 0, 1, 1, "5", None)]
    assert got == sorted(want, key=repr)


def test_damage_at_every_place_is_judged_as_a_decoder_does(spark):
    good = json.dumps([{"hop": 1, "result": [{"from": "a\\u00e9", "rtt": 1.5e1}, {"x": "*"}]}, None, {"hop": 2, "error": "e", "result": []}])
    rng, texts = random.Random(5), []
    for k in range(400):
        t, p = list(good), rng.randrange(len(good))
        t[p : p + rng.randrange(3)] = rng.choice(["", "x", '"', "[", "]", "{", "}", ",", ":", "0", "\\", "\x01", " "])
        texts.append("".join(t))

    def valid(t):
        try:
            return isinstance(json.loads(t, parse_constant=lambda c: 1 / 0), (dict, list))
        except (ValueError, ZeroDivisionError):
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k for r in triples(df, ["k"], "t").collect()}
    want = {k for k, t in enumerate(texts) if valid(t)}
    assert got == want and 20 < len(want) < 380


def test_tables_of_one_pass_are_linked(spark):
    doc = [{"hop": 1, "result": [{"from": "a", "rtt": 1}]}, {"hop": 2, "error": "e"}]
    df = spark.createDataFrame([(1, json.dumps(doc))], "k long, t string")
    hops = Table("hops", "[]", (Field("hop", "[].hop", "int"), Field("error", "[].error")), ("h",))
    out = flat_tables(df, ["k"], "t", [hops, Table("replies", "[].result[]", (Field("addr", "[].result[].from"),), ("h", "r"))])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("hops", 1, 0, None, 1, None, None), ("hops", 1, 1, None, 2, "e", None), ("replies", 1, 0, 0, None, None, "a")], key=repr)
