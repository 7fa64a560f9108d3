import numpy as np

from weftline.llm.packing import curve_keys, fill, fill_one, hilbert, pack, project, _sign_table


def packed(spark, rows, **kw):
    return pack(spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc long, body string, size string, curve string"), "doc", "body", **kw).toPandas()


def test_every_item_whole_once_and_no_overlap(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "é" * int(rng.integers(0, 40)) + "abc " * int(rng.integers(0, 60))) for i in range(800)]
    rows += [(900, None), (901, ""), (902, "z" * 1000), (903, "y" * 512), (904, "w" * 256), (1, rows[1][1])]
    p = packed(spark, rows, capacity=256)
    size = {}
    for d, t in rows:
        size.setdefault(d, []).append(len((t or "").encode()))
    for d, g in p.groupby("doc"):
        assert g.tokens.sum() == sum(size[d])
        if len(size[d]) == 1:
            assert sorted(g.piece) == list(range(len(g)))
            assert len(g) == max(1, -(-size[d][0] // 256))
    assert set(p.doc) == set(size)
    for _, g in p[p.tokens > 0].sort_values("offset").groupby("container"):
        ends = (g.offset + g.tokens).to_numpy()
        assert ends.max() <= 256 and (g.offset.to_numpy()[1:] >= ends[:-1]).all()


def test_little_room_is_lost(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "q" * int(rng.integers(1, 900))) for i in range(3000)]
    df = pack(spark.createDataFrame(rows, "doc long, body string"), "doc", "body", capacity=1024)
    assert fill(df, 1024).first().used > 0.97


def test_empty_table_and_given_sizes(spark):
    assert len(packed(spark, [])) == 0
    df = spark.createDataFrame([(1, "a", 5000), (2, "b", None)], "doc long, body string, n int")
    got = {(r.doc, r.piece): r.tokens for r in pack(df, "doc", "body", size="n").collect()}
    assert got == {(1, 0): 4096, (1, 1): 904, (2, 0): 0}


def test_hilbert_visits_every_cell_by_single_steps():
    for d, bits in ((2, 3), (3, 2), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        key = hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_like_texts_lie_near():
    t = _sign_table()
    data = np.frombuffer(("select from where group by order " * 30 + "der die das und nicht ist ein " * 30 + "select from where order by group " * 30).encode(), np.uint8)
    cut = np.array([0, 33 * 30, 33 * 30 + 30 * 30, len(data)])
    v = project(data, cut[:-1], cut[1:], t)
    assert np.linalg.norm(v[0] - v[2]) < np.linalg.norm(v[0] - v[1])


def test_one_container_is_filled_best():
    assert fill_one([6, 5, 4, 4], 10, 10) == [0, 2] and fill_one([2, 4, 4, 8], 10, 10) == [0, 1, 2] and fill_one([2, 3, 9, 8], 10, 10) == [0, 3]
    assert fill_one([3, 0, 3, 3, 9], 10, 10) == [0, 1, 2, 3]
    assert fill_one([11], 11, 11) == [0] and fill_one([0, 0], 10, 10) == [0, 1]
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = [int(x) for x in rng.integers(0, 30, 9)]
        taken = fill_one(sizes, 60, 60)
        best = max(sum(s for k, s in enumerate(sizes[1:]) if m >> k & 1) for m in range(256) if sizes[0] + sum(s for k, s in enumerate(sizes[1:]) if m >> k & 1) <= 60)
        assert sum(sizes[k] for k in taken) == sizes[0] + best and taken[0] == 0 and len(set(taken)) == len(taken)


def test_neighbours_on_the_curve_share_containers(spark):
    rng = np.random.default_rng(4)
    words = [f"{''.join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))} " for _ in range(60)]
    rows = []
    for i in range(4000):
        t = int(rng.integers(0, 12))
        rows.append((i, "".join(rng.choice(words[t * 5 : t * 5 + 5], int(rng.integers(5, 140))))))
    df = spark.createDataFrame(rows, "doc long, body string").coalesce(2)
    place = {k: i for i, k in enumerate(curve_keys(df, "doc", "body").orderBy("curve", "key").toPandas().key)}
    p = pack(df, "doc", "body", capacity=2048).toPandas()
    p["place"] = p.doc.map(place)
    spread = lambda q: q.groupby("container").place.agg(lambda x: x.max() - x.min()).mean()
    mixed = p.assign(container=rng.permutation(p.container.to_numpy()))
    assert spread(p) < 0.01 * spread(mixed)
    assert fill(spark.createDataFrame(p[["container", "tokens"]]), 2048).first().used > 0.97
