"""Prefixes of both families: the PoP feed's queries against plain Python."""

import ipaddress
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weftline.plans import relational, scalar

ROWS = [
    ("a", "10.1.2.0/24", "p"), ("a", "10.1.2.9/24", "p"), ("a", "10.0.0.0/15", "q"), ("a", "10.2.0.0/16", "q"), ("a", "10.3.0.0/24", ""),
    ("a", "2001:DB8:0::/48", "x"), ("a", "2001:db9::/32", "y"), ("a", "2001:db8:1::/48", "x"), ("a", "2001:db8::/40", None), ("a", "none", "z"),
    ("b", "2001:0db8::/48", "x"), ("b", " 2620:fe::/44 ", "y"), ("b", "10.1.2.0/24", "p"), ("b", "::/1", "q"), ("b", "0.0.0.0/1", "r"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("feed")
    snap, c0, c1 = zip(*ROWS, strict=True)
    pq.write_table(pa.table({"snap": snap, "line_no": list(range(len(ROWS))), "c0": c0, "c1": c1}), d / "pops.parquet")
    return str(d)


def nets(snaps="ab"):
    out = set()
    for snap, c0, _ in ROWS:
        try:
            out |= {ipaddress.ip_network(c0.strip(), strict=False)} if snap in snaps else set()
        except ValueError:
            pass
    return out


def in_order(these):
    return [str(n) for n in sorted(these, key=lambda n: (n.version, int(n.network_address), n.prefixlen))]


def test_cover(spark, folder):
    for skip in ((), ("::/1", "0.0.0.0/1")):
        rows = [n for n in nets() if str(n) not in skip]
        cut = [n.supernet(new_prefix=min(n.prefixlen, 16 if n.version == 4 else 32)) for n in rows]
        want = [str(n) for v in (4, 6) for n in ipaddress.collapse_addresses([n for n in cut if n.version == v])]
        p = spark.createDataFrame([(str(n),) for n in rows], "c0 string")
        from weftline.functions.net import cidr

        assert [r.prefix for r in relational.cover(p.select(cidr("c0").alias("p")).select("p.*")).collect()] == want
    assert {r.prefix for r in relational.set_cover(spark, folder).collect()} == {"0.0.0.0/1", "::/1"}


def test_deliveries(spark, folder):
    a, b = nets("a"), nets("b")
    got = relational.join_feed_any(spark, folder).collect()
    assert [(r.prefix, r.in_first, r.in_last) for r in got] == [(p, p in set(map(str, a)), p in set(map(str, b))) for p in in_order(a | b)]
    keys = sorted(relational.set_union_keys_any(spark, folder).collect(), key=lambda r: r.place)
    assert [(r.prefix, r.place) for r in keys] == [(p, i + 1) for i, p in enumerate(in_order(a | b))]


def test_keys_and_containment(spark, folder):
    got = {r.prefix: r.place for r in scalar.fn_prefix_key_any(spark, folder).collect()}
    assert got == {p: i + 1 for i, p in enumerate(in_order(nets()))}
    inside = Counter(str(w) for w in nets() for n in nets() if n.version == w.version and n.subnet_of(w))
    assert {r.prefix: r.inside for r in scalar.fn_contains_any(spark, folder).collect()} == inside


def test_covers(spark, folder):
    got = {(r.version, bytes(r.lo)[-4 if r.version == 4 else 0 :][:4].hex()): (r.inside, r.first_pop, r.pop) for r in relational.join_covers_any(spark, folder).collect()}
    assert got == {(4, "0a010000"): (1, "p", "p"), (4, "0a020000"): (1, "q", "q"), (4, "0a030000"): (1, "", None), (6, "20010db8"): (3, "x", "x"), (6, "20010db9"): (1, "y", "y"), (6, "262000fe"): (1, "y", "y")}


def test_ipv4_part_is_the_old_one(spark):
    from tests.oracle import FOLDER

    d = str(FOLDER)
    old = {(r.lo, r.plen): (r.inside, r.first_pop) for r in relational.join_covers(spark, d).collect()}
    assert {(int.from_bytes(r.lo[-4:], "big"), r.plen): (r.inside, r.first_pop) for r in relational.join_covers_any(spark, d).where("version = 4").collect()} == old
    rows = scalar.fn_contains_any(spark, d).where("version = 4 AND plen <= 27").collect()
    assert sorted(r.inside for r in rows) == sorted(r.inside for r in scalar.fn_contains(spark, d).collect())
