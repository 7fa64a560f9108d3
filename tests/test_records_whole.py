"""Records are of every node, with every prefix, site and PoP: small made-up tables, and the same SQL over them."""

import duckdb
import pytest

from tests import oracle
from weftline.plans import graphs

TABLES = {
    "region": "SELECT k::INT AS r_regionkey, 'R' || k AS r_name FROM range(2) t(k)",
    "nation": "SELECT k::INT AS n_nationkey, 'N' || k AS n_name, (k % 2)::INT AS n_regionkey FROM range(7) t(k)",
    "supplier": "SELECT k AS s_suppkey, 'S' || k AS s_name, 0::INT AS s_nationkey FROM range(1, 3) t(k)",
    "customer": "SELECT k AS c_custkey, 'C' || k AS c_name, (k % 7)::INT AS c_nationkey FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 82]) AS k)",
    # six ranges of 16 order numbers begin with an order of customer 82, so they are of network 83, which is supplier 1's
    "orders": "SELECT k * 4 AS o_orderkey, CASE WHEN k < 24 AND k % 4 = 0 THEN 82 ELSE k % 7 + 1 END AS o_custkey FROM range(48) t(k)",
    # each supplier sells to customers in all seven nations; supplier 9 isn't in its table
    "lineitem": "SELECT k * 4 AS l_orderkey, CASE WHEN k = 5 THEN 9 ELSE k % 2 + 1 END AS l_suppkey, CASE WHEN k = 5 THEN 9000.0 ELSE 100.0 + k END AS l_extendedprice FROM range(48) t(k)",
}


@pytest.fixture
def folder(tmp_path, monkeypatch):
    con = duckdb.connect()
    for name, sql in TABLES.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path / name}.parquet' (FORMAT parquet)")
    monkeypatch.setattr(oracle, "FOLDER", tmp_path)
    return tmp_path


def test_every_node_with_whole_lists(spark, folder):
    rows = [r.asDict() for r in graphs.QUERIES["agg_info_record"](spark, str(folder)).collect()]
    assert sorted((r["kind"], r["asn"]) for r in rows) == sorted([("region", k) for k in range(2)] + [("nation", k) for k in range(7)] + [("supplier", k) for k in (1, 2, 9)] + [("customer", k) for k in (*range(1, 8), 82)])
    fields = "asn name as_name country addrs nprefix prefixes sites pops concentration pinned degree providers customers peers cone coreness rank level city region routers router_links"
    assert len(fields.split()) == 23 and set(fields.split()) <= set(rows[0])
    at = {(r["kind"], r["asn"]): r for r in rows}
    for r in rows:
        assert len(r["prefixes"].split()) == r["nprefix"] and r["addrs"] == 16 * r["nprefix"]
    assert at["supplier", 1]["prefixes"] == "0 16 32 48 64 80"
    for k in (1, 2):
        sites, pops = at["supplier", k]["sites"].split(), at["supplier", k]["pops"].split()
        assert sorted(x.split(",")[3] for x in sites) == sorted(x.split(":")[0] for x in pops) == [f"C{n}" for n in range(7)]
    assert at["supplier", 9]["name"] == "AS9"  # in no table but the goods
    n = at["nation", 0]
    assert (n["city"], n["region"], n["routers"]) == ("N0", "R0", 1)
    assert n["router_links"] == sum(at["nation", k]["router_links"] for k in range(1, 7)) > 0


def test_as_sql(spark, folder):
    oracle.same(spark, oracle.connect(), graphs.QUERIES["agg_info_record"], graphs.SQL["agg_info_record"])
