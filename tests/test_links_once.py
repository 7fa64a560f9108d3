"""Queries over the links make them from the tables once, however often they read them: counted are the scans of lineitem in all they run."""

import pytest

from tests import oracle
from weftline.operators import graph
from weftline.plans import graphs

pytestmark = pytest.mark.skipif(not oracle.FOLDER.exists(), reason="no test tables")


def scans(monkeypatch, spark, name):
    plans, staged = [], graph.staged
    keep = lambda df, name: plans.append(df) or staged(df, name)
    for module in (graph, graphs):
        monkeypatch.setattr(module, "staged", keep, raising=False)
    plans.append(graphs.QUERIES[name](spark, str(oracle.FOLDER)))
    return sum("Relation [l_orderkey#" in line for df in plans for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_gr_level(spark, monkeypatch):
    assert scans(monkeypatch, spark, "gr_level") == 1


def test_agg_level_itdk(spark, monkeypatch):
    """Once for the links, once for those between PoPs."""
    assert scans(monkeypatch, spark, "agg_level_itdk") == 2


def test_agg_counts(spark, monkeypatch):
    """Once for the links, once for the places of goods."""
    assert scans(monkeypatch, spark, "agg_counts") == 2


def test_agg_info_record(spark, monkeypatch):
    """Once for the links, once for the places of goods."""
    assert scans(monkeypatch, spark, "agg_info_record") == 2


def test_gr_backbone(spark, monkeypatch):
    assert scans(monkeypatch, spark, "gr_backbone") == 1
