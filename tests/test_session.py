import pytest

from weftline import session


class Fake:
    def __init__(self, master, root=None):
        conf = type("C", (), {"get": lambda self, k, d=None: root})()
        self.conf = conf
        self.sparkContext = type("S", (), {"master": master, "getConf": lambda self: conf})()


def test_staging_root():
    assert session.staging_root(Fake("spark://x", "hdfs://shared")) == "hdfs://shared"
    assert session.staging_root(Fake("local[4]")).startswith("file:///")
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.staging_root(Fake(master))


def test_staged_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    out = session.staged(df, "t")
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == [(1, None), (2, "x")]
