"""Session defaults and the shared staging folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE, Arrow and the RocksDB state store. Cluster settings win over these where given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is a plain local one (tests), a temporary folder is set.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own_folder()


@cache
def _own_folder() -> str:
    """A temporary folder of this process, for plain local masters only; it goes when the process does."""
    folder = tempfile.mkdtemp(prefix="weftline-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
