"""What the engine writes: a bundle of tables with its catalogue, lookups, tiles and content digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1024


def write_bundle(folder: str, nodes: DataFrame, edges: DataFrame, name: str, records: DataFrame | None = None) -> dict:
    """Parquet tables ``nodes``, ``edges`` and ``info`` (in chunks of 1024 nodes) under one folder, with the counts in ``meta``."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    if records is not None:
        records.withColumn("chunk", F.floor(F.col("node") / CHUNK)).write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/info")
    spark = nodes.sparkSession
    n, e = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    counts = e.agg(F.count("*").alias("edges"), F.count_if(F.col("rel") == -1).alias("p2c"), F.count_if(F.col("rel") == 0).alias("p2p")).first().asDict()
    meta = {"name": name, "nodes": n.count(), **counts, "columns": {"nodes": n.columns, "edges": e.columns}}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return meta


def read_bundle(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame]:
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    return meta, spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(folder, meta) of every bundle under ``root``: a folder counts if it has meta, nodes and edges."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda *p: spark._jvm.org.apache.hadoop.fs.Path("/".join(p))
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory() and all(fs.exists(path(root, s.getPath().getName(), x)) for x in ("meta", "nodes", "edges")))
    return spark.createDataFrame([(n, spark.read.text(f"{root}/{n}/meta").first()[0]) for n in names], "folder string, meta string")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_lookup(df: DataFrame, folder: str, key: str) -> None:
    """A table sorted by its key, for readers that search it."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(folder)


def write_json_records(df: DataFrame, folder: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)
