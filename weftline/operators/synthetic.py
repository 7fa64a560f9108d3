"""Synthetic topologies, made in parallel: every choice is a hash of (seed, node, slot), so partitions don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 1 << 30


def _unit(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SCALE)) / float(SCALE)


def topology(spark: SparkSession, n: int, seed: int, core: int = 8, peers: float = 0.5) -> DataFrame:
    """(eid, a, b, rel): a full mesh of ``core`` networks, then each later one with 1 to 3 providers among the earlier ones.

    The provider's number is the square of a uniform draw, so early networks get many customers. Peer links join random pairs of like age;
    a pair with both kinds keeps the provider link.
    """
    s = F.lit(seed)
    late = spark.range(core, n).withColumnRenamed("id", "b")
    slots = late.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(3 * _unit(s, F.lit(1), "b")).cast("int"))))
    u = _unit(s, F.lit(2), "b", "k")
    p2c = slots.select(F.floor(u * u * F.col("b")).cast("long").alias("a"), "b", F.lit(-1).alias("rel"))
    c = spark.range(core)
    mesh = c.select(F.col("id").alias("a")).join(c.select(F.col("id").alias("b"))).where("a < b").withColumn("rel", F.lit(0))
    near = late.where(_unit(s, F.lit(3), "b") < peers).select(F.floor(F.col("b") * (0.5 + 0.5 * _unit(s, F.lit(4), "b"))).cast("long").alias("a"), "b", F.lit(0).alias("rel")).where("a < b")
    one = p2c.union(mesh).union(near).groupBy("a", "b").agg(F.min("rel").alias("rel"))
    return one.select((F.col("a") * 10_000_000 + F.col("b")).alias("eid"), "a", "b", "rel")
