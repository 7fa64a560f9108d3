"""Ranks over a whole table without one window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import staged

LOW = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], out: str, first: int = 1) -> DataFrame:
    """Row numbers in the order given: range partitions, the place within each, and the counts of those before (one row for each partition).

    The order should name a unique key last; then the result doesn't depend on the partitioning.
    """
    if not df.columns:
        return df
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = staged(rows, "rank").withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(LOW))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    # one row for each partition: as small as the plan itself
    return rows.join(F.broadcast(before), "__part").withColumn(out, F.col("__at") + F.col("__before") + first).drop("__id", "__part", "__at", "__before")


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, code): distinct values numbered in order from 0."""
    return global_rank(df.where(F.col(column).isNotNull()).select(column).distinct(), [F.col(column)], out, 0)


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order given, by a pre-aggregated minimum instead of a sort of the group.

    ``order`` is ascending; its columns must be orderable. Ties are broken by all other columns.
    """
    rest = [c for c in df.columns if c not in by]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*by).agg(F.min(key).alias("__k"))
    return best.select(*by, *[F.col(f"__k.c{i}").alias(c) for i, c in enumerate(rest)])
