"""Messages delivered more than once.

An index of known identifiers is kept in a folder as immutable runs: identifiers with their times, sorted by slab of time, hash and time. Each incoming
batch is deduplicated within itself, what is left is written as a new run, and its identifiers are searched by bisection in the sorted arrays of the
slabs and hash prefixes they fall into; of older runs only the slabs that the batch touches are read. Runs of like size are merged from time to time, and a
manifest names the runs that count, so a batch that fails halfway leaves the index as it was. A later batch is compared with all that
came before, in whatever session.

Copies that are equal in identifier, peer and time collapse before the shuffle, so a message delivered a million times is one row. A slab is cut by
hash into as many prefixes as its own rows need, so neither a busy hour nor a wrong clock makes a task grow. An identifier handed out again and again has
at most one row for each millisecond of a slab.

Defined results:
* two deliveries are of one message if identifier and peer are equal, letter case and outer blanks aside, and their times differ by at most
  ``tolerance``; a delivery is surplus if one with a lower number, or any of an earlier batch, is of the same message;
* rows without identifier are left out; a null peer equals only a null peer; without time only deliveries without time are the same message;
* blank identifiers count as identifiers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged_path

SLAB_S = 3600
PREFIX_ROWS = 200_000
FAN = 8  # runs of a level that are merged into one of the next
FOLDERS = 64  # folders of a run, by slab
UNTIMED = -(1 << 62)  # the slab of what has no time
RUN = "slab long, h long, t long, i string, p string, folder int"


class MessageIndex:
    """Sorted immutable runs of (slab, h, t, i, p) below ``path``, and manifests that name those that count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> tuple[int, list[tuple[str, int]]]:
        """(version, runs as (name, level)) of the newest manifest that was written whole."""
        version = 0
        while self._exists(f"{self.path}/manifest/{version + 1}/_SUCCESS"):
            version += 1
        if not version:
            return 0, []
        rows = self.spark.read.parquet(f"{self.path}/manifest/{version}").collect()  # one row for each run
        return version, sorted((r["run"], r["level"]) for r in rows if r["run"])

    def _write_manifest(self, version: int, runs: list[tuple[str, int]]) -> None:
        self.spark.createDataFrame(runs or [("", 0)], "run string, level int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")

    def read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).option("basePath", self.path).parquet(*[f"{self.path}/{r}" for r in runs]).select("slab", "h", "t", "i", "p", "folder")

    def write(self, rows: DataFrame, run: str) -> None:
        """Files by folder, sorted within; a folder of a busy time is several files, by hash."""
        spread = rows.withColumn("folder", F.pmod(F.col("slab"), F.lit(FOLDERS)).cast("int")).repartition("folder", F.pmod(F.col("h"), F.lit(8))).sortWithinPartitions("folder", "slab", "h", "t")
        spread.write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/{run}")

    def add(self, version: int, runs: list[tuple[str, int]], run: str) -> None:
        """Makes a written run count; where ``FAN`` runs of a level are there, they are merged into one of the next."""
        runs, version, level = [*runs, (run, 0)], version + 1, 0
        while len(full := [r for r, n in runs if n == level]) >= FAN:
            merged = f"run={version}-{level + 1}"
            self.write(self.read(full).drop("folder").distinct(), merged)
            runs, level = [(r, n) for r, n in runs if n != level] + [(merged, level + 1)], level + 1
        self._write_manifest(version, runs)


def _lowest(number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of number[lo:hi] for each pair, by minima over doubling stretches; a large one where the stretch is empty."""
    out = np.full(len(lo), np.iinfo(np.int64).max)
    level, width, n = number, 1, hi - lo
    while True:
        now = (n >= width) & (n < 2 * width)
        if now.any():
            out[now] = np.minimum(level[lo[now]], level[hi[now] - width])
        if 2 * width > n.max(initial=0):
            return out
        level, width = np.minimum(level[:-width], level[width:]), 2 * width


def surplus(df: DataFrame, delivery: str, identifier, peer, time_ms, tolerance_ms: int = 1000, slab_s: int = SLAB_S, index: str | None = None) -> DataFrame:
    """The surplus deliveries: one column, ``delivery``. ``identifier``, ``peer`` and ``time_ms`` are columns (time in ms, as an integer).

    ``index`` is the folder of the index, which is searched and then extended by this batch; without, a new one is made in the shared folder.
    """
    spark, width = df.sparkSession, slab_s * 1000
    if tolerance_ms > width:
        raise ValueError("a slab must be at least as wide as the tolerance")
    book = MessageIndex(spark, index or staged_path(spark, "messages"))
    version, runs = book.manifest()
    rows = df.select(F.col(delivery).alias("d"), F.lower(F.trim(identifier)).alias("i"), F.lower(F.trim(peer)).alias("p"), time_ms.cast("long").alias("t")).where(F.col("i").isNotNull())
    # local dedupe: equal copies are one row, with the lowest delivery
    novel = rows.groupBy("i", "p", "t").agg(F.min("d").alias("d")).withColumn("h", F.xxhash64("i", "p")).withColumn("slab", F.coalesce(F.floor(F.col("t") / width), F.lit(UNTIMED)).cast("long"))
    path = staged_path(spark, "novel")
    novel.write.parquet(path)
    novel = spark.read.parquet(path)
    run = f"run={version + 1}-0"
    book.write(novel.select("slab", "h", "t", "i", "p"), run)
    ends = F.array_distinct(F.array(F.floor((F.col("t") - tolerance_ms) / width), F.col("slab"), F.floor((F.col("t") + tolerance_ms) / width)))
    placed = novel.withColumn("slab", F.explode(F.coalesce(ends, F.array(F.lit(UNTIMED))))).withColumn("old", F.lit(False))
    sides = placed.select("slab", "h", "i", "p", "t", "d", "old")
    if runs:
        touched = placed.select("slab").distinct()
        touched = touched.withColumn("folder", F.pmod(F.col("slab"), F.lit(FOLDERS)).cast("int"))
        # an older row lies in its own slab only; the batch's rows come to it
        known = book.read([r for r, _ in runs]).join(touched, ["slab", "folder"], "left_semi")
        sides = sides.unionByName(known.select("slab", "h", "i", "p", "t", F.lit(None).cast(rows.schema["d"].dataType).alias("d"), F.lit(True).alias("old")))
    # busy slabs are cut by their own number of rows; there are at most rows / PREFIX_ROWS of them
    busy = sides.groupBy("slab").agg(F.ceil(F.count("*") / PREFIX_ROWS).cast("long").alias("cuts")).where("cuts > 1")
    sides = sides.join(busy, "slab", "left").withColumn("prefix", F.pmod(F.xxhash64("h"), F.coalesce("cuts", F.lit(1)))).drop("cuts")
    schema = T.StructType([T.StructField("d", rows.schema["d"].dataType)])

    def search(t: pa.Table) -> pa.Table:
        code = lambda c: t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ident, who, old = code("i"), code("p"), t.column("old").to_numpy(zero_copy_only=False).astype(bool)
        time = t.column("t").fill_null(0).to_numpy()
        # one number for identifier, peer and time: neighbours in it are neighbours in time of one identifier
        _, same = np.unique(ident * (who.max() + 2) + who, return_inverse=True)
        time = time - time.min()
        key = same * (int(time.max()) + 2 * tolerance_ms + 2) + time + tolerance_ms
        order = np.argsort(key, kind="stable")
        key = key[order]
        number = pc.rank(t.column("d").combine_chunks(), tiebreaker="min", null_placement="at_start").to_numpy().astype(np.int64)
        number[old] = 0
        number = number[order]
        mine = ~old[order]
        lo, hi = np.searchsorted(key, key[mine] - tolerance_ms, "left"), np.searchsorted(key, key[mine] + tolerance_ms, "right")
        found = _lowest(number, lo, hi) < number[mine]
        return pa.table({"d": t.column("d").take(pa.array(order[mine][found]))})

    near = sides.groupBy("slab", "prefix").applyInArrow(search, schema)
    # what the local dedupe took out is surplus, and so is what the index knew
    kept = novel.select("d").join(near, "d", "left_anti")
    found = rows.select("d").join(kept, "d", "left_anti").select(F.col("d").alias(delivery)).distinct()
    if index is None:
        return found
    out = staged_path(spark, "surplus")
    found.write.parquet(out)  # before the index knows this batch
    book.add(version, runs, run)
    return spark.read.schema(found.schema).parquet(out)
