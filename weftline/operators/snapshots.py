"""What changed between consecutive full deliveries of a table.

Keys get persistent ordinals, kept in a dictionary that later deliveries extend. A delivery is held as, for each bucket of keys, a compressed bitmap of the
ordinals that are present and column vectors of the values, aligned by ordinal. Two deliveries are compared bucket by bucket: AND-NOT of the bitmaps gives
additions and removals, AND the common keys, whose vectors show the changes. Dictionary and bitmaps with vectors can be kept in a folder
(``state``), so that the next delivery is compared with the last one of an earlier call without reading it again.

A bucket is a number of low bits of the key's hash. When the keys have grown, one more bit splits every bucket; ordinals stay as they are, since those of a
part are unique as those of the whole were, and the bitmaps hold them as sparsely as they lie. So no task holds more than about ``bucket`` keys of two
deliveries, whatever the deliveries grow to.

Defined results:
* rows with a null key or snapshot are left out; of several rows for a key in a delivery the lowest ``line`` holds
  (a null line number counts as the last);
* null and null are equal values; the first delivery ever changes nothing; a single one gives no rows;
* values are compared as text; deliveries of a later call must come after those the state knows;
* other columns are ignored, whatever they are called; equal deliveries give no rows.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged

BUCKET = 32_768
DENSE = 4096  # a stretch of 65,536 ordinals with more than this is held as bits, with fewer as a list


def canonical_prefix(text: str | None) -> str | None:
    """Host bits cleared, IPv6 compressed and in lower case; None if it is no prefix."""
    if text is None or "/" not in text:
        return None
    try:
        return str(ipaddress.ip_network(text.strip(), strict=False))
    except ValueError:
        return None


def with_canonical_prefix(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``; the parser runs once for each distinct text of a batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pc.dictionary_encode(batch.column(batch.schema.get_field_index(column)))
            table = pa.array([canonical_prefix(x) for x in codes.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, table.take(codes.indices)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


class Bitmap:
    """A compressed set of ordinals: for each stretch of 65,536 that holds any, a sorted list or, if it is dense, its bits."""

    def __init__(self, parts: dict[int, np.ndarray]):
        self.parts = parts  # uint16 lists, or uint8 arrays of 8,192 bytes

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        if not len(ordinals):
            return cls({})
        ordinals = np.unique(ordinals.astype(np.int64))
        high = ordinals >> 16
        cut = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        return cls({int(high[s]): cls._pack(ordinals[s:e] & 0xFFFF) for s, e in zip(cut, np.r_[cut[1:], len(ordinals)], strict=True)})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= DENSE:
            return low.astype(np.uint16)
        bits = np.zeros(1 << 16, bool)
        bits[low] = True
        return np.packbits(bits, bitorder="little")

    @staticmethod
    def _low(part: np.ndarray) -> np.ndarray:
        return part.astype(np.int64) if part.dtype == np.uint16 else np.flatnonzero(np.unpackbits(part, bitorder="little"))

    def members(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[(k << 16) + self._low(p) for k, p in sorted(self.parts.items())]])

    def _with(self, other: Bitmap, keep: bool) -> Bitmap:
        out = {}
        for k, p in self.parts.items():
            q = other.parts.get(k)
            if q is None:
                if not keep:
                    out[k] = p
                continue
            if p.dtype == q.dtype == np.uint8:
                low = np.flatnonzero(np.unpackbits(p & q if keep else p & ~q, bitorder="little"))
            elif q.dtype == np.uint8:  # a list against bits
                low = p.astype(np.int64)
                low = low[(q[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool) == keep]
            else:
                low = self._low(p)
                low = low[np.isin(low, q, assume_unique=True) == keep]
            if len(low):
                out[k] = self._pack(low)
        return Bitmap(out)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._with(other, True)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._with(other, False)

    def to_bytes(self) -> bytes:
        """For each stretch its number, the size of its data and the data; bits are known by their size."""
        return b"".join(np.array([k, p.nbytes + (p.dtype == np.uint8)], np.int64).tobytes() + p.tobytes() for k, p in sorted(self.parts.items()))

    @classmethod
    def from_bytes(cls, data: bytes) -> Bitmap:
        parts, at = {}, 0
        while at < len(data):
            k, size = np.frombuffer(data, np.int64, 2, at)
            dense = size % 2  # lists have an even number of bytes
            size = int(size - dense)
            parts[int(k)] = np.frombuffer(data, np.uint8 if dense else np.uint16, size if dense else size // 2, at + 16)
            at += 16 + size
        return cls(parts)


def assign_ordinals(keys: DataFrame, key: str, known: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """(key, bucket, ordinal, bits) of every distinct key. ``known`` is an earlier dictionary: its ordinals stay, new keys follow.

    ``bits`` is how many bits of the hash make the bucket: as many as the number of keys needs, never fewer than before.
    """
    distinct = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    if known is not None:
        known = known.select("key", "ordinal", "bits")
        distinct = distinct.join(known.select("key"), "key", "left_anti")
    new = staged(distinct, "keys")
    old = known.agg(F.count("*").alias("n"), F.max("bits").alias("bits")).first() if known is not None else None
    n = new.count() + (old["n"] if old else 0)
    bits = max((old["bits"] or 0) if old else 0, (max(1, -(-n // bucket)) - 1).bit_length())
    home = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    placed = new.withColumn("h", F.xxhash64("key")).select("key", home.alias("bucket"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("key")) - 1)
    if known is None:
        return numbered.select("key", "bucket", F.col("k").cast("long").alias("ordinal"), F.lit(bits).alias("bits"))
    known = known.withColumn("h", F.xxhash64("key")).select("key", home.alias("bucket"), F.col("ordinal").cast("long").alias("ordinal"))
    top = known.groupBy("bucket").agg((F.max("ordinal") + 1).alias("first"))
    new = numbered.join(top, "bucket", "left").select("key", "bucket", (F.col("k") + F.coalesce("first", F.lit(0))).cast("long").alias("ordinal"))
    return known.unionByName(new).withColumn("bits", F.lit(bits))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _newest(spark: SparkSession, state: str) -> int:
    version = 0
    while _exists(spark, f"{state}/{version + 1}/vectors/_SUCCESS"):
        version += 1
    return version


def snapshot_changes(df: DataFrame, snap: str, key: str, values: list[str], line: str, state: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """(snap, key, change): 'added', 'removed' or 'changed' against the previous delivery; ``snap`` is the later one.

    ``state`` is a folder that holds the dictionary and the last delivery of earlier calls, and will hold this call's.
    """
    spark = df.sparkSession
    rows = df.where(F.col(snap).isNotNull() & F.col(key).isNotNull())
    columns = [f"v{i}" for i in range(len(values))]
    held = F.min(F.struct(F.coalesce(F.col(line).cast("long"), F.lit((1 << 63) - 1)).alias("n"), F.xxhash64(*values).alias("tie"), F.struct(*[F.col(v).cast("string").alias(c) for v, c in zip(values, columns, strict=True)]).alias("v")))
    one = staged(rows.groupBy(F.col(snap).alias("snap"), F.col(key).alias("key")).agg(held.alias("held")).select("snap", "key", "held.v.*"), "held")
    version = _newest(spark, state) if state else 0
    known = spark.read.parquet(f"{state}/{version}/keys") if version else None
    ordinals = staged(assign_ordinals(one, "key", known, bucket), "ordinals")
    # the deliveries are few and are numbered in order; 0 is the last one of an earlier call
    names = [r["snap"] for r in one.select("snap").distinct().orderBy("snap").collect()]
    if not names and not version:
        return spark.createDataFrame([], T.StructType([one.schema["snap"], one.schema["key"], T.StructField("change", T.StringType())])).toDF(snap, key, "change")
    at = F.create_map(*[x for i, s in enumerate(names, 1) for x in (F.lit(s), F.lit(i))])[F.col("snap")] if names else F.lit(None).cast("int")
    vector = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("bitmap", T.BinaryType()), *[T.StructField(c, T.ArrayType(T.StringType())) for c in columns]])

    def align(t: pa.Table) -> pa.Table:
        ordinal = t.column("ordinal").to_numpy()
        order = pa.array(np.argsort(ordinal, kind="stable"))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(ordinal)], pa.int32()), t.column(c).combine_chunks().take(order)) for c in columns]
        first = lambda c: t.column(c).combine_chunks().slice(0, 1)
        return pa.Table.from_arrays([first("bucket"), first("at"), pa.array([Bitmap.of(ordinal).to_bytes()]), *lists], names=vector.names)

    placed = one.join(ordinals.select("key", "bucket", "ordinal"), "key").select("bucket", at.alias("at"), "ordinal", *columns)
    vectors = placed.groupBy("bucket", "at").applyInArrow(align, vector)
    if version:  # the last delivery, laid out anew where buckets have been split
        last = spark.read.parquet(f"{state}/{version}/vectors")
        before = spark.read.parquet(f"{state}/{version}/keys").groupBy().agg(F.max("bits").alias("bits")).first()["bits"]
        now = ordinals.agg(F.max("bits").alias("bits")).first()["bits"]
        if now is not None and before is not None and now > before:
            flat = last.mapInArrow(_unpack(columns), T.StructType([T.StructField("old", T.IntegerType()), T.StructField("ordinal", T.LongType()), *[T.StructField(c, T.StringType()) for c in columns]]))
            homes = ordinals.withColumn("old", F.col("bucket").bitwiseAND(F.lit((1 << before) - 1)).cast("int")).select("old", "ordinal", "bucket", "key").join(known.select("key"), "key", "left_semi")
            last = flat.join(homes, ["old", "ordinal"]).select("bucket", F.lit(0).alias("at"), "ordinal", *columns).groupBy("bucket", "at").applyInArrow(align, vector)
        vectors = vectors.unionByName(last.withColumn("at", F.lit(0)))
    vectors = staged(vectors, "vectors")
    first, final = (0 if version else 1), len(names)
    sides = vectors.withColumn("later", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("pair", F.when(F.col("later"), F.col("at")).otherwise(F.col("at") + 1)).where((F.col("pair") > first) & (F.col("pair") <= final))
    found_schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("pair", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("change", T.StringType())])

    def compare(t: pa.Table) -> pa.Table:
        side = {bool(x): i for i, x in enumerate(t.column("later").to_pylist())}
        maps = {k: Bitmap.from_bytes(t.column("bitmap")[i].as_py()) for k, i in side.items()}
        new, old = maps.get(True, Bitmap({})), maps.get(False, Bitmap({}))
        both = (new & old).members()
        differs = np.zeros(len(both), bool)
        if len(both):
            x_at, y_at = pa.array(np.searchsorted(new.members(), both)), pa.array(np.searchsorted(old.members(), both))
            for c in columns:
                x, y = t.column(c)[side[True]].values.take(x_at), t.column(c)[side[False]].values.take(y_at)
                same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
                differs |= ~same.to_numpy(zero_copy_only=False).astype(bool)
        parts = ((new.and_not(old).members(), "added"), (old.and_not(new).members(), "removed"), (both[differs], "changed"))
        n = sum(len(p) for p, _ in parts)
        alike = lambda c: t.column(c).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        said = np.repeat([s for _, s in parts], [len(p) for p, _ in parts])
        return pa.table({"bucket": alike("bucket"), "pair": alike("pair"), "ordinal": np.concatenate([p for p, _ in parts]).astype(np.int64), "change": pa.array(said, pa.string())})

    found = sides.groupBy("bucket", "pair").applyInArrow(compare, found_schema)
    named = F.create_map(*[x for i, s in enumerate(names, 1) for x in (F.lit(i), F.lit(s))])[F.col("pair")] if names else F.lit(None).cast("string")
    out = found.join(ordinals.select("bucket", "ordinal", "key"), ["bucket", "ordinal"]).select(named.cast(one.schema["snap"].dataType).alias(snap), F.col("key").alias(key), "change")
    if state and names:
        ordinals.write.mode("overwrite").parquet(f"{state}/{version + 1}/keys")
        vectors.where(F.col("at") == final).write.mode("overwrite").parquet(f"{state}/{version + 1}/vectors")
    return out


def _unpack(columns: list[str]):
    """Rows of (bucket, ordinal, values) from bitmaps and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ordinal = Bitmap.from_bytes(row.column("bitmap")[0].as_py()).members()
                yield pa.RecordBatch.from_arrays([row.column("bucket").take(pa.array(np.zeros(len(ordinal), np.int64))), pa.array(ordinal), *[row.column(c)[0].values.cast(pa.string()) for c in columns]], names=["old", "ordinal", *columns])

    return run
