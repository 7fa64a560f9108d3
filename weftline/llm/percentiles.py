"""Exact percentiles of very large columns, by group.

Values are counted first: each task collapses equal (group, value) rows of its input to one with a count, so a value that occurs a billion times is
a few rows. The counted rows go through one distributed sort by (group, value), spilling as it must, and then counts for each partition: a group that
lies within one partition is answered from its running counts while its sorted values pass; of the groups that touch a partition's ends (a hot group
spans many) or are long, the running counts go out as they come, the counts of all partitions give each partition's offset, the offsets give where the
target positions lie, and only those values are fetched, with their neighbours, and interpolated. No group is ever gathered in one task.

The error is zero, so results of separate days are combined by keeping their counted values (:func:`counted_runs`) and asking over the union.

Defined results:
* null, NaN and infinite values are left out; a group without valid values gives no row; null is a group of its own in a key;
* position of quantile q among n values is (n - 1) * q, interpolated between neighbours; ties and repeated rows count each;
* with a ``weight`` column a row stands for so many equal values; null and weights below one count nothing;
* an empty table gives no rows; other columns are ignored; key names must not be ``n`` or ``at``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged

TARGETS_BROADCAST = 500_000  # target positions: at most 4 x partitions x quantiles
ROWS_OUT = 65_536
ROWS_COUNTED = 262_144  # rows that a task collapses at a time
ROWS_HELD = 1 << 20  # counted values of a group that a task holds; longer groups go out as they come


def valid_values(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    v = F.col(value).cast("double")
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    return df.select(*keys, v.alias("v"), w.alias("w")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (F.col("w") >= 1))


def counted_runs(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Valid (keys, v, w): the values of each group with how often they occur; what to keep of a day, and to union with other days'.

    Equal rows collapse within a task's input only, which needs no shuffle, so a value may come several times.
    """
    if {"v", "w"} & set(keys):
        raise ValueError("keys can't be named v or w")
    rows = valid_values(df, keys, value, weight)
    # minus zero is zero, as it is for the sort
    rows = rows.withColumn("v", F.col("v") + F.lit(0.0))
    names = [*keys, "v"]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by(names, use_threads=False).aggregate([("w", "sum")])
            yield from t.rename_columns([*names, "w"]).to_batches(max_chunksize=ROWS_OUT)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_COUNTED:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return rows.mapInArrow(collapse, rows.schema)


def group_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: list[float], weight: str | None = None) -> DataFrame:
    """keys, ``n`` (valid values), ``at`` (array of the quantiles, in the order given)."""
    if {"n", "at"} & set(keys):
        raise ValueError("keys can't be named n or at")
    own = df.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), (F.lit(1) if weight is None else F.col(weight)).alias("__w"))
    out = _percentiles(own, [f"__g{i}" for i in range(len(keys))], quantiles)
    return out.select(*[F.col(f"__g{i}").alias(k) for i, k in enumerate(keys)], "n", "at")


def _percentiles(df: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    qs, n_keys = np.array(quantiles, float), len(keys)
    # written down first: the range partitioning looks at its input twice
    runs = staged(counted_runs(df, keys, "__v", "__w"), "counts")
    rows = runs.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    schema = T.StructType([*[runs.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("at", T.ArrayType(T.DoubleType())), T.StructField("part", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("before", T.LongType()), T.StructField("w", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_keys = None  # the keys of the group that is open, one row
        held: list[tuple[np.ndarray, np.ndarray]] = []  # its sorted values and their counts
        size, sent, loose_slot, slot = 0, 0, True, 0  # rows held; values that went out; the partition's first group goes out as it comes

        def answered(key_rows: list[pa.Array], starts: np.ndarray, v: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            """Groups that begin at ``starts`` in (v, w) and fill it."""
            upto = np.cumsum(w)
            base = np.r_[0, upto[starts[1:] - 1]]
            n = np.r_[upto[starts[1:] - 1], upto[-1]] - base
            pos = (n - 1)[:, None] * qs
            lo = np.floor(pos).astype(np.int64)
            hi = np.minimum(lo + 1, (n - 1)[:, None])
            find = lambda p: v[np.searchsorted(upto, base[:, None] + p, "right")]
            a, b = find(lo), find(hi)
            at, k = a + (b - a) * (pos - lo), len(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * len(qs), pa.int32()), pa.array(at.ravel()))
            none = [pa.nulls(k, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())]
            return pa.RecordBatch.from_arrays([*key_rows, pa.array(n, pa.int64()), lists, *none], names=schema.names)

        def loose(v: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal sent
            before = sent + np.cumsum(w) - w
            sent += int(w.sum())
            for s in range(0, len(v), ROWS_OUT):
                cut = slice(s, s + ROWS_OUT)
                k = len(v[cut])
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(np.zeros(k, int))) for c in open_keys], pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.float64())), pa.array(np.full(k, part), pa.int32()), pa.array(np.full(k, slot), pa.int64()), pa.array(before[cut], pa.int64()), pa.array(w[cut], pa.int64()), pa.array(v[cut])], names=schema.names)

        def more(v: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Values of the open group."""
            nonlocal held, size, loose_slot
            if not loose_slot:
                held.append((v.copy(), w.copy()))
                size += len(v)
                if size < ROWS_HELD:
                    return
                v, w = (np.concatenate(x) for x in zip(*held, strict=True))
                held, size, loose_slot = [], 0, True
            yield from loose(v, w)

        def close() -> Iterator[pa.RecordBatch]:
            """The open group ends within the partition."""
            nonlocal held, size, sent, slot, loose_slot
            if held:
                v, w = (np.concatenate(x) for x in zip(*held, strict=True))
                yield answered(open_keys, np.array([0]), v, w)
            held, size, sent, slot, loose_slot = [], 0, 0, slot + 1, False

        for batch in batches:
            if not batch.num_rows:
                continue
            v, w = batch.column(n_keys).to_numpy(), batch.column(n_keys + 1).to_numpy()
            edge = np.zeros(len(v), bool)
            for c in range(n_keys):
                codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                edge[1:] |= codes[1:] != codes[:-1]
            starts = np.r_[0, np.flatnonzero(edge)]
            ends = np.r_[starts[1:], len(v)]
            row = lambda i, batch=batch: [batch.column(c).slice(i, 1) for c in range(n_keys)]
            s = 0
            if open_keys is not None and [c.to_pylist() for c in open_keys] == [c.to_pylist() for c in row(0)]:
                yield from more(v[: ends[0]], w[: ends[0]])
                s = 1
            if s < len(starts):
                if open_keys is None:
                    open_keys = row(0)
                    yield from more(v[: ends[0]], w[: ends[0]])
                    s = 1
                if s < len(starts):
                    yield from close()
                    whole, lo, hi = starts[s:-1], int(starts[s]), int(starts[-1])
                    if len(whole):
                        yield answered([batch.column(c).take(pa.array(whole)) for c in range(n_keys)], whole - lo, v[lo:hi], w[lo:hi])
                    open_keys = row(hi)
                    yield from more(v[hi:], w[hi:])
        if held:  # it may go on in the next partition
            v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from loose(v, w)

    found = staged(rows.mapInArrow(run, schema), "percentiles")
    whole = found.where(F.col("at").isNotNull()).select(*keys, "n", "at")
    loose_rows = found.where(F.col("at").isNull()).select(*keys, "part", "slot", "before", "w", "v")
    # counts of each partition's part of a group, and from them the offsets
    parts = loose_rows.groupBy(*keys, "part", "slot").agg(F.sum("w").alias("k"))
    over = Window.partitionBy(*keys)
    offset = F.coalesce(F.sum("k").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = parts.withColumn("offset", offset).withColumn("n", F.sum("k").over(over))
    q = F.posexplode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("q", "quantile")
    pos = (F.col("n") - 1) * F.col("quantile")
    wanted = spans.select("*", q).withColumn("lo", F.floor(pos)).withColumn("share", pos - F.col("lo")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    wanted = wanted.withColumn("target", F.least(F.col("lo") + F.col("side"), F.col("n") - 1)).where((F.col("target") >= F.col("offset")) & (F.col("target") < F.col("offset") + F.col("k")))
    wanted = staged(wanted.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], "part", "slot", (F.col("target") - F.col("offset")).alias("idx"), "n", "q", "share", "side"), "targets")
    small = F.broadcast(wanted) if wanted.count() <= TARGETS_BROADCAST else wanted
    hits = loose_rows.select("part", "slot", "before", "w", "v").join(small, ["part", "slot"]).where((F.col("idx") >= F.col("before")) & (F.col("idx") < F.col("before") + F.col("w")))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("v")))
    each = hits.groupBy(*[f"key{i}" for i in range(n_keys)], "n", "q", "share").agg(side(0).alias("a"), side(1).alias("b")).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    spread = each.groupBy(*[f"key{i}" for i in range(n_keys)], "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "x"))), lambda s: s["x"]).alias("at"))
    spread = spread.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "n", "at")
    return whole.unionByName(spread)
