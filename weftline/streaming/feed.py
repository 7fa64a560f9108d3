"""The routing feed as a stream: decoding, filters, dedupe, rates and keyed state, on event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.session import staged_path


def table_stream(spark: SparkSession, folder: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """A table of the folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_once:
        r = r.option("maxFilesPerTrigger", files_at_once)
    return r.parquet(path) if is_folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", each: Callable | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote to the shared folder.

    ``complete`` results are overwritten by each batch; ``each(batch, number, path)`` writes a batch in its own way. Progress is kept beside
    the result, so a restart goes on where it was.
    """
    spark = stream.sparkSession
    out, marks = staged_path(spark, name), staged_path(spark, f"{name}-progress")
    w = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    if each is not None:
        w = w.outputMode(mode).foreachBatch(lambda b, i: each(b, i, out))
    elif mode == "append":
        w = w.outputMode("append").format("parquet").option("path", out)
    else:
        w = w.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out))
    q = w.start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if each is None else spark.read.parquet(out)


def rates(events: DataFrame, time: str, window: str = "60 seconds", slide: str = "1 second", by: list[str] = ()) -> DataFrame:
    """Counts over sliding windows."""
    return events.groupBy(F.window(time, window, slide), *by).agg(F.count("*").alias("n"))


def first_deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """One of each message within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(keys)


def _in_order(parts: Iterator[pd.DataFrame], by: list[str]) -> list[tuple]:
    """A batch's rows of one key, in order. A key is one source, user or prefix, so a batch holds few rows of it."""
    rows = pd.concat(list(parts), ignore_index=True)
    return list(rows.sort_values(by, kind="stable").itertuples(index=False)) if len(rows) else []


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def throttled(events: DataFrame, key: str, time: str, every_ms: int = 1000) -> DataFrame:
    """(key, t): at most one event of a key in ``every_ms`` milliseconds, the first one allowed."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for r in _in_order(parts, ["t"]):
            if last is None or r.t - last >= every_ms:
                out.append(int(r.t))
                last = int(r.t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "t": out})

    ms = events.select(F.col(key), F.unix_millis(F.col(time).cast("timestamp")).alias("t")).where("t IS NOT NULL")
    return ms.groupBy(key).applyInPandasWithState(step, f"{key} {_kinds(events)[key]}, t bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def held_choices(options: DataFrame, key: str, time: str, order: str, choice: str, gone: str, slot_ms: int = 15_000, offset_ms: int = 12_000) -> DataFrame:
    """(key, order, slot, held): what each key is served by after each of its events.

    A choice is held for its slot while it stays valid: an event with ``gone`` set drops it, and the next event of the slot without is chosen.
    """
    kinds = _kinds(options)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot, held = state.get if state.exists else (None, None)
        out = []
        for r in _in_order(parts, ["slot", "o"]):
            if r.slot != slot:
                slot, held = int(r.slot), None
            held = None if r.g else held if held is not None else r.c
            out.append((k[0], r.o, slot, held))
        state.update((slot, held))
        yield pd.DataFrame(out, columns=[key, order, "slot", "held"])

    at = F.floor((F.unix_millis(F.col(time).cast("timestamp")) - offset_ms) / slot_ms).cast("long")
    rows = options.select(F.col(key), F.col(order).alias("o"), at.alias("slot"), F.col(choice).alias("c"), F.col(gone).alias("g")).where("slot IS NOT NULL")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, slot bigint, held {kinds[choice]}", f"slot bigint, held {kinds[choice]}", "append", GroupStateTimeout.NoTimeout)


def coalesced(requests: DataFrame, key: str, time: str, order: str, busy_ms: int) -> DataFrame:
    """(key, order): the requests that are run. Each takes ``busy_ms``; of those that come meanwhile the newest is run next, the others are dropped.

    A request that waits is known to run when a later one shows that its turn has come.
    """
    kinds = _kinds(requests)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, waiting = state.get if state.exists else (None, None)
        out = []
        for r in _in_order(parts, ["t", "o"]):
            if waiting is not None and r.t >= free:
                out.append(waiting)
                free, waiting = free + busy_ms, None
            if free is None or r.t >= free:
                out.append(r.o)
                free = int(r.t) + busy_ms
            else:
                waiting = r.o
        if free is not None:
            state.update((free, waiting))
        yield pd.DataFrame({key: [k[0]] * len(out), order: out})

    rows = requests.select(F.col(key), F.unix_millis(F.col(time).cast("timestamp")).alias("t"), F.col(order).alias("o")).where("t IS NOT NULL")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}", f"free bigint, waiting {kinds[order]}", "append", GroupStateTimeout.NoTimeout)


def consent_queue(events: DataFrame, key: str, order: str, grants: str, denies: str, most: int = 100) -> DataFrame:
    """(key, order): the events that are sent. Until a key's consent is known the first ``most`` wait; a grant sends them and all that follow, a denial
    drops them and all that follow, until the other comes. ``grants`` and ``denies`` are conditions; such events are not sent themselves."""
    kinds = _kinds(events)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        allowed, queue = state.get if state.exists else (None, [])
        queue, out = list(queue), []
        for r in _in_order(parts, ["o"]):
            if r.said != 0:
                out += queue if r.said > 0 else []
                allowed, queue = bool(r.said > 0), []
            elif allowed:
                out.append(r.o)
            elif allowed is None and len(queue) < most:
                queue.append(r.o)
        state.update((allowed, queue))
        yield pd.DataFrame({key: [k[0]] * len(out), order: out})

    said = F.when(F.expr(grants), 1).when(F.expr(denies), -1).otherwise(0)
    rows = events.select(F.col(key), F.col(order).alias("o"), said.alias("said"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}", f"allowed boolean, queue array<{kinds[order]}>", "append", GroupStateTimeout.NoTimeout)


def stalls(frames: DataFrame, key: str, time: str, order: str, stall_ms: int) -> DataFrame:
    """(key, order, gap, state): the watchdog of each connection: 'open' at its first frame, 'stalled' at the first frame after a silence of more than ``stall_ms``."""
    kinds = _kinds(frames)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for r in _in_order(parts, ["o"]):
            if last is None:
                out.append((k[0], r.o, None, "open"))
            elif r.t - last > stall_ms:
                out.append((k[0], r.o, r.t - last, "stalled"))
            last = int(r.t) if last is None else max(last, int(r.t))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, "gap", "state"]).astype({"gap": "Int64"})

    rows = frames.select(F.col(key), F.unix_millis(F.col(time)).alias("t"), F.col(order).alias("o")).where("t IS NOT NULL")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, gap bigint, state string", "last bigint", "append", GroupStateTimeout.NoTimeout)


def prefix_events(frames: DataFrame, order: str, via: str) -> DataFrame:
    """(order, prefix, kind, via, own): each announcement ('a') and withdrawal ('w') of the updates; ``own`` if the network itself is the origin."""
    d = frames.where((F.col("frame_type") == "ris_message") & (F.col("data.type") == "UPDATE"))
    path = F.coalesce(F.col("data.path"), F.array().cast("array<string>"))
    through = F.exists(path, lambda h: (h == via) | F.array_contains(F.split(F.regexp_replace(h, "[{} ]", ""), ","), via))
    own = F.coalesce(F.try_element_at(path, F.lit(-1)) == via, F.lit(False))
    none = F.array().cast("array<string>")
    said = F.coalesce(F.flatten(F.transform("data.announcements", lambda a: F.coalesce(a["prefixes"], none))), none)
    tag = lambda xs, kind: F.transform(xs, lambda p: F.struct(p.alias("prefix"), F.lit(kind).alias("kind")))
    rows = d.select(order, through.alias("via"), own.alias("own"), F.explode(F.concat(tag(said, "a"), tag(F.coalesce("data.withdrawals", none), "w"))).alias("p"))
    return rows.select(order, F.col("p.prefix").alias("prefix"), F.col("p.kind").alias("kind"), "via", "own").where("prefix IS NOT NULL")


def kept_prefixes(rows: DataFrame, order: str, ours: DataFrame | None = None) -> DataFrame:
    """(order, prefix, kind, via): announcements through the network or of our prefixes, and withdrawals of ours.

    Ours are those of the table ``ours`` (column ``prefix``, joined as it stands) and those the network was seen to originate before. That set is the
    state: each prefix holds its own bit, so it grows without any one value growing, and what it learns decides the rows that follow.
    """
    table = None if ours is None else ours.select("prefix").distinct().withColumn("listed", F.lit(True))
    rows = rows.withColumn("listed", F.lit(False)) if table is None else rows.join(table, "prefix", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    kinds = _kinds(rows)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, out = bool(state.get[0]) if state.exists else False, []
        for r in _in_order(parts, ["o", "kind"]):
            seen = seen or (r.kind == "a" and bool(r.own))
            if (r.kind == "a" and r.via) or seen or r.listed:
                out.append((r.o, k[0], r.kind, bool(r.via)))
        state.update((seen,))
        yield pd.DataFrame(out, columns=[order, "prefix", "kind", "via"])

    rows = rows.select("prefix", F.col(order).alias("o"), "kind", "via", "own", "listed")
    return rows.groupBy("prefix").applyInPandasWithState(step, f"{order} {kinds[order]}, prefix string, kind string, via boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def sliding_counts(buckets: DataFrame, counters: list[str], seconds: int = 60) -> DataFrame:
    """(sec, counters...) over the last ``seconds`` one-second buckets, at each bucket that occurs.

    A bucket belongs to its stretch of time and to the next one's past, so windows stay within stretches.
    """
    block = F.floor(F.col("sec") / seconds)
    both = buckets.withColumn("home", block).withColumn("block", F.explode(F.array(block, block + 1)))
    over = Window.partitionBy("block").orderBy("sec").rangeBetween(1 - seconds, 0)
    return both.select("home", "block", "sec", *[F.sum(c).over(over).alias(c) for c in counters]).where("home = block").select("sec", *counters)


def matched(left: DataFrame, right: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Stream-stream join: right events of a key within an interval after the left event. Both sides carry watermarks."""
    a, b = left.alias("a"), right.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{time}") >= F.col(f"a.{time}")) & (F.col(f"b.{time}") <= F.col(f"a.{time}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on)


def keep_newest(order: str, n: int, by: str | None = None) -> Callable:
    """Batch writer that keeps the newest ``n`` rows of all batches, or of each ``by``."""

    def newest(rows: DataFrame) -> DataFrame:
        if by is None:
            return rows.orderBy(F.desc(order)).limit(n)
        return rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__k") <= n).drop("__k")

    def write(batch: DataFrame, number: int, out: str) -> None:
        spark = batch.sparkSession
        top = newest(batch)
        if number:
            top = newest(top.unionByName(spark.read.parquet(f"{out}-{number - 1}")))
        top.write.mode("overwrite").parquet(f"{out}-{number}")
        spark.read.parquet(f"{out}-{number}").write.mode("overwrite").parquet(out)

    return write
