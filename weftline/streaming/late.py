"""Late events as a stream: aggregates by period that late records correct until a cut-off, closed by the sources' watermarks.

Each micro-batch adds what :mod:`weftline.operators.late` keeps of a source (marks by period, ticks of arrival) and partial aggregates by period and tick of
arrival, so nothing is held but small rows that grow with time, not with records. Closes and corrected aggregates are read from the merged parts
at any time: a record that comes a week late corrects its period (or counts as cut) like one that comes at once, and no engine watermark drops it. A
record's side of the close is decided by its own arrival, so the result doesn't depend on how records fall into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.late import CUT, IDLE, PERIOD, TICK, closes_of, punctuation_marks, source_marks, source_ticks
from weftline.session import staged_path


def partials(batch: DataFrame, value: str) -> DataFrame:
    """Aggregates of one batch by period and tick of arrival."""
    start = (F.floor(F.col("event_s") / PERIOD) * PERIOD).cast("long")
    cut = F.col("arrival_s") - (start + PERIOD) > CUT
    rows = batch.where("event_s IS NOT NULL AND arrival_s IS NOT NULL")
    return rows.groupBy(start.alias("start"), (F.floor(F.col("arrival_s") / TICK) * TICK).cast("long").alias("tick")).agg(F.count_if(~cut).alias("n"), F.count_if(cut).alias("n_cut"), F.sum(F.when(~cut, F.col(value))).cast("double").alias("total"), F.sum(F.when(cut, F.col(value))).cast("double").alias("total_cut"))


def follow(stream: DataFrame, source: str, value: str, out: str, progress: str, bound: str | None = None) -> None:
    """Runs over what is there; parts of a batch are written under its number, so a batch done again replaces them.

    Rows whose ``bound`` column isn't null are punctuations: they move their source's watermark and count in no aggregate.
    """

    def write(batch: DataFrame, number: int) -> None:
        marks, rows = source_marks(batch, source), batch
        if bound:
            control = batch.where(F.col(bound).isNotNull()).select(source, F.col(bound).alias("bound_s"), "arrival_s")
            rows = batch.where(F.col(bound).isNull())
            marks = source_marks(rows, source).unionByName(punctuation_marks(control, source))
        partials(rows, value).write.mode("overwrite").parquet(f"{out}/aggregates/batch={number}")
        marks.write.mode("overwrite").parquet(f"{out}/marks/batch={number}")
        source_ticks(batch, source).write.mode("overwrite").parquet(f"{out}/ticks/batch={number}")

    write(stream.sparkSession.createDataFrame([], stream.schema), -1)  # a stream without rows has a result too
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()


def merged(spark, out: str, idle: int = IDLE, hold: int | None = None) -> DataFrame:
    """(start, n_on_time, n_late, n_cut, total_at_close, total, close): the aggregates as corrected so far and when each period was closed."""
    a = spark.read.parquet(f"{out}/aggregates").groupBy("start", "tick").agg(*[F.sum(c).alias(c) for c in ("n", "n_cut", "total", "total_cut")])
    marks = spark.read.parquet(f"{out}/marks").groupBy("source", "start").agg(F.min("shown").alias("shown"))
    ticks = spark.read.parquet(f"{out}/ticks").select("source", "tick").distinct()
    rows = a.join(closes_of(marks, ticks, idle=idle, hold=hold), "start", "left").withColumn("close", F.coalesce("close", F.col("start") + PERIOD))
    on_time = F.col("tick") < F.col("close")
    all_total = F.when(F.col("total").isNotNull() | F.col("total_cut").isNotNull(), F.coalesce("total", F.lit(0.0)) + F.coalesce("total_cut", F.lit(0.0)))
    count = lambda where, n: F.sum(F.when(where, n).otherwise(0))
    return rows.groupBy("start").agg(count(on_time, F.col("n") + F.col("n_cut")).alias("n_on_time"), count(~on_time, F.col("n")).alias("n_late"), count(~on_time, F.col("n_cut")).alias("n_cut"), F.sum(F.when(on_time, all_total)).alias("total_at_close"), F.sum(F.when(on_time, all_total).otherwise(F.col("total"))).alias("total"), F.max("close").alias("close"))


def run(stream: DataFrame, source: str, value: str, idle: int = IDLE, hold: int | None = None) -> DataFrame:
    spark = stream.sparkSession
    out = staged_path(spark, "late")
    follow(stream, source, value, out, staged_path(spark, "late-progress"))
    return merged(spark, out, idle, hold)
