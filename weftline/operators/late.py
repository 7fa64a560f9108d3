"""Late and out-of-order events, by low watermarks of the sources.

A source's low watermark is the newest event time it has shown (event times ahead of their arrival don't count) or the bound of its newest punctuation,
a control record which says that nothing older will follow. A source holds a period open from the period's end until its watermark passes that end, or
until it is idle: nothing has arrived from it for ``idle`` seconds. Sources that are idle at a period's end hold nothing up. The period is
closed when no source holds it any more, and, where ``hold`` is given, at the latest so long after its end, whatever the sources do. Records that
arrive at the close or later are diverted: they correct the period's aggregate until the cut-off and are listed beyond it.

Arrivals are looked at in ticks, and closes fall on their borders. What is kept of a source is one row for each period of its event times and one for each tick in
which it sent anything, both pre-aggregated before the shuffle, so a source with a third of all rows needs no more than another.

Defined results:
* records without event time or arrival time are left out; records without source hold nothing open, but are diverted like others;
* epochs in milli-, micro- or nanoseconds are brought to whole seconds; event times after their arrival are kept and move no watermark;
* a period that no source holds is closed at its end;
* of several copies of a record the one that arrived first counts (ties: lowest ``rec``);
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import staged

HOURS_BROADCAST = 200_000  # rows of 16 bytes; above this the closes are joined by shuffle
PERIOD, IDLE, CUT, TICK = 3600, 300, 6 * 3600, 60


def seconds(c: str | Column) -> Column:
    """Whole seconds of an integer epoch in s, ms, us or ns, by its magnitude."""
    c = (F.col(c) if isinstance(c, str) else c).cast("long")
    size = F.abs(c)
    return F.floor(F.when(size >= 10**17, c / F.lit(10**9)).when(size >= 10**14, c / F.lit(10**6)).when(size >= 10**11, c / F.lit(1000)).otherwise(c)).cast("long")


def first_copies(df: DataFrame, same: list[str], event: str, arrival: str, rec: str, carry: list[str] = ()) -> DataFrame:
    """Of the copies of each record, the one that arrived first: same..., event_s, arrival_s, rec, carry..."""
    rows = df.select(*[F.col(c) for c in same], seconds(event).alias("event_s"), seconds(arrival).alias("arrival_s"), F.col(rec).alias("rec"), *[F.col(c) for c in carry]).where(F.col("event_s").isNotNull() & F.col("arrival_s").isNotNull())
    first = F.min(F.struct("arrival_s", "rec", *carry)).alias("f")
    return rows.groupBy(*same, "event_s").agg(first).select(*same, "event_s", "f.*")


def _floor(c: str, width: int) -> Column:
    return (F.floor(F.col(c) / width) * width).cast("long")


def source_marks(events: DataFrame, source: str, period: int = PERIOD) -> DataFrame:
    """(source, start, shown): the first arrival of an event of a period. Marks of several batches are merged by their minimum."""
    rows = events.where(F.col(source).isNotNull() & F.col("event_s").isNotNull() & F.col("arrival_s").isNotNull())
    return rows.groupBy(F.col(source).alias("source"), _floor("event_s", period).alias("start")).agg(F.min(F.when(F.col("event_s") <= F.col("arrival_s"), F.col("arrival_s"))).alias("shown"))


def punctuation_marks(punctuations: DataFrame, source: str, period: int = PERIOD) -> DataFrame:
    """Marks of control records (source, ``bound_s``, ``arrival_s``), to be merged with those of the events."""
    rows = punctuations.where(F.col(source).isNotNull() & F.col("bound_s").isNotNull() & F.col("arrival_s").isNotNull())
    return rows.groupBy(F.col(source).alias("source"), _floor("bound_s", period).alias("start")).agg(F.min("arrival_s").alias("shown"))


def source_ticks(arrivals: DataFrame, source: str, tick: int = TICK) -> DataFrame:
    """(source, tick): when anything arrived from a source."""
    return arrivals.where(F.col(source).isNotNull() & F.col("arrival_s").isNotNull()).select(F.col(source).alias("source"), _floor("arrival_s", tick).alias("tick")).distinct()


def closes_of(marks: DataFrame, ticks: DataFrame, period: int = PERIOD, idle: int = IDLE, hold: int | None = None, tick: int = TICK) -> DataFrame:
    """(start, close) of the periods that a source holds open beyond their end; all others close at their end."""
    by_tick = Window.partitionBy("source").orderBy("tick")
    fresh = F.coalesce((F.col("tick") >= F.lag("tick").over(by_tick) + tick + idle).cast("int"), F.lit(1))
    runs = ticks.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_tick)).groupBy("source", "run").agg(F.min("tick").alias("since"), (F.max("tick") + tick + idle).alias("idle_from"))
    first = (F.floor(F.col("since") / period) + 1).cast("long") * period
    asks = runs.where(first < F.col("idle_from")).select("source", F.explode(F.sequence(first, F.col("idle_from") - 1, F.lit(period).cast("long"))).alias("end"), "idle_from")
    # a source passes an end with the first arrival of an event of any period from there on
    both = marks.select("source", F.col("start").alias("end"), "shown", F.lit(None).cast("long").alias("idle_from")).unionByName(asks.withColumn("shown", F.lit(None).cast("long")))
    on = Window.partitionBy("source").orderBy(F.desc("end")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    passed = both.withColumn("passed", F.min("shown").over(on)).where(F.col("idle_from").isNotNull())
    released = F.least("passed", "idle_from", *([F.col("end") + hold] if hold is not None else []))
    return passed.groupBy((F.col("end") - period).alias("start")).agg(F.max((F.ceil(released / tick) * tick).cast("long")).alias("close"))


def period_closes(events: DataFrame, source: str, period: int = PERIOD, idle: int = IDLE, hold: int | None = None, punctuations: DataFrame | None = None, tick: int = TICK) -> DataFrame:
    """(start, close): see :func:`closes_of`. ``events`` has ``event_s`` and ``arrival_s``; ``punctuations`` (source, ``bound_s``, ``arrival_s``)."""
    marks, ticks = source_marks(events, source, period), source_ticks(events, source, tick)
    if punctuations is not None:
        marks = marks.unionByName(punctuation_marks(punctuations, source, period))
        ticks = ticks.unionByName(source_ticks(punctuations, source, tick)).distinct()
    return closes_of(marks, ticks, period, idle, hold, tick)


def with_closes(events: DataFrame, closes: DataFrame, period: int = PERIOD) -> DataFrame:
    """The events with their period's ``start`` and ``close``."""
    closes = staged(closes, "closes")  # one small row for each period, counted and joined
    table = F.broadcast(closes) if closes.count() <= HOURS_BROADCAST else closes
    return events.withColumn("start", _floor("event_s", period)).join(table, "start", "left").withColumn("close", F.coalesce("close", F.col("start") + period))


def divert(events: DataFrame, closes: DataFrame, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """(in time, diverted): what arrived before its period's close and what arrived at it or later."""
    joined = with_closes(events, closes, period)
    after = F.col("arrival_s") >= F.col("close")
    return joined.where(~after), joined.where(after)


def fates(events: DataFrame, source: str, period: int = PERIOD, idle: int = IDLE, hold: int | None = None, cut: int = CUT, grace: int | None = None, punctuations: DataFrame | None = None) -> DataFrame:
    """The diverted records with ``fate``: 'late' up to ``cut`` seconds after the period's end, 'cut' beyond.

    With ``grace`` an exact check on the times follows: records that arrived at most so long after the end are no late ones, though their period
    was closed. ``hold`` must not be longer than ``grace`` then, or records would be in time for a period that is held open longer.
    """
    if grace is not None and (hold is None or hold > grace):
        raise ValueError("a period held longer than the grace would take late records in")
    events = staged(events, "events")  # asked for the closes and for the records
    _, late = divert(events, period_closes(events, source, period, idle, hold, punctuations), period)
    behind = F.col("arrival_s") - (F.col("start") + period)
    late = late if grace is None else late.where(behind > grace)
    return late.withColumn("fate", F.when(behind <= cut, F.lit("late")).otherwise(F.lit("cut")))


def corrected_aggregates(events: DataFrame, source: str, value: str, period: int = PERIOD, idle: int = IDLE, hold: int | None = None, cut: int = CUT, punctuations: DataFrame | None = None) -> DataFrame:
    """Aggregates of each period as published at its close and as corrected until the cut-off.

    (start, close, n_on_time, n_late, n_cut, total_at_close, total, least, most): ``total``, ``least`` and ``most`` hold all records but those cut off.
    """
    events = staged(events, "events")
    rows = with_closes(events, period_closes(events, source, period, idle, hold, punctuations), period)
    on_time = F.col("arrival_s") < F.col("close")
    kept = on_time | (F.col("arrival_s") - (F.col("start") + period) <= cut)
    v = F.col(value)
    return rows.groupBy("start").agg(F.max("close").alias("close"), F.count_if(on_time).alias("n_on_time"), F.count_if(~on_time & kept).alias("n_late"), F.count_if(~kept).alias("n_cut"), F.sum(F.when(on_time, v)).alias("total_at_close"), F.sum(F.when(kept, v)).alias("total"), F.min(F.when(kept, v)).alias("least"), F.max(F.when(kept, v)).alias("most"))
