"""Joins on ranges: overlap, longest prefix, last boundary, next event; and flattening of nested ranges.

None of these is a hash join as written, so each is rewritten into equi-joins on cells. Cells come in sizes of powers of two: an
interval of length n lies in at most two cells of the least size that isn't below n, so wide intervals cost as little as narrow ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The least k with 2^k >= length."""
    return F.ceil(F.log2((end - start + 1).cast("double"))).cast("int")


def _cells(df: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
    """A row for each (level, cell) that the interval touches, at the levels given; at most two for each level."""
    size = lambda k: F.pow(F.lit(2.0), k).cast("long")
    floor = lambda x, k: F.floor(x / size(k)).cast("long")
    out = df.withColumn("__level", F.explode(levels))
    first, last = floor(F.col(start), F.col("__level")), floor(F.col(end), F.col("__level"))
    return out.withColumn("__first", first).withColumn("__cell", F.explode(F.array_distinct(F.array(first, last))))


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str] = ("start", "end"), b_range: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Every pair of overlapping inclusive ranges: all columns of both (b's with ``b_`` before clashing names) and ``overlap``, the size of the common part."""
    names = {c: (f"b_{c}" if c in a.columns else c) for c in b.columns}
    b = b.select(*[F.col(c).alias(n) for c, n in names.items()])
    a0, a1, b0, b1 = *a_range, *[names[x] for x in b_range]
    a = a.where(F.col(a0) <= F.col(a1)).withColumn("__la", _level(F.col(a0), F.col(a1)))
    b = b.where(F.col(b0) <= F.col(b1)).withColumn("__lb", _level(F.col(b0), F.col(b1)))
    # levels that occur: at most 64 numbers
    la = sorted(r[0] for r in a.select("__la").distinct().collect())
    lb = sorted(r[0] for r in b.select("__lb").distinct().collect())
    at = lambda own, levels: F.filter(F.array(*[F.lit(x) for x in levels] or [F.lit(None).cast("int")]), lambda k: k >= own)
    # a pair meets at the larger of its two levels
    both = sorted({*la, *lb})
    left = _cells(a, a0, a1, at(F.col("__la"), both))
    right = _cells(b, b0, b1, at(F.col("__lb"), both)).withColumnsRenamed({"__level": "__blevel", "__cell": "__bcell", "__first": "__bfirst"})
    hit = (F.col("__level") == F.col("__blevel")) & (F.col("__cell") == F.col("__bcell"))
    pairs = left.join(right, hit).where((F.col("__level") == F.greatest("__la", "__lb")) & (F.col("__cell") == F.greatest("__first", "__bfirst")) & (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)))
    size = F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0)) + 1
    return pairs.withColumn("overlap", size).select(*a.columns[:-1], *b.columns[:-1], "overlap")


def longest_prefix(probes: DataFrame, address: str, table: DataFrame, lo: str = "lo", plen: str = "plen", bits: int = 32) -> DataFrame:
    """Each probe with the longest prefix of the table that holds its address (left join).

    Distinct addresses are masked to each length that the table has (at most ``bits`` + 1) and joined by equality.
    """
    lengths = sorted(r[0] for r in table.select(plen).distinct().collect() if r[0] is not None)
    distinct = probes.select(F.col(address).alias("__a")).where(F.col("__a").isNotNull()).distinct()
    masks = F.array(*[F.struct(F.lit(n).alias("n"), (F.col("__a") - F.pmod(F.col("__a"), F.lit(1 << (bits - n)))).alias("lo")) for n in lengths] or [F.struct(F.lit(-1).alias("n"), F.lit(-1).cast("long").alias("lo"))])
    masked = distinct.withColumn("m", F.explode(masks)).select("__a", F.col("m.n").alias("__n"), F.col("m.lo").alias("__lo"))
    carried = [c for c in table.columns]
    rows = table.select(F.col(lo).alias("__lo"), F.col(plen).alias("__n"), F.struct(*carried).alias("__row"))
    best = masked.join(rows, ["__lo", "__n"]).groupBy("__a").agg(F.max_by("__row", "__n").alias("__row"))
    out = probes.join(best, F.col(address) == F.col("__a"), "left")
    names = {c: (f"t_{c}" if c in probes.columns else c) for c in carried}
    return out.select(*[F.col(c) for c in probes.columns], *[F.col("__row")[c].alias(n) for c, n in names.items()])


def longest_prefix_any(probes: DataFrame, address: str, table: DataFrame, lo: str = "lo", plen: str = "plen") -> DataFrame:
    """As :func:`longest_prefix` for addresses of 16 bytes (IPv4 ones mapped), so both families are matched at once.

    ``plen`` counts from the first of the 128 bits: 96 more than an IPv4 prefix's own length.
    """
    lengths = sorted(r[0] for r in table.select(plen).distinct().collect() if r[0] is not None)

    @F.pandas_udf("array<binary>")
    def masked(addresses):
        def cut(a):
            n = int.from_bytes(a, "big")
            return [(n >> (128 - k) << (128 - k)).to_bytes(16, "big") for k in lengths]

        return addresses.map(cut)

    distinct = probes.select(F.col(address).alias("__a")).where(F.col("__a").isNotNull()).distinct()
    each = distinct.select("__a", F.posexplode(masked("__a")).alias("__i", "__lo")).withColumn("__n", F.element_at(F.array(*[F.lit(k) for k in lengths] or [F.lit(-1)]), F.col("__i") + 1))
    rows = table.select(F.col(lo).alias("__lo"), F.col(plen).alias("__n"), F.struct(*table.columns).alias("__row"))
    best = each.join(rows, ["__lo", "__n"]).groupBy("__a").agg(F.max_by("__row", "__n").alias("__row"))
    names = {c: (f"t_{c}" if c in probes.columns else c) for c in table.columns}
    return probes.join(best, F.col(address) == F.col("__a"), "left").select(*probes.columns, *[F.col("__row")[c].alias(n) for c, n in names.items()])


def prefixes_inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Every prefix of ``inner`` inside one of ``outer``, itself included: (version, lo, plen) as :func:`net.cidr` gives them, inner's other columns with ``b_``.

    Each inner prefix is cut to every length that the outer ones of its family have, at most its own, and joined by equality.
    """
    from weftline.functions.net import first_bits

    # lengths that occur: at most 33 and 129 numbers
    have = outer.select("version", "plen").distinct().collect()
    of = lambda v: F.array(*[F.lit(r.plen) for r in have if r.version == v] or [F.lit(None).cast("int")])
    wider = F.filter(F.when(F.col("version") == 4, of(4)).otherwise(of(6)), lambda k: k <= F.col("plen"))
    b = inner.withColumn("__n", F.explode(wider))
    b = b.withColumn("__lo", first_bits("lo", F.col("__n") + F.when(F.col("version") == 4, 96).otherwise(0)))
    b = b.select(F.col("version").alias("__v"), "__n", "__lo", *[F.col(c).alias(f"b_{c}") for c in inner.columns])
    hit = (F.col("version") == F.col("__v")) & (F.col("plen") == F.col("__n")) & (F.col("lo") == F.col("__lo"))
    return outer.join(b, hit).drop("__v", "__n", "__lo")


def last_before(left: DataFrame, right: DataFrame, at: str, right_at: str, value: str, by: list[str] = (), cell: int = 1 << 16, strict: bool = False, forward: bool = False) -> DataFrame:
    """As-of join: each left row with the value of the last right row at or before it (``forward``: the first at or after it), by group.

    Two steps instead of one window over everything: within cells of the axis, then from the nearest earlier cell that holds anything. Left
    rows with one and the same place are resolved once.
    """
    by = list(by)
    sign = -1 if forward else 1
    keys = left.select(*by, F.col(at).alias("__at")).where(F.col(at).isNotNull()).distinct()
    tie = F.lit(0 if strict else 1)
    l_rows = keys.select(*by, (sign * F.col("__at")).alias("__x"), tie.alias("__side"), F.lit(None).cast("struct<v:" + right.schema[value].dataType.simpleString() + ">").alias("__v"), F.lit(True).alias("__left"))
    r_rows = right.where(F.col(right_at).isNotNull()).select(*by, (sign * F.col(right_at)).alias("__x"), F.lit(1 if strict else 0).alias("__side"), F.struct(F.col(value).alias("v")).alias("__v"), F.lit(False).alias("__left"))
    both = l_rows.unionByName(r_rows).withColumn("__cell", F.floor(F.col("__x") / cell))
    w = Window.partitionBy(*by, "__cell").orderBy("__x", "__side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__found", F.last("__v", True).over(w))
    ends = both.groupBy(*by, "__cell").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__x"))).alias("__end"))
    over = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", True).over(over)).drop("__end")
    same = F.lit(True)
    c2 = carry.select(*[F.col(b).alias(f"__c_{b}") for b in by], F.col("__cell").alias("__c_cell"), "__carry")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__c_{b}"))
    found = inside.where("__left").join(c2, same & (F.col("__cell") == F.col("__c_cell")), "left").select(*[F.col(b).alias(f"__k_{b}") for b in by], (sign * F.col("__x")).alias("__k_at"), F.coalesce("__found", "__carry").alias("__hit"))
    on = F.col(at) == F.col("__k_at")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return left.join(found, on, "left").select(*left.columns, F.col("__hit.v").alias(value))


def running_max(df: DataFrame, order: str, value: str, out: str, tie: list[str], cell: int = 1 << 16) -> DataFrame:
    """Largest ``value`` of all earlier rows by (order, tie), null for the first: within cells, then over the cells."""
    rows = df.withColumn("__cell", F.floor(F.col(order) / cell))
    w = Window.partitionBy("__cell").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("__cell").agg(F.max(value).alias("__top")).withColumn("__carry", F.max("__top").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    return rows.withColumn("__in", F.max(value).over(w)).join(tops, "__cell").withColumn(out, F.greatest("__in", "__carry")).drop("__cell", "__in", "__carry")


def boundaries(df: DataFrame, start: str = "start", end: str = "end", owner: str = "asn", last: int = (1 << 32) - 1, cell: int = 1 << 16) -> DataFrame:
    """(start, owner) where the owner changes along the axis, 0 in gaps: nested ranges are dropped, overlaps cut, the earlier range wins.

    A range that begins at or before the largest end so far is cut to begin after it, or dropped if it ends there.
    """
    rows = df.where(F.col(start) <= F.col(end)).select(F.col(start).alias("s"), F.col(end).alias("e"), F.col(owner).alias("o"))
    run = running_max(rows, "s", "e", "before", ["e", "o"], cell)
    before = F.coalesce("before", F.lit(-1).cast("long"))
    kept = run.where(F.col("e") > before).withColumn("b", before).withColumn("s", F.greatest("s", before + 1))
    gap = F.when(F.col("s") > F.col("b") + 1, F.struct((F.col("b") + 1).alias("at"), F.lit(0).cast("long").alias("o")))
    marks = kept.select(F.explode(F.array_compact(F.array(gap, F.struct(F.col("s").alias("at"), F.col("o").cast("long").alias("o"))))).alias("m")).select("m.at", "m.o")
    tail = rows.agg(F.coalesce(F.max("e") + 1, F.lit(0).cast("long")).alias("at")).where(F.col("at") <= last).withColumn("o", F.lit(0).cast("long"))
    marks = marks.unionByName(tail)
    # equal neighbours merge: what stands before each mark
    seen = marks.withColumn("cell", F.floor(F.col("at") / cell))
    w = Window.partitionBy("cell").orderBy("at")
    ends = seen.groupBy("cell").agg(F.max_by("o", "at").alias("end")).withColumn("carry", F.lag("end").over(Window.orderBy("cell"))).drop("end")
    return seen.join(ends, "cell").withColumn("prev", F.coalesce(F.lag("o").over(w), "carry")).where(F.col("prev").isNull() | (F.col("prev") != F.col("o"))).select(F.col("at").alias(start), F.col("o").alias(owner))


def nearest_k(left: DataFrame, right: DataFrame, left_key: list[str], score: Column, tie: list[str], k: int = 1, most_bytes: int = 8 << 20, row_bytes: int = 64) -> DataFrame:
    """The ``k`` best right rows for each left row by ascending ``score``; for a small table of centres.

    The right side is counted: within ``most_bytes`` it is broadcast; a larger one is refused, as all pairs would be made: for positions
    ``spatial.nearest_points`` finds the nearest of any number.
    """
    n = right.count()
    if n * row_bytes > most_bytes:
        raise ValueError(f"{n} centres are too many to compare all with all; use spatial.nearest_points")
    w = Window.partitionBy(*left_key).orderBy("score", *tie)
    return left.join(F.broadcast(right)).withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
