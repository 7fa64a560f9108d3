"""Rows in order within groups: islands on a circle, densest stretches, and choices that lean on the ones before.

The first is windows; the other two depend on what they have done before and run over one group at a time: a trace's hops or one band of orbits.
Empty tables give no rows; nulls in the ordering column sort first; other columns are ignored where only keys and results come out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def circle_islands(df: DataFrame, group: str, angle: str, key: str, gap: float) -> DataFrame:
    """``df`` with ``pos`` (the place after the circle's widest gap) and ``island``, which a gap of more than ``gap`` degrees ends.

    Of equal widest gaps the first from zero is cut. Angles are in 0..360.
    """
    by = Window.partitionBy(group)
    order = by.orderBy(angle, key)
    w = df.withColumn("__r", F.row_number().over(order)).withColumn("__c", F.count("*").over(by)).withColumn("__gap", F.coalesce(F.lead(angle).over(order), F.min(angle).over(by) + 360) - F.col(angle))
    cut = F.first("__r").over(by.orderBy(F.desc("__gap"), "__r"))
    w = w.withColumn("__cut", cut).withColumn("pos", (F.col("__r") - F.col("__cut") - 1 + F.col("__c")) % F.col("__c"))
    turned = by.orderBy("pos")
    w = w.withColumn("__before", F.lag("__gap").over(turned))
    island = F.sum(F.when(F.col("__before") > gap, 1).otherwise(0)).over(turned).cast("int")
    return w.withColumn("island", island).drop("__r", "__c", "__gap", "__cut", "__before")


def densest_stretches(df: DataFrame, group: str, value: str, key: str, width: float, least: int) -> DataFrame:
    """(group, shell, lo, members): the stretches of ``width`` that hold most values of a group, taken out one after the other while one holds ``least``.

    Of equal stretches the lowest is taken first.
    """
    kind = df.schema[group].dataType.simpleString()

    def take(p: pd.DataFrame) -> pd.DataFrame:
        a, out = np.sort(p[value].dropna().to_numpy(float)), []
        while len(a) >= least:
            n = np.searchsorted(a, a + width, "right") - np.searchsorted(a, a, "left")
            i = int(np.argmax(n))
            if n[i] < least:
                break
            out.append((p[group].iloc[0], len(out), float(a[i]), int(n[i])))
            a = a[(a < a[i]) | (a > a[i] + width)]
        return pd.DataFrame(out, columns=[group, "shell", "lo", "members"])

    return df.select(group, value).groupBy(group).applyInPandas(take, f"{group} {kind}, shell int, lo double, members long")


def locate_along(df: DataFrame, group: str, order: str, options: str, out: str) -> DataFrame:
    """(group, order, out): rows with one option are fixed; others take the option nearest the last located row, else the next fixed one.

    A row that is located this way anchors those after it; without any fixed row a group stays unlocated. Of equal options the first is taken.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        lists = [list(x) if x is not None else [] for x in p[options]]
        found: list = [x[0] if len(x) == 1 else None for x in lists]
        later, nxt = [None] * len(lists), None
        for i in range(len(lists) - 1, -1, -1):
            nxt = found[i] if found[i] is not None else nxt
            later[i] = nxt
        last = None
        for i, x in enumerate(lists):
            if found[i] is None and x:
                at = last if last is not None else later[i]
                if at is not None:
                    found[i] = min(x, key=lambda v: abs(v - at))
            last = found[i] if found[i] is not None else last
        return pd.DataFrame({group: p[group], order: p[order], out: pd.array(found, "Float64")})

    return df.select(group, order, options).groupBy(group).applyInPandas(walk, f"{group} {kinds[group]}, {order} {kinds[order]}, {out} double")
