"""Aggregates over ranges and places: what a network owns and where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geo import haversine
from weftline.operators.intervals import overlap_join


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    """(by..., out): the value with the most weight in each group; ties go to the lowest value. Two pre-aggregated levels."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*by).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(value).alias("v"))).alias("k")).select(*by, F.col("k.v").alias(out))


def cell_of(lat: str = "lat", lon: str = "lon"):
    """Number of the one-degree cell of a position."""
    return (F.floor(F.col(lat) + 90) * 360 + F.floor(F.col(lon) + 180)).cast("long")


def located_ranges(prefixes: DataFrame, places: DataFrame) -> DataFrame:
    """(asn, lat, lon, cc, city, w): the common parts of owned ranges and placed ranges, by network and place."""
    j = overlap_join(prefixes, places)
    return j.groupBy("asn", "lat", "lon", "cc", "city").agg(F.sum("overlap").alias("w"))


def profile_networks(prefixes: DataFrame, places: DataFrame, near_km: float = 400.0, top: int = 32) -> DataFrame:
    """One row for each network: addresses, ranges, main place, share of weight near it, country and the largest sites.

    Everything after the range join is keyed by network, and the join's result is collapsed to (network, place) first.
    """
    own = prefixes.groupBy("asn").agg(F.sum(F.col("end") - F.col("start") + 1).alias("addresses"), F.count("*").alias("ranges"))
    at = located_ranges(prefixes, places).withColumn("cell", cell_of())
    main = main_places(at)
    near = concentration(at, main, near_km)
    country = weighted_mode(at, ["asn"], "cc", "w", "country")
    return own.join(main, "asn", "left").join(near, "asn", "left").join(country, "asn", "left").join(top_sites(at, top), "asn", "left").withColumn("has_geo", F.col("lat").isNotNull())


def main_places(at: DataFrame) -> DataFrame:
    """(asn, lat, lon, total): weighted mean position within each network's heaviest cell."""
    at = at if "cell" in at.columns else at.withColumn("cell", cell_of())
    cells = at.groupBy("asn", "cell").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("lat")).alias("y"), F.sum(F.col("w") * F.col("lon")).alias("x"))
    best = cells.groupBy("asn").agg(F.min(F.struct((-F.col("w")).alias("w"), "cell", "y", "x")).alias("k"), F.sum("w").alias("total"))
    return best.select("asn", (F.col("k.y") / -F.col("k.w")).alias("lat"), (F.col("k.x") / -F.col("k.w")).alias("lon"), "total")


def concentration(at: DataFrame, main: DataFrame, near_km: float = 400.0) -> DataFrame:
    """(asn, concentration): share of weight within ``near_km`` of the main place."""
    j = at.join(main.select("asn", F.col("lat").alias("mlat"), F.col("lon").alias("mlon")), "asn")
    near = F.when(haversine("lat", "lon", "mlat", "mlon") <= near_km, F.col("w")).otherwise(0)
    return j.groupBy("asn").agg((F.sum(near) / F.sum("w")).alias("concentration"))


def top_sites(at: DataFrame, top: int = 32) -> DataFrame:
    """(asn, sites): each network's largest cities as array<struct<city, lat, lon, share>>, largest first."""
    city = at.groupBy("asn", "city").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("lat")).alias("y"), F.sum(F.col("w") * F.col("lon")).alias("x"))
    w = Window.partitionBy("asn")
    ranked = city.withColumn("total", F.sum("w").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("w"), "city"))).where(F.col("k") <= top)
    site = F.struct("k", "city", (F.col("y") / F.col("w")).alias("lat"), (F.col("x") / F.col("w")).alias("lon"), (F.col("w") / F.col("total")).alias("share"))
    return ranked.groupBy("asn").agg(F.transform(F.array_sort(F.collect_list(site)), lambda s: F.struct(s["city"].alias("city"), s["lat"].alias("lat"), s["lon"].alias("lon"), s["share"].alias("share"))).alias("sites"))


def fan_out(points: DataFrame, key: str, weight: str, spacing_m: float = 900.0) -> DataFrame:
    """(key, lat, lon): points of one place spread on a sunflower spiral, the heaviest stays. Places are told apart by 0.02 degrees."""
    cell = F.struct(F.bround(F.col("lat") * 50).cast("long").alias("y"), F.bround(F.col("lon") * 50).cast("long").alias("x"))
    k = F.row_number().over(Window.partitionBy(cell).orderBy(F.desc(weight), key)) - 1
    p = points.withColumn("__k", k)
    r = spacing_m * F.sqrt(F.col("__k").cast("double"))
    turn = F.col("__k") * 2.399963229728653
    lat = F.col("lat") + r * F.sin(turn) / 111320.0
    lon = F.col("lon") + r * F.cos(turn) / (111320.0 * F.cos(F.radians(F.greatest(F.lit(-80.0), F.least(F.lit(80.0), F.col("lat"))))))
    return p.select(key, F.least(F.lit(84.95112878), F.greatest(F.lit(-84.95112878), lat)).alias("lat"), lon.alias("lon"))


def fibers(links: DataFrame, cell: float, least: int = 2) -> DataFrame:
    """Links bundled by the unordered pair of grid cells of their ends (ax, ay, bx, by in the unit square): one row for each bundle.

    Links within one cell stay alone. The ends' mean is over members, whatever their weights.
    """
    wide = int(1 / cell) + 3
    at = lambda x, y: (F.floor(F.col(y) / cell) * wide + F.floor(F.col(x) / cell)).cast("long")
    e = links.withColumn("ca", at("ax", "ay")).withColumn("cb", at("bx", "by")).where("ca <> cb").withColumn("swap", F.col("ca") > F.col("cb"))
    pick = lambda p, q: F.when(F.col("swap"), F.col(q)).otherwise(F.col(p))
    e = e.select(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"), "eid", "rel", *[pick(p, q).alias(n) for p, q, n in (("ax", "bx", "sx"), ("ay", "by", "sy"), ("bx", "ax", "tx"), ("by", "ay", "ty"))])
    g = e.groupBy("lo", "hi").agg(F.count("*").alias("members"), F.count_if(F.col("rel") != 0).alias("transit"), F.count_if(F.col("rel") == 0).alias("peering"), *[F.avg(c).alias(c) for c in ("sx", "sy", "tx", "ty")])
    return g.where(F.col("members") >= least)
