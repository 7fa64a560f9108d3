"""Where things are: gazetteers of airports, hints in routers' names, airports of PoPs, a chain of fallbacks for places, and exchanges by their facilities.

Reference lists (airports, facilities) are joined as they are, or broadcast where their size is bounded by what they are keyed by (three-letter codes).

Defined results: rows with null names or codes match nothing; of equal keys the best-ranked, then lowest, row holds; repeated rows count once;
extra columns are ignored; an empty list matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import geo, text

# Metropolitan area codes and the area's main airport.
METRO = {
    "bjs": "pek", "bue": "eze", "buh": "otp", "chi": "ord", "dtt": "dtw", "jkt": "cgk",
    "lon": "lhr", "mil": "mxp", "mow": "svo", "nyc": "jfk", "osa": "kix", "par": "cdg",
    "rio": "gig", "rom": "fco", "sao": "gru", "sel": "icn", "spk": "cts", "sto": "arn",
    "tyo": "nrt", "was": "iad", "ymq": "yul", "yto": "yyz", "rek": "kef", "yea": "yeg",
}
# Kinds of airports, best first; kinds that aren't named come before closed ones.
KINDS = ("large_airport", "medium_airport", "small_airport", "heliport", "seaplane_base", "balloonport")
CENTRAL = KINDS[:3]


def gazetteer(airports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes, cities) of airports (id, code, city, lat, lon): the first row, by id, of each three-letter code and of each city's letters, five or more."""
    code = F.lower(F.trim("code"))
    rows = airports.where(code.rlike("^[a-z]{3}$") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    letters = F.regexp_replace(F.lower("city"), "[^a-z]", "")
    place = F.struct("id", F.upper(code).alias("place"), "city", "lat", "lon")
    codes = rows.groupBy(code.alias("code")).agg(F.min(place).alias("p")).select("code", "p.*")
    cities = rows.withColumn("letters", letters).where(F.length("letters") >= 5).groupBy("letters").agg(F.min(place).alias("p")).select("letters", "p.*")
    return codes, cities


def host_hints(hosts: DataFrame, key: str, host: str, codes: DataFrame, cities: DataFrame) -> DataFrame:
    """(key, pos, token, kind, digits, id): the places that the tokens of router names may mean; the last two labels are the operator's and mean none.

    A token of three letters is a code if digits follow it or if it stands inside the name, and it is no word of the trade; any other token
    of five letters or more, without its final digits, may be a city.
    """
    name = F.lower(F.col(host))
    labels = F.split(name, r"\.")
    own = F.when(F.size(labels) >= 2, F.flatten(F.transform(F.slice(labels, F.size(labels) - 1, 2), lambda t: F.split(t, "[-_]")))).otherwise(F.array().cast("array<string>"))
    tokens = F.filter(F.split(name, r"[.\-_]"), lambda t: t != "")
    t = hosts.where(F.col(host).isNotNull()).select(F.col(key).alias("key"), own.alias("own"), F.size(tokens).alias("n"), F.posexplode(tokens).alias("pos", "token")).where(~F.array_contains("own", F.col("token")))
    shape = r"^([a-z]{3})(\d{1,3}(?:[a-z]{1,2}\d{0,3})?)?$"
    t = t.select("key", "n", "pos", "token", F.regexp_extract("token", shape, 1).alias("code"), (F.regexp_extract("token", shape, 2) != "").alias("digits"), F.regexp_replace("token", r"\d+$", "").alias("letters"))
    inside = F.col("digits") | ((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 2))
    known = codes.where(~F.col("code").isin(*text.STOP_WORDS)).select("code", F.col("id").alias("code_id"))
    j = t.join(F.broadcast(known), "code", "left").withColumn("is_code", F.col("code_id").isNotNull() & inside)  # at most 26^3 codes
    j = j.withColumn("letters", F.when(~F.col("is_code") & (F.length("letters") >= 5), F.col("letters")))
    j = j.join(cities.select("letters", F.col("id").alias("city_id")), "letters", "left").where(F.col("is_code") | F.col("city_id").isNotNull())
    kind = F.when(F.col("is_code"), "iata").otherwise("city")
    return j.select("key", "pos", "token", kind.alias("kind"), (F.col("is_code") & F.col("digits")).alias("digits"), F.when(F.col("is_code"), F.col("code_id")).otherwise(F.col("city_id")).alias("id"))


def locate(hints: DataFrame) -> DataFrame:
    """(key, token, kind, id): the best hint: a city, then a code with digits, then a bare code; of equals the first in the name."""
    rank = F.when(F.col("kind") == "city", 0).when(F.col("digits"), 1).otherwise(2)
    return hints.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "pos", "token", "kind", "id")).alias("h")).select("key", "h.token", "h.kind", "h.id")


def ranked(airports: DataFrame) -> DataFrame:
    """Airports with a position and ``rank``: a struct whose least is the best: kind, scheduled service, id."""
    kind = F.col("type")
    order = F.lit(8)
    for i, k in enumerate(KINDS):
        order = F.when(kind == k, i).otherwise(order)
    order = F.when(kind == "closed", 9).otherwise(order)
    rows = airports.where(F.col("latitude_deg").isNotNull() & F.col("longitude_deg").isNotNull())
    return rows.withColumn("rank", F.struct(order.alias("kind"), (~F.coalesce(F.col("scheduled_service") == "yes", F.lit(False))).alias("unscheduled"), F.col("id").alias("id")))


def airport_of(pops: DataFrame, code: str, airports: DataFrame, metro: dict[str, str] = METRO) -> DataFrame:
    """``pops`` with ``airport`` and ``how`` it was found: 'iata', by the code without final digits, or 'metro', by the area's main airport."""
    best = ranked(airports).where(F.length(F.trim("iata_code")) == 3).groupBy(F.lower(F.trim("iata_code")).alias("k")).agg(F.min("rank").alias("r")).select("k", F.col("r.id").alias("airport"))
    best = F.broadcast(best)  # at most one row for each code of three characters
    bare = F.regexp_replace(F.lower(F.col(code)), r"\d+$", "")
    main = F.create_map(*[F.lit(x) for kv in metro.items() for x in kv])[F.col("__bare")] if metro else F.lit(None).cast("string")
    j = pops.withColumn("__bare", F.when(F.length(bare) == 3, bare)).withColumn("__main", main)
    j = j.join(best.select(F.col("k").alias("__bare"), F.col("airport").alias("__a")), "__bare", "left").join(best.select(F.col("k").alias("__main"), F.col("airport").alias("__b")), "__main", "left")
    how = F.when(F.col("__a").isNotNull(), "iata").when(F.col("__b").isNotNull(), "metro")
    return j.withColumn("airport", F.coalesce("__a", "__b")).withColumn("how", how).drop("__bare", "__main", "__a", "__b")


def _middle(df: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """(key, lat, lon): the mean direction of positions; none where they cancel out."""
    v = geo.unit_vector("latitude_deg", "longitude_deg")
    pick = (lambda c: F.when(where, c)) if where is not None else (lambda c: c)
    g = df.groupBy(key).agg(*[F.sum(pick(c)).alias(n) for n, c in zip("xyz", v, strict=True)])
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return g.where(r >= 1e-9).select(key, F.degrees(F.asin(F.col("z") / r)).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"))


def centroids(airports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, countries): the middle of each one's airports; a country that only has other kinds of sites is placed by those."""
    a = airports.where(F.col("latitude_deg").isNotNull() & F.col("longitude_deg").isNotNull())
    central = F.col("type").isin(*CENTRAL)
    regions = _middle(a.where(central & F.col("iso_region").isNotNull()), "iso_region")
    c = a.where(F.col("iso_country").isNotNull())
    first = _middle(c.where(central), "iso_country")
    rest = _middle(c, "iso_country").join(c.where(central).select("iso_country").distinct(), "iso_country", "left_anti")
    return regions, first.unionByName(rest)


def place_of(rows: DataFrame, country: str, region: str, city: str, airports: DataFrame) -> DataFrame:
    """``rows`` with ``lat``, ``lon`` and ``precision``: the best airport of the city in the region, then in the country; the middle of the region, then of the
    country; then the city anywhere. Names of larger airports' keywords name their city too."""
    a = ranked(airports)
    large = F.col("type").isin(*KINDS[:2])
    names = F.filter(F.concat(F.array("municipality"), F.when(large & F.col("keywords").isNotNull(), F.split("keywords", ",")).otherwise(F.array().cast("array<string>"))), lambda n: n.isNotNull())
    named = a.select("iso_country", "iso_region", "rank", "latitude_deg", "longitude_deg", F.explode(names).alias("name")).withColumn("fold", text.fold_name("name")).where("fold <> ''")
    best = lambda keys, p: named.groupBy(*keys).agg(F.min(F.struct("rank", F.struct(F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon")).alias("at"))).alias("k")).select(*keys, F.col("k.at").alias(p))
    regions, countries = centroids(airports)
    at = lambda d, p: d.select(d.columns[0], F.struct("lat", "lon").alias(p))
    j = rows.withColumn("iso_country", F.col(country)).withColumn("iso_region", F.col(region)).withColumn("fold", text.fold_name(city))
    for keys, p in ((["iso_country", "iso_region", "fold"], "__1"), (["iso_country", "fold"], "__2"), (["fold"], "__5")):
        j = j.join(best(keys, p), keys, "left")
    j = j.join(at(regions, "__3"), "iso_region", "left").join(at(countries, "__4"), "iso_country", "left")
    hit = F.coalesce("__1", "__2", "__3", "__4", "__5")
    precision = F.when(F.col("__1").isNotNull() | F.col("__2").isNotNull(), "city").when(F.col("__3").isNotNull(), "region").when(F.col("__4").isNotNull(), "country").when(F.col("__5").isNotNull(), "city")
    return j.withColumn("precision", precision).withColumn("lat", hit["lat"]).withColumn("lon", hit["lon"]).drop("iso_country", "iso_region", "fold", *[f"__{i}" for i in range(1, 6)])


def exchanges(ports: DataFrame, mine: DataFrame, ix: DataFrame, at: DataFrame, fac: DataFrame) -> DataFrame:
    """Exchanges of a network by their records: (id, name, city, country, located, lat, lon, ports, speed).

    ``ports`` (ix_id, name, speed, operational), ``mine`` (fac_id), ``ix`` (id, name, city, country), ``at`` (ix_id, fac_id), ``fac`` (id, city, country,
    latitude, longitude). Ports that are out of operation don't count. An exchange lies at the mean of the first group of its facilities with a
    position that isn't empty: shared ones in its city, its own there, shared ones in its country, its own there, shared ones, its own.
    """
    p = ports.where(F.coalesce("operational", F.lit(True)) & F.col("ix_id").isNotNull()).groupBy(F.col("ix_id").alias("id")).agg(F.count("*").alias("ports"), F.sum(F.coalesce("speed", F.lit(0))).alias("speed"), F.min("name").alias("port_name"))
    rec = ix.select("id", "name", "city", "country").groupBy("id").agg(F.min(F.struct("name", "city", "country")).alias("r")).select("id", "r.*")
    j = p.join(rec, "id", "left")
    shared = mine.select(F.col("fac_id").alias("fid")).distinct().withColumn("mine", F.lit(True))
    placed = fac.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(F.col("id").alias("fid"), F.lower(F.trim("city")).alias("fcity"), F.col("country").alias("fcountry"), "latitude", "longitude").dropDuplicates(["fid"])
    f = at.select(F.col("ix_id").alias("id"), F.col("fac_id").alias("fid")).distinct().join(placed, "fid").join(shared, "fid", "left")
    f = f.join(j.select("id", F.lower(F.trim("city")).alias("c"), "country"), "id")
    own, in_city, in_country = F.coalesce("mine", F.lit(False)), F.coalesce((F.col("c") != "") & (F.col("fcity") == F.col("c")), F.lit(False)), F.coalesce((F.col("country") != "") & (F.col("fcountry") == F.col("country")), F.lit(False))
    level = F.when(own & in_city, 0).when(in_city, 1).when(own & in_country, 2).when(in_country, 3).when(own, 4).otherwise(5)
    # a shared facility in the city belongs to the city's group too; groups are tried in order, so the least level that occurs decides who is in
    f = f.withColumn("levels", F.array_compact(F.array(level, F.when(in_city, 1), F.when(own & in_country, 2), F.when(in_country, 3), F.when(own, 4), F.lit(5)))).select("id", "latitude", "longitude", F.explode(F.array_distinct("levels")).alias("level"))
    g = f.groupBy("id", "level").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    first = g.groupBy("id").agg(F.min(F.struct("level", "lat", "lon")).alias("k")).select("id", F.when(F.col("k.level") % 2 == 0, "shared").otherwise("ix").alias("located"), "k.lat", "k.lon")
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("port_name", F.lit("")), F.concat(F.lit("IX "), F.col("id")))
    return j.join(first, "id", "left").select("id", name.alias("name"), F.coalesce("city", F.lit("")).alias("city"), F.coalesce("country", F.lit("")).alias("country"), "located", "lat", "lon", "ports", "speed")
