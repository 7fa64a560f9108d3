"""Places: hints in names, airports of codes, fallbacks and exchanges, on small made-up lists."""

from weftline.operators import places

AIRPORTS = "id long, type string, latitude_deg double, longitude_deg double, iso_country string, iso_region string, municipality string, iata_code string, keywords string, scheduled_service string, name string"


def airports(spark):
    return spark.createDataFrame(
        [
            (1, "large_airport", 51.0, 0.0, "GB", "GB-ENG", "London", "LHR", "Greater Smoke, Saint Pauls", "yes", "x"),
            (2, "small_airport", 52.0, 1.0, "GB", "GB-ENG", "London", "LCY", "Tiny", "no", "x"),
            (3, "heliport", 43.7, 7.4, "MC", "MC-01", "Monaco", None, None, None, "x"),
            (4, "closed", 10.0, 10.0, "GB", None, "Nowhere (old)", "OLD", None, None, "x"),
            (5, "large_airport", 0.0, 179.0, "FJ", "FJ-A", "Suva", "SUV", None, "yes", "x"),
            (6, "medium_airport", 0.0, -179.0, "FJ", "FJ-A", "Nadi", "NAN", None, "yes", "x"),
            (7, "large_airport", None, 3.0, "FR", "FR-J", "Paris", "CDG", None, "yes", "x"),
            (1, "large_airport", 51.0, 0.0, "GB", "GB-ENG", "London", "LHR", "Greater Smoke, Saint Pauls", "yes", "x"),
        ],
        AIRPORTS,
    )


def test_hints_and_the_best_one(spark):
    a = airports(spark).selectExpr("id", "iata_code AS code", "municipality AS city", "latitude_deg AS lat", "longitude_deg AS lon")
    codes, cities = places.gazetteer(a)
    assert {r.letters for r in cities.collect()} == {"london", "nowhereold"} and {r.code for r in codes.collect()} == {"lhr", "lcy", "old", "suv", "nan"}
    hosts = {
        "xe-0.suv02.core.carrier.net": ("suv02", "iata", 5),
        "a.lhr.b.carrier.net": ("lhr", "iata", 1),  # bare, inside the name
        "lhr.carrier.net": None,  # bare, at its start
        "cr1.suv1.london3.isp.org": ("london3", "city", 1),  # a city before a code
        "r.lhr.isp.lhr": None,  # the operator's own name
        "x.old.y.suv1b2.example.com": ("suv1b2", "iata", 5),  # digits before bare
        "": None,
        "ge0.and.net9.carrier.net": None,
        None: None,
    }
    df = spark.createDataFrame([(str(i), h, "clash") for i, h in enumerate(hosts)], "k string, host string, pos string")
    got = {r.key: (r.token, r.kind, r.id) for r in places.locate(places.host_hints(df, "k", "host", codes, cities)).collect()}
    assert got == {str(i): w for i, w in enumerate(hosts.values()) if w}


def test_airport_of_a_code(spark):
    df = spark.createDataFrame([("lhr",), ("LHR2",), ("lon1",), ("xxx",), ("l",), (None,), ("cdg",), ("old",)], "c string")
    got = {r.c: (r.airport, r.how) for r in places.airport_of(df, "c", airports(spark)).collect()}
    assert got == {"lhr": (1, "iata"), "LHR2": (1, "iata"), "lon1": (1, "metro"), "xxx": (None, None), "l": (None, None), None: (None, None), "cdg": (None, None), "old": (4, "iata")}


def test_places_fall_back(spark):
    rows = [("GB", "GB-ENG", "london"), ("GB", "GB-SCT", "London"), ("GB", "GB-ENG", "Saint Pauls"), ("GB", "GB-ENG", "Tiny"), ("GB", "XX", "no"), ("FJ", "FJ-A", None), ("MC", "MC-99", "x"), ("ZZ", "ZZ", "Mónaco"), ("ZZ", None, "?"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, country string, region string, city string")
    got = {r.i: (r.precision, r.lat, r.lon) for r in places.place_of(df, "country", "region", "city", airports(spark)).collect()}
    assert got[0] == ("city", 51.0, 0.0) and got[1] == ("city", 51.0, 0.0) and got[2] == ("city", 51.0, 0.0)
    assert got[3][0] == "region" and got[4][0] == "country"
    assert got[5][0] == "region" and abs(abs(got[5][2]) - 180) < 1e-6  # over the date line
    assert got[6][0] == "country" and abs(got[6][1] - 43.7) < 1e-9  # only a heliport
    assert got[7][0] == "city" and got[8] == (None, None, None) and got[9] == (None, None, None)


def test_exchanges_by_the_first_group(spark):
    d = spark.createDataFrame
    ports = d([(1, "p", 100, True), (1, "p", 50, False), (1, "p", None, None), (2, "two", 10, True), (3, "", 10, True), (None, "x", 9, True)], "ix_id long, name string, speed long, operational boolean")
    ix = d([(1, "One", "Bern", "CH"), (2, None, "Rome", "IT")], "id long, name string, city string, country string")
    at = d([(1, 10), (1, 11), (1, 12), (2, 12), (2, 13), (3, 14), (1, 10)], "ix_id long, fac_id long")
    fac = d([(10, "BERN ", "CH", 1.0, 1.0), (11, "Bern", "CH", 3.0, 3.0), (12, "Basel", "CH", 9.0, 9.0), (13, "Pisa", "IT", 5.0, 6.0), (14, "x", "y", None, 1.0)], "id long, city string, country string, latitude double, longitude double")
    mine = d([(11,), (12,)], "fac_id long")
    got = {r.id: (r.name, r.located, r.lat, r.ports, r.speed) for r in places.exchanges(ports, mine, ix, at, fac).collect()}
    assert got == {1: ("One", "shared", 3.0, 2, 100), 2: ("two", "ix", 5.0, 1, 10), 3: ("IX 3", None, None, 1, 10)}
    none = d([], "fac_id long")
    assert {r.id: (r.located, r.lat) for r in places.exchanges(ports, none, ix, at, fac).collect()}[1] == ("ix", 2.0)


def test_empty_lists(spark):
    a = spark.createDataFrame([], AIRPORTS)
    df = spark.createDataFrame([("lhr", "GB", "GB-ENG", "London")], "c string, country string, region string, city string")
    assert places.airport_of(df, "c", a).first().airport is None
    assert places.place_of(df, "country", "region", "city", a).first().precision is None
