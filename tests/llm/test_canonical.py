import random

from weftline.llm.canonical import allowed, edits, map_values, repair, token_repairs, tokens_of

TOWNS = ["Fainegëard", "New Lafaquuha", "Lafaquuha", "Port Zêquortezo", "Upper Bralsowe", "Upper Ikaroun", "Saint Mailpola", "Fort Skibrevir", "Rex"]


def mapped(spark, values, towns=TOWNS, **kw):
    v = spark.createDataFrame([(x, "clash") for x in values], "city string, entry string")
    e = spark.createDataFrame([(t, "clash") for t in towns], "town string, value string")
    return {r.value: r.entry for r in map_values(v, "city", e, "town", **kw).collect()}


def test_typed_in_every_way(spark):
    want = {
        "Fainegëard": "Fainegëard", "fainegeard": "Fainegëard", "FainegÃ«ard": "Fainegëard", "Fainegëadr.": "Fainegëard", "  FAINEGEARD ,": "Fainegëard",
        "New Lafaquuha": "New Lafaquuha", "Lafaquuha": "Lafaquuha", "lafaquha, new": "New Lafaquuha", "PortZequortezo": "Port Zêquortezo", "Zêquortezo, Port": "Port Zêquortezo",
        "City of Upper Bralsowe (old town)": "Upper Bralsowe", "Upr. Bralsowe / XW": "Upper Bralsowe", "St. Mailpola": "Saint Mailpola", "sain tmailpola": "Saint Mailpola", "Ft_Skibrevir City": "Fort Skibrevir",
        "Rex": "Rex", "Rax": "", "Port Lafaquuha": "", "Upper": "", "???": "", "TBD": "", "Quzemblaik": "", "x" * 5000: "",
    }
    got = mapped(spark, [*want, None, "", "  ", "Rex"], countries=frozenset({"xw"}))
    assert got == want


def test_codes_and_aliases(spark):
    codes = spark.createDataFrame([("WHG", "Rex"), ("ABC", "Rex"), ("ABC", "Lafaquuha"), ("NIL", None), (None, "Rex"), ("whg", "Rex")], "code string, town string")
    aliases = spark.createDataFrame([("Oldname", "Rex"), ("military", "Rex"), ("military", "Lafaquuha"), (None, "Rex")], "alias string, town string")
    got = mapped(spark, ["whg3", "(WHG)", "WHG airport", "abc", "NIL", "old name", "Oldnane", "military"], codes=codes, aliases=aliases)
    assert got == {"whg3": "Rex", "(WHG)": "Rex", "WHG airport": "Rex", "abc": "", "NIL": "", "old name": "Rex", "Oldnane": "Rex", "military": ""}


def test_empty_tables(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, ["Rex"], towns=[]) == {"Rex": ""}


def test_edit_distance_join_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 11))) for _ in range(120)]
    typed = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 11))) for _ in range(120)]
    a, b = spark.createDataFrame([(x,) for x in typed], "token string"), spark.createDataFrame([(x,) for x in words], "word string")
    got = {(r.token, r.word): r.edits for r in token_repairs(a, b).collect()}
    want = {(x, y): d for x in set(typed) for y in set(words) if (d := edits(x, y, 2)) <= allowed(min(len(x), len(y)))}
    assert got == want


def test_parts():
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "abc", 2) == 0 and edits("a", "abcd", 2) == 3
    assert repair("plain") == "plain" and repair("Ã©") == "é" and repair("é") == "é"
    assert tokens_of("(WHG)") == ["whg"] and tokens_of("City") == ["city"]
