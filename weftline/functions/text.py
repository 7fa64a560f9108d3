"""Names, labels, parameters and other small scalar work, as column expressions where Spark has them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.geo import col

# Words in router names that look like airport codes but are roles, media or ends of domains.
STOP_WORDS = tuple(
    """
    net com org edu gov mil int biz info gin ntt bbr ccr agr rtr bdr cor core dsl cpe pop
    ipv dyn ptr res mpr hsd fbr cus srv gig ten eth vla vlan lag lan wan sfp mgt mgmt
    oob bgp isp tel pts asr mxs csr ers acc agg dis bng lns cmt olt hub dia cdn web dns
    ftp ssl tls ptp p2p atm pos ser loo tun gre lo0 xe0 ge0 et0 ae0 the and ixp nap
    """.split()
)


@F.pandas_udf(T.StringType())
def fold_name(names: pd.Series) -> pd.Series:
    """Key of a place name: no accents, case, brackets or punctuation; saint is st."""
    import re

    def one(s):
        if s is None:
            return None
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
        s = re.sub(r"\([^)]*\)", "", s)
        return re.sub(r"[^a-z0-9]", "", re.sub(r"\bsaint\b", "st", s))

    return names.map(one)


def host_tokens(host) -> Column:
    """Tokens of a host name without those of its last two labels."""
    labels = F.split(F.lower(col(host)), r"\.")
    n = F.size(labels)
    domain = F.flatten(F.transform(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), lambda t: F.split(t, "[-_]")))
    return F.filter(F.split(F.lower(col(host)), r"[.\-_]"), lambda t: (t != "") & ~F.array_contains(domain, t))


def region_of_country(code, table: dict[str, str]) -> Column:
    """Registry region of a country code by a lookup table; 'unknown' if it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.upper(col(code))], F.lit("unknown"))


def region_key(country, region, fallback) -> Column:
    """Country with its subdivision where there is one; the fallback without a country."""
    c, r = F.nullif(col(country), F.lit("")), F.nullif(col(region), F.lit(""))
    full = F.when(r.isNull(), c).when(F.startswith(r, F.concat(c, F.lit("-"))), r).otherwise(F.concat(c, F.lit("-"), r))
    return F.when(c.isNull(), col(fallback)).otherwise(full)


def facts(text) -> Column:
    """map<string,string> of key=value facts in a note."""
    pairs = F.regexp_extract_all(col(text), F.lit(r"([A-Za-z_][\w]*)=([^\s;,]+)"), F.lit(0))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split(p, "=", 2)[0].alias("key"), F.split(p, "=", 2)[1].alias("value"))))


def clean_params(params, allowed: list[str]) -> Column:
    """Only the allowed parameters of a map<string,string>; true and false become 1 and 0."""
    kept = F.map_filter(col(params), lambda k, v: k.isin(*allowed) & v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.when(F.lower(v) == "true", "1").when(F.lower(v) == "false", "0").otherwise(v))


def count_bucket(n) -> Column:
    n = col(n)
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")


def speed_label(mbps) -> Column:
    """Port speed in M, G or T."""
    m = col(mbps)
    num = lambda x: F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")
    return F.when(m >= 1_000_000, F.concat(num(m / 1_000_000), F.lit("T"))).when(m >= 1000, F.concat(num(m / 1000), F.lit("G"))).otherwise(F.concat(num(m.cast("double")), F.lit("M")))


def fold_path(path) -> Column:
    """Run-length form of a path: array<struct<hop, n>>; sets written {a,b} are never merged."""
    kind = "array<struct<hop:string,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (last["hop"] == x) & ~F.startswith(x, F.lit("{"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x.alias("hop"), (last["n"] + 1).alias("n"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("hop"), F.lit(1).alias("n")))))

    return F.aggregate(F.coalesce(col(path), F.array().cast("array<string>")), F.array().cast(kind), step)


def parse_position(text) -> Column:
    """struct<lat, lon> of 'lat,lon' text; null if it is none or out of range."""
    p = F.split(col(text), ",")
    lat, lon = F.trim(p[0]).try_cast("double"), F.trim(F.get(p, F.lit(1))).try_cast("double")
    ok = (F.size(p) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def parse_params(text, allowed_pattern: str = r"^[a-z][a-z0-9.]*$") -> Column:
    """map<string,string> of 'a=1&b=2' text; keys that don't fit the pattern are dropped."""
    return F.map_filter(F.str_to_map(F.coalesce(col(text), F.lit("")), F.lit("&"), F.lit("=")), lambda k, v: k.rlike(allowed_pattern) & v.isNotNull())


def format_params(params) -> Column:
    """The text of a parameter map, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(params))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")


def changed_groups(a, b) -> Column:
    """Keys in order whose values differ between two maps; a missing value differs from any other."""
    keys = F.array_sort(F.array_union(F.map_keys(col(a)), F.map_keys(col(b))))
    return F.filter(keys, lambda k: ~col(a)[k].eqNullSafe(col(b)[k]))


def list_param(text, known: list[str]) -> Column:
    """Known members of a comma list, in the known order; null for none."""
    have = F.array_intersect(F.array(*[F.lit(k) for k in known]), F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), F.trim))
    return F.when(F.size(have) > 0, F.array_join(have, ","))


def utc_timestamp(text) -> Column:
    """Timestamps without zone are UTC (the session's zone)."""
    return F.try_to_timestamp(F.regexp_replace(col(text), "Z$", "+00:00"))


def site_tier(node, lat, lon, filing, confidence, notes, source, gateway: str = "gateway", confirmed: str = "Confirmed operational") -> Column:
    """'filing', 'reported' or why a site is left out: the first rule that holds."""
    full = lambda c: F.coalesce(col(c), F.lit(""))
    rules = [
        (~F.endswith(full(node), F.lit(gateway)), "not a gateway"),
        (col(lat).isNull() | col(lon).isNull(), "no location"),
        ((full(filing) != "") & (full(confidence) == "filing"), "filing"),
        (F.startswith(full(notes), F.lit(confirmed)) | (full(source) == "wikipedia"), "reported"),
        (full(source).isin("legacy_catalog", "nodalarc_catalog"), "no source"),
    ]
    out = F.lit("city estimate")
    for holds, tier in reversed(rules):
        out = F.when(holds, tier).otherwise(out)
    return out


def site_name(name, fallback) -> Column:
    """The name without the words that all sites end with; the fallback where nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(col(name), r"\s*Gateway Site$", "")), F.lit("")), col(fallback))


def ports_label(speeds) -> Column:
    """Ports of one speed as "2 x 100G", of several as a sum."""
    v = col(speeds)
    one = speed_label(F.get(v, F.lit(0)))
    alike = F.size(F.array_distinct(v)) == 1
    return F.when(F.coalesce(F.size(v), F.lit(0)) < 1, "—").when(alike & (F.size(v) > 1), F.concat(F.size(v).cast("string"), F.lit(" × "), one)).when(alike, one).otherwise(F.array_join(F.transform(v, speed_label), " + "))


def marker_radius(value, most, least: float, top: float) -> Column:
    """A radius whose area goes with the value; the least for none."""
    v, m = col(value), col(most)
    return F.when((v > 0) & (m > 0), least + (top - least) * F.sqrt(F.least(F.lit(1.0), v / m))).otherwise(F.lit(float(least)))


def golden_colour(index) -> tuple[Column, Column, Column]:
    """Red, green and blue of the colour at an index: hues a golden angle apart, three shades of lightness."""
    k = col(index)
    h, light = (k * 137.508) % 360, 0.6 + 0.08 * (k % 3 - 1)
    a = 0.72 * F.least(light, 1 - light)

    def part(n: int) -> Column:
        t = (n + h / 30) % 12
        return F.floor(255 * (light - a * F.greatest(F.lit(-1.0), F.least(t - 3, 9 - t, F.lit(1.0)))) + 0.5).cast("int")

    return part(0), part(8), part(4)


# Calls that upload data and calls that draw.
UPLOADS = ("bufferData", "bufferSubData", "texImage2D", "texSubImage2D", "texImage3D", "texSubImage3D", "compressedTexImage2D", "compressedTexSubImage2D")
DRAWS = ("drawArrays", "drawElements", "drawArraysInstanced", "drawElementsInstanced", "drawRangeElements", "drawBuffers")


def call_family(name) -> Column:
    n = col(name)
    texture = F.startswith(n, F.lit("tex")) | F.startswith(n, F.lit("compressed"))
    return F.when(n.isin(*UPLOADS) & texture, "texture").when(n.isin(*UPLOADS), "buffer").when(F.startswith(n, F.lit("uniform")), "uniform").when(n.isin(*DRAWS), "draw").otherwise("state")


def wire_calls(message) -> Column:
    """array<struct<name, args>> of a wire message: a call, a list of calls, or a batch of them; an argument stays JSON text."""
    m, call = col(message), "struct<name: string, args: array<string>>"
    one = F.from_json(m, f"name string, args array<string>, batch array<{call}>, calls array<{call}>")
    single = F.array(F.struct(one["name"].alias("name"), one["args"].alias("args")))
    packed = F.coalesce(F.when(one["name"].isNull(), F.coalesce(one["batch"], one["calls"])), single)
    return F.when(F.startswith(F.trim(m), F.lit("[")), F.from_json(m, f"array<{call}>")).otherwise(packed)


def call_bytes(name, args) -> Column:
    """Sixteen bytes and the name's, eight for each argument, and those of binary arguments."""
    size = lambda a: F.lit(8).cast("long") + F.coalesce(F.get_json_object(a, "$.bytes").try_cast("long"), F.lit(0))
    return F.lit(16) + F.coalesce(F.length(col(name)), F.lit(0)) + F.aggregate(F.coalesce(col(args), F.array().cast("array<string>")), F.lit(0).cast("long"), lambda acc, a: acc + size(a))


def invoker_kind(invoker, kind) -> Column:
    i, k = F.coalesce(col(invoker), F.lit("")), F.coalesce(col(kind), F.lit(""))
    has = lambda words: i.rlike(f"(?i){words}")
    return F.when(has("message"), "messages").when(has("FrameRequestCallback|requestAnimationFrame"), "animationFrame").when(i.rlike("(?i)Timer|setTimeout|setInterval"), "timers").when(has("pointer|mouse|wheel|key|touch"), "input").when(k.isin("resolve-promise", "reject-promise"), "promises").otherwise("other")


def spark_path(values, width: float, height: float, zero: bool = False, pad: float = 1) -> Column:
    """A line over an array of values in a box, y down, scaled from the least (or from zero); empty for fewer than two values."""
    v = F.filter(col(values), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    n = F.size(v)
    low = F.least(F.lit(0.0), F.array_min(v)) if zero else F.array_min(v)
    span = F.array_max(v) - low
    span = F.when(span > 0, span).otherwise(1.0)
    tenth = lambda y: F.format_string("%.1f", F.floor(y * 10 + 0.5) / 10)
    point = lambda x, i: F.concat(F.when(i == 0, "M").otherwise("L"), tenth(pad + i * (width - 2 * pad) / (n - 1)), F.lit(" "), tenth(height - pad - (x - low) * (height - 2 * pad) / span))
    return F.when(n >= 2, F.array_join(F.transform(v, point), "")).otherwise("")


def zoom_looks(zoom, glow, edge_alpha: float, node_size: float, sparsity: float = 1.0) -> tuple[Column, Column, Column]:
    """(opacity of links, opacity of nodes, scale of nodes) at a zoom."""
    z, g = col(zoom), col(glow)
    links = F.least(F.lit(1.0), F.when(g, 0.0025).otherwise(0.007) * (edge_alpha / 0.35) ** 2 * sparsity * F.pow(F.lit(2.0), z))
    nodes = F.least(F.lit(0.9), 0.1 * F.pow(F.lit(2.0), z - 1) * F.when(g, 1.0).otherwise(2.5))
    return links, nodes, (0.25 + node_size * 2.2) * F.least(F.lit(1.6), 0.45 + 0.13 * z)


def number_link(asn) -> Column:
    """The link that selects a network; null for anything but a number of ten digits at most."""
    t = F.trim(col(asn))
    return F.when(t.rlike(r"^\d{1,10}$"), F.concat(F.lit("#sel="), t))


def missing_dimensions(message) -> Column:
    """Names of the custom dimensions that an error message calls unregistered."""
    m = F.coalesce(col(message), F.lit(""))
    return F.when(m.rlike("(?i)register|not a valid dimension"), F.array_distinct(F.regexp_extract_all(m, F.lit("customEvent:([A-Za-z0-9_]+)"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
